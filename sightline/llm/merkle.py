"""Merkle manifest of a dataset, with every row proved by a recursive query.

Every row is a leaf; the leaves of each group (a language) form a tree by runs of ``FANOUT``
neighbours, and the groups' roots form one more tree. A built level is a table of node rows. For
the proof they are stored once more as rungs: a row with its children's digests and a link to the
row of its parent. A recursive query then climbs from each leaf, a rung at a time: it appends the
siblings there and folds them with the digest that came up.

Upper rungs are climbed by all leaves of a group. So they are stored once per block of
``FANOUT ** DEEP`` neighbouring leaves: no key of the climb's join has more leaves than that,
however large a group is, and the copies are fewer than a leaf in a thousand.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.support import cut_lineage

FANOUT = 8
DEEP = 4  # rungs above this one are stored per block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree of the groups' roots

_BYTES = 32
_POWERS = [FANOUT**k for k in range(21)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    """SHA-256 of a string, as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def field_text(value: Column) -> Column:
    """A value as its byte count, ``:`` and its text; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[field_text(values[f]) for f in FIELDS]))


def _power(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in _POWERS]), (k + 1).cast("int"))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves: the least power of the fan-out that reaches ``n``."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group of ``keys`` (null is a value) from 0 in ``order``, nulls first.

    Rows are laid out by ranges of keys and order, so a large group spreads over many tasks; each
    range counts its own rows, and one row per range and group carries the counts on. Rows equal
    in keys and order get neighbouring numbers in no particular order.
    """
    part, before = f"{out}_part", f"{out}_before"
    sort = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    rows = cut_lineage(df.repartitionByRange(*sort).withColumn(part, F.spark_partition_id()))
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, part).agg(F.count("*").alias("n_rows"))
    counts = counts.withColumn(before, F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))).drop("n_rows")
    counts = counts.select(*[F.col(c).alias(f"{out}_{c}") for c in (*keys, part)], before)
    inside = W.partitionBy(*keys, part).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    rows = rows.withColumn(out, F.row_number().over(inside))
    same = [F.col(c).eqNullSafe(F.col(f"{out}_{c}")) for c in (*keys, part)]
    rows = rows.join(counts, on=same).withColumn(out, (F.col(out) + F.col(before) - 1).cast("long"))
    return rows.select(*df.columns, out)


def build_levels(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and roots of the trees over ``leaves`` (tree, n, idx, digest).

    A tree has ``n`` leaves, numbered by ``idx``. Nodes are (tree, n, step, idx, children), the
    children's digests one after another; roots are (tree, n, digest). A tree of one leaf has no
    node: the leaf is the root. Each level is written before the next is built on it.
    """
    spark = leaves.sparkSession
    level = leaves.select("tree", "n", "idx", "digest")
    most = level.agg(F.max("n")).first()[0] or 0
    roots = [level.where("n = 1").select("tree", "n", "digest")]
    nodes = []
    for step in range(1, len(_POWERS)):
        if FANOUT ** (step - 1) >= most:
            break
        runs = level.where(F.col("n") > FANOUT ** (step - 1)).groupBy("tree", "n", F.floor(F.col("idx") / FANOUT).alias("idx"))
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        level = runs.agg(F.array_join(F.transform(run, lambda c: as_hex(c["digest"])), "").alias("run"))
        level = level.select("tree", "n", F.lit(step).alias("step"), "idx", F.unhex("run").alias("children"), digest(F.col("run")).alias("digest"))
        level = cut_lineage(level)
        nodes.append(level.drop("digest"))
        roots.append(level.where(F.col("n") <= FANOUT**step).select("tree", "n", "digest"))
    if not nodes:
        nodes = [spark.createDataFrame([], "tree long, n long, step int, idx long, children binary")]
    return _union(nodes), _union(roots)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rungs(nodes: DataFrame, top: DataFrame, trees: DataFrame) -> DataFrame:
    """Node rows as the climb meets them: (tree, step, cell, slot, children, up_step, up_cell).

    ``step`` counts from the leaf through the group's tree into the one above. ``cell`` is the
    node's own number up to step ``DEEP`` and a block of leaves from there on. ``up_step`` and
    ``up_cell`` are the parent's, null at the root. ``slot`` is the child that the climb comes
    from; it is null below, where it follows from the leaf's place.
    """
    spread = _power(F.greatest(F.col("step") - DEEP, F.lit(0)))
    cells = _cells(F.col("n"), F.lit(DEEP))
    inside = nodes.withColumn("cell", F.explode(F.sequence(F.col("idx") * spread, F.when(
        F.col("step") > DEEP, F.least((F.col("idx") + 1) * spread, cells) - 1).otherwise(F.col("idx")))))
    inside = inside.join(trees.select("tree", "last"), "tree").select(
        "tree", "step", "cell", F.lit(None).cast("int").alias("slot"), "children", "last")

    above = top.select(F.col("step").alias("top_step"), F.col("idx").alias("top_idx"), "children")
    over = trees.withColumn("top_step", F.explode(F.when(F.col("last") > F.col("h"), F.sequence(F.lit(1), F.col("last") - F.col("h")))))
    over = over.withColumn("top_idx", F.floor(F.col("tree") / _power(F.col("top_step")))).join(above, ["top_step", "top_idx"])
    over = over.withColumn("step", F.col("h") + F.col("top_step"))
    over = over.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), _cells(F.col("n"), F.col("step")) - 1)))
    slot = F.floor(F.col("tree") / _power(F.col("top_step") - 1)) % FANOUT
    over = over.select("tree", "step", "cell", slot.cast("int").alias("slot"), "children", "last")

    out = inside.unionByName(over)
    at_root = F.col("step") == F.col("last")
    lifted = F.when(F.col("step") < DEEP, F.floor(F.col("cell") / FANOUT)).otherwise(F.col("cell"))
    return out.select(
        "tree", "step", "cell", "slot", "children",
        F.when(~at_root, F.col("step") + 1).alias("up_step"), F.when(~at_root, lifted).alias("up_cell"),
    )


def _cells(n: Column, step: Column) -> Column:
    """Cells of a tree of ``n`` leaves at a step."""
    size = _power(F.least(step, F.lit(DEEP)))
    return F.floor((n + size - 1) / size)


@contextmanager
def _unlimited_rows(spark: SparkSession):
    """Recursive queries may return any number of rows; their levels stay bounded."""
    name = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, old)


CLIMB = """
WITH RECURSIVE climb (tree, pos, doc_id, leaf, step, up_step, up_cell, siblings, folded) AS (
    SELECT tree, pos, doc_id, leaf, 0, up_step, up_cell, X'', tampered
    FROM {leaves}
    UNION ALL
    SELECT tree, pos, NULL, NULL, step, up_step, up_cell, concat(before, after),
           unhex(sha2(lower(hex(concat(before, folded, after))), 256))
    FROM (
        SELECT c.tree, c.pos, r.step, r.up_step, r.up_cell, c.folded,
               substr(r.children, 1, {bytes} * coalesce(r.slot, c.slot)) AS before,
               substr(r.children, {bytes} * coalesce(r.slot, c.slot) + {bytes} + 1) AS after
        FROM (
            SELECT *, CAST(pos DIV element_at({powers}, step + 1) % {fanout} AS INT) AS slot FROM climb
        ) c
        JOIN {rungs} r ON r.tree = c.tree AND r.step = c.up_step AND r.cell = c.up_cell
    )
)
SELECT tree, pos, doc_id, leaf, step, siblings, folded FROM climb
"""


def climb(leaves: DataFrame, rung_rows: DataFrame) -> DataFrame:
    """One row per leaf and step on its way up, from the recursive query.

    The siblings of a step are its own row's; ``folded`` is the digest carried up from the
    tampered leaf. The query is lazy: run it within ``_unlimited_rows``.
    """
    spark = leaves.sparkSession
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in ("leaves", "rungs")}
    leaves.createOrReplaceTempView(names["leaves"])
    rung_rows.createOrReplaceTempView(names["rungs"])
    powers = "array(" + ", ".join(f"{p}L" for p in _POWERS) + ")"
    try:
        return spark.sql(CLIMB.format(**names, bytes=_BYTES, powers=powers, fanout=FANOUT))
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


def tampered_text(docs: DataFrame) -> Column:
    """The text in lower case (A-Z only) where 3 divides the crc32 of the id; else as it is."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Every row's place in the manifest, and whether its (tampered) text still folds to the root.

    Returns doc_id, leaf, subroot, root, proof_sha256 (all of the rows as they are), folded_root
    (from ``tampered`` in place of the text, by the original siblings) and verified (whether that
    is the root); digests in lower-case hex. ``tampered`` is a column of ``docs``, the text as it
    is by default.

    Every row is a leaf of its own. Null ids come first in their language and null languages
    first among these; rows of one id are ordered by their leaf's digest, and equal rows get equal
    leaves, so which is first tells nothing. Nulls are part of the digest (``-``) and differ from
    empty texts. An empty table gives no rows. Columns other than the five of ``FIELDS`` are
    ignored. Texts are read once and never shuffled: only digests are.
    """
    now = {f: F.col(f) for f in FIELDS}
    then = now | {"text": F.col("text") if tampered is None else tampered}
    leaves = docs.select("lang", "doc_id", leaf_digest(now).alias("leaf"), leaf_digest(then).alias("tampered"))
    leaves = cut_lineage(number_rows(leaves, ["lang"], ["doc_id", "leaf"], "pos"))

    groups = cut_lineage(leaves.groupBy("lang").agg(F.count("*").alias("n")))
    trees = cut_lineage(number_rows(groups, [], ["lang"], "tree"))
    count = trees.count()
    known = trees.select(F.col("lang").alias("tree_lang"), "tree", "n")
    leaves = leaves.join(known, F.col("lang").eqNullSafe(F.col("tree_lang"))).drop("lang", "tree_lang")
    nodes, roots = build_levels(leaves.select("tree", "n", F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    subroots = cut_lineage(roots.select("tree", F.col("digest").alias("subroot")))
    top, root = build_levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"),
                                             F.col("tree").alias("idx"), F.col("subroot").alias("digest")))
    last = height(F.col("n")) + height(F.lit(count).cast("long"))
    trees = trees.select("tree", "n", height(F.col("n")).alias("h"), last.alias("last"))
    steps = cut_lineage(rungs(nodes, top, trees))
    starts = leaves.select(
        "tree", "pos", "doc_id", "leaf", "tampered",
        F.when(last > 0, F.lit(1)).alias("up_step"), F.when(last > 0, F.floor(F.col("pos") / FANOUT)).alias("up_cell"),
    )
    way = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    with _unlimited_rows(docs.sparkSession):
        proofs = climb(starts, steps).groupBy("tree", "pos").agg(
            F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"),
            F.sha2(F.array_join(F.transform(way, lambda s: as_hex(s["siblings"])), ""), 256).alias("proof_sha256"),
            F.max_by("folded", "step").alias("folded"),
        )
        proofs = cut_lineage(proofs)
    ends = subroots.crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    return proofs.join(ends, "tree").select(
        "doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        "proof_sha256", as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def oracle(table: str) -> str:
    """DuckDB SQL for ``manifest`` with ``tampered_text`` over a table.

    The crc32 is folded over the id's digits with its table of 256, which one CTE derives. Every
    leaf is joined with the members of its runs, so this is for small tables only.
    """
    fields = " || ".join(
        f"coalesce(strlen({f}::varchar) || ':' || {'{text}' if f == 'text' else f}::varchar, '-')" for f in FIELDS
    )
    return f"""
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)
),
judged AS (
    SELECT d.*, coalesce(xor(list_reduce(
               list_prepend(4294967295, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint)),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS hit
    FROM {table} d, crc_table
),
leaves AS (
    SELECT lang, doc_id, leaf, tampered,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM (
        SELECT lang, doc_id, sha256({fields.format(text='text')}) AS leaf,
               sha256({fields.format(text=f"CASE WHEN hit THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")}) AS tampered
        FROM judged
    )
),
levels AS (
    SELECT lang, n, 0 AS step, pos AS idx, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, n, step + 1, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx))
    FROM levels WHERE n > {FANOUT} ** step GROUP BY lang, n, step, idx // {FANOUT}
),
subroots AS (
    SELECT lang, step AS h, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
    FROM levels WHERE n <= {FANOUT} ** step
),
top AS (
    SELECT n, 0 AS step, idx, digest FROM subroots
    UNION ALL
    SELECT n, step + 1, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx))
    FROM top WHERE n > {FANOUT} ** step GROUP BY n, step, idx // {FANOUT}
),
members AS (
    SELECT l.lang, l.pos, v.step AS k, v.idx, v.digest, v.idx = l.pos // ({FANOUT} ** v.step)::bigint AS own
    FROM leaves l JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang AND v.n > {FANOUT} ** v.step
     AND v.idx // {FANOUT} = l.pos // ({FANOUT} ** (v.step + 1))::bigint
    UNION ALL
    SELECT l.lang, l.pos, s.h + v.step, v.idx, v.digest, v.idx = s.idx // ({FANOUT} ** v.step)::bigint
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN top v ON v.n > {FANOUT} ** v.step AND v.idx // {FANOUT} = s.idx // ({FANOUT} ** (v.step + 1))::bigint
),
fold AS (
    SELECT lang, pos, 0 AS k, tampered AS digest FROM leaves
    UNION ALL
    SELECT f.lang, f.pos, f.k + 1, sha256(string_agg(CASE WHEN m.own THEN f.digest ELSE m.digest END, '' ORDER BY m.idx))
    FROM fold f JOIN members m ON m.lang IS NOT DISTINCT FROM f.lang AND m.pos = f.pos AND m.k = f.k
    GROUP BY f.lang, f.pos, f.k
),
folded AS (SELECT lang, pos, arg_max(digest, k) AS folded_root FROM fold GROUP BY lang, pos),
proofs AS (SELECT lang, pos, string_agg(digest, '' ORDER BY k, idx) FILTER (NOT own) AS proof FROM members GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.folded_root, f.folded_root = t.digest AS verified
FROM leaves l
JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN (SELECT digest FROM top WHERE n <= {FANOUT} ** step) t ON true
JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
"""
