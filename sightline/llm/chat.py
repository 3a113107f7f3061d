"""Conversations from reply trees: enumerate paths, rank branches, write each chosen one as a text.

DataFrame functions only. A path is found by iterative self-joins that double the distance an
ancestor pointer spans, so a tree of depth d takes about log2(d) joins of the messages with
themselves, and only the chosen branches are ever expanded into their messages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.support import cut_lineage

# Template: "### Role: text</turn>\n" for each turn. Inside roles and texts the characters that
# begin a mark are written as two-character codes, so a mark in the output is always a mark.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TEXT_CODES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODES = (*TEXT_CODES, (":", "\\c"))


def escape(text: Column, codes=TEXT_CODES) -> Column:
    """Reversible: every backslash in the result is followed by its code letter."""
    return reduce(lambda c, code: F.replace(c, F.lit(code[0]), F.lit(code[1])), codes, text)


def unescape(text: Column, codes=TEXT_CODES) -> Column:
    return reduce(lambda c, code: F.replace(c, F.lit(code[1]), F.lit(code[0])), reversed(codes), text)


def as_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as trees of one branch: each row replies to the one before it.

    Rows of a conversation are ordered by turn (null first); rows that tie by role and text.
    Returns tree_id, message_id, parent_id, role, text, score (0).
    """
    order = W.partitionBy("tree_id").orderBy(F.col("__turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select(F.col(conv).alias("tree_id"), F.col(turn).alias("__turn"), "role", "text")
    at = F.row_number().over(order).cast("long")
    numbered = rows.withColumn("message_id", at).drop("__turn")
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return numbered.select("tree_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, per_tree: int = 1, max_depth: int | None = None) -> DataFrame:
    """The messages of the ``per_tree`` best root-to-leaf paths of each tree.

    ``messages``: tree_id, message_id, parent_id, role, text, score. Adds ``branch`` (1: best) and
    ``position`` (0: root). A path's score is the mean of its messages' scores (null: 0); ties go
    to the longer path, then the smaller leaf id. A parent that is null or absent makes a message
    a root. Messages with a null id, or on a cycle, hang on no root and are left out; of rows with
    one id in a tree the least by role and text counts. A null tree_id is a tree of its own.
    A path of more than ``max_depth`` messages is an error; by default there is no limit.
    """
    # Structs compare null-safely in joins and groupings.
    node = lambda m: F.struct(F.col("tree_id"), F.col(m))
    same = W.partitionBy("tree_id", "message_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("role", "text", "parent_id", "score")))
    base = (
        messages.select("tree_id", "message_id", "parent_id", "role", "text", "score")
        .where(F.col("message_id").isNotNull())
        .withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    )
    base = cut_lineage(base.withColumns({"node": node("message_id"), "score": F.coalesce("score", F.lit(0.0)).cast("double")}))
    ids = base.select(F.col("node").alias("up"))
    links = base.select("node", "score", F.when(F.col("parent_id").isNotNull(), node("parent_id")).alias("up"))
    links = links.join(ids.withColumn("there", F.lit(True)), "up", "left")
    step = cut_lineage(links.select("node", F.when(F.col("there"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("length")))
    # Each round: a pointer spans twice as far; score and length cover the messages it passes.
    jumps = [step.select("node", "up").where("up IS NOT NULL")]
    # Pointers that span more messages than there are go round a cycle.
    rounds = base.count().bit_length()
    while len(jumps) <= rounds and jumps[-1].limit(1).count():
        far = step.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("score").alias("__s"), F.col("length").alias("__l"))
        # Messages whose pointer has come to the root wait as they are; the others alone are joined.
        moved = step.where("up IS NOT NULL").join(far, "up").select(
            "node", F.col("__up").alias("up"), (F.col("score") + F.col("__s")).alias("score"), (F.col("length") + F.col("__l")).alias("length")
        )
        step = cut_lineage(step.where("up IS NULL").union(moved))
        jumps.append(step.select("node", "up").where("up IS NOT NULL"))
    if max_depth is not None and step.where((F.col("up").isNull()) & (F.col("length") > max_depth)).limit(1).count():
        raise ValueError(f"a path has more than {max_depth} messages")
    parents = jumps[0].select(F.col("up").alias("node")).distinct()
    leaves = step.where("up IS NULL").join(parents, "node", "left_anti")
    rank = W.partitionBy("node.tree_id").orderBy(
        (F.col("score") / F.col("length")).desc(), F.col("length").desc(), F.col("node.message_id")
    )
    leaves = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= per_tree)
    # From each chosen leaf, the longest jumps first: every ancestor is reached exactly once.
    path = leaves.select("branch", "node", (F.col("length") - 1).alias("position"))
    for k in reversed(range(len(jumps) - 1)):
        far = path.join(jumps[k], "node")
        path = path.union(far.select("branch", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position")))
        path = cut_lineage(path)
    return path.join(base, "node").select("tree_id", "branch", "position", "message_id", "role", "text")


def format_paths(paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per (tree_id, branch): ``formatted`` and ``loss``, the mask as code point spans.

    ``loss`` is an array of (start, end), end exclusive, that covers the texts of ``loss_role``
    and no mark. Null roles and texts count as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role, ROLE_CODES), F.lit(COLON))
    body = escape(text)
    turn = F.struct(
        "position", head.alias("head"), body.alias("body"), (role == loss_role).alias("loss"),
        F.char_length(head).cast("long").alias("n_head"), F.char_length(body).cast("long").alias("n_body"),
    )
    turns = paths.select("tree_id", "branch", turn.alias("turn")).groupBy("tree_id", "branch").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # A running start: fold the turns once, carrying where the next begins.
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def fold(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["n_head"]
        end = start + t["n_body"]
        spans = F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    written = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return turns.select("tree_id", "branch", written.alias("formatted"), F.aggregate("turns", begin, fold)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    marked = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        rest = F.substring(t, F.lit(len(OPEN) + 1), F.char_length(t))
        cut = F.instr(rest, COLON)
        return F.struct(
            unescape(F.substring(rest, F.lit(1), cut - 1), ROLE_CODES).alias("role"),
            unescape(F.substring(rest, cut + len(COLON), F.char_length(rest))).alias("text"),
        )

    return F.transform(marked, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) through the tree: conv_id, formatted, loss."""
    return format_paths(best_paths(as_replies(turns)), loss_role).withColumnRenamed("tree_id", "conv_id").drop("branch")
