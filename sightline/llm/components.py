"""Connected components of links between nodes named by integers, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.support import cut_lineage

ROUNDS = 100


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node of its component.

    Each round hangs every node's greater neighbours on its least one, then every node on the
    least of its smaller neighbours (alternating large and small stars), which takes about
    log(nodes) rounds in practice and never more links than there are. Null ends and loops are
    ignored. Rounds end when nothing moves; ``rounds`` guards against a mistake, and running into
    it is an error.
    """
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    now = cut_lineage(links.where(ok).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = (
            large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct()
        )
        after = cut_lineage(after)
        moved = after.join(now, ["a", "b"], "left_anti").limit(1).count() or after.count() != now.count()
        now = after
        if not moved:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
    raise RuntimeError("links did not settle")
