"""Documents in batches that tasks may come back to: the frame of operators in several passes.

Rows are dealt to numbered batches of bounded size by a hash of id and text. A pass reads each batch
whole, together with what earlier passes found for it. All passes share one shuffle of the texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def in_order(pdf):
    """A batch's rows by id and text, however the shuffle brought them.

    Blocks of a shuffle arrive in another order from pass to pass, and passes that number what they
    find in a batch must number it alike.
    """
    ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
    return pdf.iloc[sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))]


class Batches:
    """``docs`` as (batch, doc_id, text), about ``size`` bytes of text in each batch.

    Null ids become the least 64-bit integer and null texts empty. Rows with equal id and text
    land in one batch. Every pass sees a batch's rows in one order, by id and text.
    """

    def __init__(self, docs: DataFrame, size: int = BATCH_BYTES):
        spark = docs.sparkSession
        rows = docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
        self.number = max(1, -(-total // size), spark.sparkContext.defaultParallelism)
        self.rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.number)).cast("int")).repartition(self.number, "batch")

    def each(self, run, schema: str) -> DataFrame:
        """``run(batch, doc_ids, texts)`` → dict of columns, for every batch."""

        def one(pdf):
            import pandas as pd

            pdf = in_order(pdf)
            return pd.DataFrame(run(int(pdf["batch"].iloc[0]), pdf["doc_id"].to_numpy(), pdf["text"].tolist()))

        return self.rows.groupBy("batch").applyInPandas(one, schema)

    def each_with(self, found: DataFrame, run, schema: str) -> DataFrame:
        """The same, with the rows of ``found`` for that batch (a frame, perhaps empty)."""

        def one(docs, rows):
            import pandas as pd

            if not len(docs):
                return pd.DataFrame(columns=[c.strip().split()[0] for c in schema.split(",")])
            docs = in_order(docs)
            return pd.DataFrame(run(int(docs["batch"].iloc[0]), docs["doc_id"].to_numpy(), docs["text"].tolist(), rows))

        return self.rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(one, schema)


def deal(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of the keys of each shard, by the keys' upper bits."""
    shard = ((keys >> np.uint64(40)).astype(np.uint64) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))


SHARED = "shard int, batch int, keys binary, counts binary"


def local_counts(keys: np.ndarray, shards: int, batch: int) -> dict:
    """One row per shard: a batch's distinct keys, sorted, and in how many documents each stands."""
    distinct, counts = np.unique(keys, return_counts=True)
    rows = [(s, distinct[at], counts[at]) for s, at in enumerate(deal(distinct, shards)) if len(at)]
    return {
        "shard": [s for s, _, _ in rows],
        "batch": [batch] * len(rows),
        # Within a shard 40 bits tell keys apart; a chance clash only adds a candidate.
        "keys": [_low(k).tobytes() for _, k, _ in rows],
        "counts": [np.minimum(n, 255).astype(np.uint8).tobytes() for _, _, n in rows],
    }


def _low(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def count_shared(local: DataFrame) -> DataFrame:
    """For each row of ``local`` the total count of each of its keys over all batches (255: or more).

    A key comes once per batch, whatever it holds, so no key gathers many rows in one task.
    """

    def one(pdf):
        import pandas as pd

        parts = [_wide(b) for b in pdf["keys"]]
        counts = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["counts"]]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.minimum(np.bincount(inverse, weights=counts), 255).astype(np.uint8)[inverse]
        cuts = np.split(totals, np.cumsum([len(p) for p in parts])[:-1])
        return pd.DataFrame({"shard": pdf["shard"], "batch": pdf["batch"], "totals": [c.tobytes() for c in cuts]})

    return local.groupBy("shard").applyInPandas(one, "shard int, batch int, totals binary")


def totals_of(keys: np.ndarray, shards: int, found) -> tuple[np.ndarray, np.ndarray]:
    """The batch's distinct keys, sorted, and their totals, from the rows found for the batch."""
    distinct = np.unique(keys)
    totals = np.zeros(len(distinct), np.uint8)
    rows = dict(zip(found["shard"], found["totals"]))
    for s, at in enumerate(deal(distinct, shards)):
        if len(at):
            totals[at] = np.frombuffer(rows[s], np.uint8)
    return distinct, totals
