"""Token ids of whole corpora in packed binary files, written and read in parallel.

Rows are dealt to tasks by ranges of doc_id, so file k holds smaller ids than file k + 1 and the
files together are the corpus in order. Each task encodes its texts and writes one file under a
name of its own, which then takes the final name: a task that runs again writes the same file.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.support import cut_lineage
from . import pfor
from .chunk_cache import ChunkCache

VOCABULARY = "byte_bpe_50k.json"
END = 2
SUFFIX = "pfor"
TOGETHER = 16  # chunks that the library gets as one text
_OPENS = re.compile(r"[ \n]\S")  # how a chunk begins that a match of the pre-tokenizer cannot reach into from before


class Encoder:
    """Ids of whole texts by the tokenizers library, which meets each distinct chunk about once.

    The strings of added tokens become these tokens, as the library has it; the texts between them
    are encoded each alone. Chunks are independent only with a byte-level pre-tokenizer on texts as
    they are, so other vocabulary files are refused.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        held = json.loads(content)
        before = held.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(held.get(k) for k in ("normalizer", "truncation", "padding")) or held["model"].get("dropout"):
            raise ValueError("the vocabulary must be byte-level, without prefix space, normalizer, truncation or padding")
        added = held.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must stand for their own strings alone")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.together = 1 if any(re.search(r"\s", a) for a in self.added) else TOGETHER
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max([-1, *vocabulary.values(), *self.added.values()]) + 1, np.int64)  # bytes of each token
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.cache = ChunkCache(self._chunks)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk alone. A call costs the library more than a word does, so chunks go
        joined where they may stand one after the other; their tokens' bytes tell them apart."""
        opens = list(map(_OPENS.match, chunks))
        closes = [c != "" and not c[-1].isspace() for c in chunks]
        starts = [i for i in range(len(chunks)) if i % self.together == 0 or not (opens[i] and closes[i - 1])]
        found = self._library(["".join(chunks[a:b]) for a, b in zip(starts, [*starts[1:], len(chunks)])])
        if len(found) == len(chunks):
            return found
        ids = list(chain.from_iterable(found))
        ends = np.cumsum([len(c.encode()) for c in chunks])
        after = np.cumsum(self.sizes[ids])
        at = np.searchsorted(after, ends, "right")  # tokens that end by then
        if not at[-1] == len(ids) or not np.array_equal(np.r_[0, after][at], ends):
            return self._library(chunks)  # tokens that do not stand for their bytes
        at = at.tolist()
        return [ids[a:b] for a, b in zip([0, *at], at)]

    def encode(self, texts: list) -> list[np.ndarray]:
        special = {i for i, t in enumerate(texts) if t and any(a in t for a in self.added)}
        found = self.cache.ids([None if i in special else t for i, t in enumerate(texts)] if special else texts)
        for i in special:
            parts = self.cut.split(texts[i])  # text, token, text, …
            ids = self.cache.ids(parts[::2])
            tokens = [np.array([self.added[t]], np.uint32) for t in parts[1::2]]
            found[i] = np.concatenate([x for pair in zip(ids, [*tokens, ids[0][:0]]) for x in pair])
        return found


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The encoder of a vocabulary file's content, built once per process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
    key = hashlib.sha256(content).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def _store(folder: str):
    """File system and path of a folder, for tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _save(folder: str, name: str, content: bytes) -> None:
    store, path = _store(folder)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    final = f"{path}/{name}"
    if store.get_file_info(final).type.name != "NotFound":
        store.delete_file(final)
    store.move(draft, final)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END, share: float = pfor.SHARE, files: int | None = None) -> DataFrame:
    """Encode ``text`` and write the ids, each document's followed by ``end``, to ``folder``.

    Documents are ordered by doc_id (null first), rows that share one by their text; rows that
    are equal throughout stay as many. A null text counts as empty: just ``end``. Returns a row
    per file: file (number in order), name, n_docs, n_ids, n_bytes. ``files``: number of ranges,
    by default the session's shuffle partitions. Other columns are ignored. Strings of the
    vocabulary's added tokens in a text become these tokens, as the library encodes them.
    """
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # one vocabulary file, of fixed size
    store, local = _store(folder)
    store.create_dir(local, recursive=True)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The text's hash lets even one id's rows be dealt to several ranges, in one order.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    tail = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, doc_ids, ids = encoder(content.value), [], []
        for batch in batches:
            doc_ids += batch.column("doc_id").to_pylist()
            found = own.encode(batch.column("text").to_pylist())
            # Kept at 16 bits where that is enough, until the file is written.
            ids += [a.astype(np.uint16) if a.size and a.max() < 1 << 16 else a for a in (np.r_[x, tail] for x in found)]
        if doc_ids:
            k = TaskContext.get().partitionId()
            data = pfor.write(doc_ids, ids, share)
            name = f"part-{k:06d}.{SUFFIX}"
            _save(folder, name, data)
            row = [k, name, len(doc_ids), sum(map(len, ids)), len(data)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["file", "name", "n_docs", "n_ids", "n_bytes"])

    return cut_lineage(ranged.mapInArrow(run, "file long, name string, n_docs long, n_ids long, n_bytes long"))


def read_ids(spark: SparkSession, folder: str, compute, fields: str) -> DataFrame:
    """Read the files of ``folder``: file, place, doc_id and what ``compute(ids)`` returns per document.

    ``compute`` gets one document's ids and returns a dict with the columns of ``fields``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"file long, place long, doc_id long, {fields}")
    arrow = to_arrow_schema(schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{SUFFIX}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                number = int(re.search(r"part-(\d+)", path.as_py())[1])
                held = pfor.File(content.as_py())
                rows = [
                    {"file": number, "place": k, "doc_id": None if d["null"] else int(d["doc_id"]), **compute(ids)}
                    for (k, ids), d in zip(held.runs(), held.documents)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def digest(ids: np.ndarray) -> dict:
    return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def document_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of ``read_ids`` with n_tokens, and ``start``: the ids of all documents before."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("__n"))  # one row per file
    before = totals.withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__within", within).join(before, "file").withColumn("start", F.col("__base") + F.col("__within")).drop("__within", "__base", "__n")
