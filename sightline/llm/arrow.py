"""Run a function of whole texts over a DataFrame, in Arrow batches, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 4 << 20  # of the column read, handed to a function at once


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` has some ``SLICE_BYTES``, a longer value alone."""
    after = _value_ends(batch.column(column))
    at = 0
    while at < batch.num_rows:
        before = after[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(after, before + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _value_ends(values: pa.Array) -> np.ndarray:
    """Bytes of text, or of the items of lists, up to each row."""
    if pa.types.is_list(values.type):
        lengths, width = pc.list_value_length(values), 8
    else:
        lengths, width = pc.binary_length(values), 1
    return np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) * width)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind, from_pandas=False)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    fields: str,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    read: Callable = pa.Array.to_pylist,
) -> DataFrame:
    """``carry`` columns as they are, and the columns of ``fields`` computed from each batch of texts.

    ``make()`` runs once per task and returns the function from a list of texts (None: null) to
    a dict with a list or array for each field. ``read`` turns the column into that list. Ids never pass through Python, so null and very
    large ones stay exact. A batch is handed on in slices of bounded size, so that what is derived
    from its texts stays small.
    """
    added = StructType.fromDDL(fields)
    schema = StructType([docs.schema[c] for c in carry] + list(added))
    types = [f.type for f in to_arrow_schema(added)]
    names = [f.name for f in schema]
    wanted = list(dict.fromkeys([*carry, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in (part for whole in batches for part in slices(whole, text)):
            out = compute(read(batch.column(text)))
            columns = [batch.column(c) for c in carry]
            columns += [_column(out[f.name], t) for f, t in zip(added, types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*wanted).mapInArrow(run, schema)
