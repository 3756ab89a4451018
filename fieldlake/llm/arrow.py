"""Arrow batches inside tasks: bounded slices in, record batches out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.staging import bounded_batches

SLICE_BYTES = 1 << 20
"""UTF-8 bytes of text that one vectorised step works on; one longer text is a step of its own."""


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of any frame: other columns go, a null text counts as empty."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes; rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = _byte_lengths(batch.column(column))
        cut = np.cumsum(lengths) // limit
        starts = np.flatnonzero(np.diff(cut, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(begin), int(end - begin))


def _byte_lengths(array: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list (or binary) array of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind.value_type))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length - 1`` of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
