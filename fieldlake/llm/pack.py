"""Operator 6: packing along a space-filling curve.

Each document's tokens are hashed to a vector of counts, projected to a few
dimensions, and given the Hilbert key of that point.  A range sort by the key
puts similar documents next to each other; the sorted documents are then one
long stream of tokens, cut every ``length`` tokens.  Only the last sequence of
the whole corpus is shorter, so padding is below one sequence in all.

The one number per partition that travels through the driver is its token
count; from their running sum every document knows its place in the stream.
Tokenized rows and sorted rows are written tables in the shared folder, so a
lost executor costs the tasks it ran and cannot change an order already used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.arrow import keyed_text, ragged, slices, spans
from fieldlake.llm.bpe import encoder_of, share_vocabulary
from fieldlake.llm.pieces import mix
from fieldlake.llm.staging import stage

SEQUENCE = 2048
END_ID = 1
BUCKETS, DIMENSIONS, BITS = 256, 4, 12


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(axes)):
            upper = (axes[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | (axis ^ turn) >> level & 1
    return key


def projection() -> np.ndarray:
    """Fixed directions, spread so that unit vectors of counts use the whole range of coordinates."""
    directions = np.random.default_rng(17).standard_normal((BUCKETS, DIMENSIONS))
    return directions - directions.mean(axis=0)


def document_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Hilbert key of each run of token ids."""
    bucket = (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    vectors = np.sqrt(np.bincount(row * BUCKETS + bucket, minlength=len(counts) * BUCKETS).reshape(-1, BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    unit = (np.tanh(2 * (vectors @ projection())) + 1) / 2
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenize(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id long, tokens binary, n_tokens long, curve long``: ids with the end id, two little-endian bytes each (four for large vocabularies)."""
    content = share_vocabulary(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value)
        kind = token_type(len(encoder.vocabulary.tokens))
        for batch in slices(batches):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts + 1) - 1
            closed = np.full(len(ids) + len(counts), end_id, dtype=kind)
            keep = np.ones(len(closed), dtype=bool)
            keep[ends] = False
            closed[keep] = ids
            counts = counts + 1
            tokens = ragged(closed.view(np.uint8), counts * kind.itemsize, pa.binary())
            yield pa.record_batch([batch.column("doc_id"), tokens, pa.array(counts), pa.array(document_keys(closed, counts))], names=["doc_id", "tokens", "n_tokens", "curve"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, tokens binary, n_tokens long, curve long")


def token_type(vocabulary_size: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def pack(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens; a row for each piece of a document.

    Returns ``doc_id, start, length, token_bytes, doc_tokens, sequence_id,
    offset``; ``token_bytes`` holds little-endian 32-bit ids.  Equal keys are
    ordered by document id (null first), then by content, so repeated rows are packed
    each on its own and a hot key is spread like any other.  A null or empty
    text is its end id alone.  An empty table has no pieces.
    """
    tokenized = stage(tokenize(df, vocabulary_path, id_col, text_col, end_id), "pack-tokens")
    order = ["curve", "doc_id", "n_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(counts)
            before = int(ends[-1]) if len(ends) else before
            yield pa.record_batch([*batch.columns, pa.array(ends - counts), pa.array(np.full(len(counts), part, dtype=np.int64))], names=[*batch.schema.names, "before", "part"])

    sorted_rows = tokenized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_rows.mapInArrow(place, "doc_id long, tokens binary, n_tokens long, curve long, before long, part long"), "pack-sorted")
    # a row per partition of the sort: bounded by the number of tasks
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, running = {}, 0
    for row in totals:
        base[row.part], running = running, running + row.n
    bases = df.sparkSession.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens"):
            counts = batch.column("n_tokens").to_numpy()
            at = batch.column("before").to_numpy() + np.array([bases.value[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            blobs = batch.column("tokens").to_pylist()
            flat = np.frombuffer(b"".join(blobs), dtype="<u2" if len(blobs[0]) == 2 * counts[0] else "<u4").astype("<u4")
            pieces = (at % length + counts - 1) // length + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            nth = spans(np.zeros(len(counts), dtype=np.int64), pieces)
            begin = np.maximum(0, nth * length - at[row] % length)
            end = np.minimum(counts[row], (nth + 1) * length - at[row] % length)
            where = at[row] + begin
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": begin, "length": end - begin, "token_bytes": ragged(flat.view(np.uint8), 4 * (end - begin), pa.binary()), "doc_tokens": counts[row], "sequence_id": where // length, "offset": where % length}
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    return placed.mapInArrow(cut, "doc_id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long")
