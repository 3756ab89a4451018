"""Operator 4: SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (22 bits), B and C (21 each).  If two
fingerprints differ in at most three bits, then by the pigeonhole principle

- A and B hold at most one error each: fuzzy keys of A and of B agree, or
- A holds two or more: one of B, C has none and the other at most one, or
- B holds two or more: one of A, C has none and the other at most one.

A fuzzy key is a Golay codeword index; see ``golay``.  One side of the join brings
the primary keys (five rows a fingerprint), the other all keys within reach (about
fifty), and every candidate is verified on its 64 bits.  The join is between
distinct fingerprints: copies of a text are one row before it starts, and a
fingerprint has at most 43,744 others within three bits, so links grow with the
fingerprints, not with the square of a group.

All joins are merge joins by hint.  Spark takes the fifty rows of a fingerprint for
the bytes of one, and a small file for a small table in memory, so joins by size
would gather in the driver what grows with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm import golay
from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.components import components
from fieldlake.llm.staging import bounded_batches, fresh, stage

SHINGLE, MAX_DISTANCE, SEED = 3, 3, 42
WIDTHS = (22, 21, 21)
ROWS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned 64-bit number: A-Z lower-cased, ASCII white space between words, repeats counted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)), strict=False)] or [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), dtype=np.uint64, count=len(joined))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(joined)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id long, fp long``: a row per input row, the fingerprint as a signed number; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    out, rest = [], fps.view(np.uint64)
    for width in WIDTHS:
        out.append((rest & np.uint64((1 << width) - 1)).astype(np.int64))
        rest = rest >> np.uint64(width)
    return out


def keys(fps: np.ndarray, reach: bool) -> tuple[np.ndarray, np.ndarray]:
    """Join keys and the row that each belongs to: primary keys only, or all keys within reach of one error."""
    a, b, c = _segments(fps)
    fuzzy = [golay.keys(x) if reach else golay.keys(x)[:, :1] for x in (a, b, c)]
    both = np.where((fuzzy[0][:, :, None] < 0) | (fuzzy[1][:, None, :] < 0), -1, fuzzy[0][:, :, None] << 12 | fuzzy[1][:, None, :])
    groups = [both.reshape(len(fps), -1)]
    for kind, (exact, near) in enumerate(((b, 2), (c, 1), (a, 2), (c, 0)), start=1):
        groups.append(np.where(fuzzy[near] < 0, -1, kind << 40 | exact[:, None] << 12 | fuzzy[near]))
    table = np.concatenate(groups, axis=1)
    row, column = np.nonzero(table >= 0)
    return table[row, column], row


def _keyed(fps: DataFrame, reach: bool, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                values = batch.column(0).slice(begin, ROWS).to_numpy()
                found, row = keys(values, reach)
                yield pa.record_batch([pa.array(found), pa.array(values[row])], names=["key", name])

    return fps.select("fp").mapInArrow(run, f"key long, {name} long")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``a long, b long``: the pairs of distinct fingerprints within ``max_distance`` (at most 3) bits; ``fps`` holds each once."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("the segments cover at most three differing bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return _keyed(fps, False, "a").hint("merge").join(_keyed(fps, True, "b"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def component_of(marked: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``fp long, component long`` of every fingerprint in ``marked``."""
    vertices = stage(marked.select("fp").distinct(), "simhash-fingerprints").select("fp", F.xxhash64("fp").alias("vertex"))
    linked = links(vertices, max_distance).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    return vertices.hint("merge").join(components(linked), "vertex", "left").select("fp", F.coalesce("component", "vertex").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id long, fp long, component_id long``, a row per input row.

    A null text has no words, like an empty one: fingerprint zero, linked like
    any other.  A null id keeps its row and never names a component, whose id is
    null if it has no other.  Repeated rows stay repeated.  An empty table gives
    an empty result.  Other columns are not looked at.
    """
    marked = stage(fingerprints(df, id_col, text_col, shingle), "simhash-documents")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = stage(firsts.hint("merge").join(component_of(marked, max_distance), "fp"), "simhash-components")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.hint("merge").join(least, "component").select("fp", "component_id")
    return marked.hint("merge").join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``df``, all columns, that stay if one row of each component is kept.

    The smallest id stays (null ids last), of rows with one id the one with the
    smaller content hash, and of wholly equal rows one.  A null or empty text has the
    fingerprint zero, like any other text without words.  Columns may have any name.  An
    empty table stays empty.
    """
    bounded_batches(df.sparkSession)
    names, content = df.columns, F.xxhash64(*df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("content"), pa.array(found.view(np.int64))], names=["doc_id", "content", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), content.alias("content"))
    marked = stage(rows.mapInArrow(run, "doc_id long, content long, fp long"), "simhash-rows")
    distinct = marked.groupBy("doc_id", "content", "fp").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "content", "copies")
    # per fingerprint first, so that a component with very many rows meets only as one row for each
    best = distinct.groupBy("fp").agg(F.min(order).alias("best"))
    per_component = best.hint("merge").join(component_of(marked, max_distance), "fp").groupBy("component").agg(F.min("best").alias("best"))
    row, name, same, copies = fresh(df, "row_hash", "kept_id", "kept_hash", "kept_copies")
    winners = per_component.select(F.col("best.doc_id").alias(name), F.col("best.content").alias(same), F.col("best.copies").alias(copies))
    winners = stage(winners, "simhash-kept")
    kept = df.withColumn(row, content).hint("merge").join(winners, F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.col(row) == F.col(same)))
    once = kept.where(F.col(copies) == 1).select(*names)
    return once.unionByName(kept.where(F.col(copies) > 1).select(*names).dropDuplicates())
