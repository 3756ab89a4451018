"""Operator 1: MinHash document fingerprints.

Words are lower-cased and split at ASCII white space; shingles are five words
(fewer words: the whole sequence).  ``PERMUTATIONS`` universal hash permutations
``a x + b mod 2^32`` run over all shingles of a slice at once in numpy; the low
byte of each minimum makes the signature.  The share of equal positions, less
what chance adds, estimates the Jaccard likeness of two shingle sets.

``fingerprint_edits`` compares each document with its successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.pieces import mix, separate_hashes

SHINGLE, PERMUTATIONS = 5, 256
BUCKET_ROWS, MAX_BUCKETS = 1024, 1 << 16

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SCRAMBLE = np.uint32(0x9E3779B1)
SHIFTS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, text after text, and their number in each text."""
    blobs = [t.lower().encode() for t in texts]
    flat = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    gap = (flat == 0x20) | (flat - np.uint8(9) <= 4)
    change = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    begin, end = change[::2], change[1::2]
    words = separate_hashes(flat, begin, end)
    starts = np.cumsum([0] + [len(b) + 1 for b in blobs])
    counts = np.diff(np.searchsorted(begin, starts))
    firsts = np.cumsum(counts) - counts
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    long = np.flatnonzero(counts >= SHINGLE)
    out = np.zeros(int(shingles.sum()), dtype=np.uint64)
    into = np.cumsum(shingles) - shingles
    with np.errstate(over="ignore"):
        if len(long):
            rolled = sum(words[j : len(words) - SHINGLE + 1 + j] * PLACES[j] for j in range(SHINGLE))
            inside = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(inside, firsts[long], 1)
            np.add.at(inside, firsts[long] + shingles[long], -1)
            target = np.zeros(len(out) + 1, dtype=np.int64)
            np.add.at(target, into[long], 1)
            np.add.at(target, into[long] + shingles[long], -1)
            out[np.cumsum(target[:-1]) > 0] = rolled[np.cumsum(inside[:-1])[: len(rolled)] > 0]
        for k in range(1, SHINGLE):
            short = np.flatnonzero(counts == k)
            out[into[short]] = sum((words[firsts[short] + j] * PLACES[j] for j in range(k)), np.zeros(len(short), dtype=np.uint64)) + np.uint64(k)
    return mix(out), shingles


def signatures(texts: list[str]) -> np.ndarray:
    """A row of one byte of each permutation's minimum for each text; a text without words has all bits set.

    The minimum is multiplied once more and gives its top byte, which depends on all its
    bits; its own top byte would be zero for most long texts, its low byte would follow
    from the low bytes of the hashes.
    """
    hashes, counts = shingle_hashes(texts)
    out = np.full((len(texts), PERMUTATIONS), 0xFF, dtype=np.uint8)
    some = np.flatnonzero(counts)
    if len(some):
        values = (hashes >> np.uint64(32)).astype(np.uint32)
        begin = (np.cumsum(counts) - counts)[some]
        with np.errstate(over="ignore"):
            for k in range(PERMUTATIONS):
                least = np.minimum.reduceat(values * MULTIPLIERS[k] + SHIFTS[k], begin)
                out[some, k] = least * SCRAMBLE >> np.uint32(24)
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of signatures, row by row."""
    chance = 1 / 256
    return np.maximum(0.0, ((one == two).mean(axis=1) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of the next document (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, a row per input row.  The next document is the one
    with the next larger id, after the last the first; null ids stand last, equal
    ids are ordered by their text.  A null text counts as empty.

    Documents meet their successor without a global window: ids that occur cut
    the order into buckets of about ``BUCKET_ROWS`` rows, and the first row of a
    bucket also goes to the bucket before.  At most ``MAX_BUCKETS`` cuts travel, a
    fixed bound; a bucket is streamed, so larger ones need no more memory.
    """
    docs = keyed_text(df, id_col, text_col)
    seen = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least")).first()
    cuts = np.zeros(0, dtype=np.int64)
    if seen.n:
        wanted = min(MAX_BUCKETS, -(-seen.n // BUCKET_ROWS))
        shares = [i / wanted for i in range(1, wanted)]
        found = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("cuts")).first().cuts if shares else []
        cuts = np.unique(np.array([seen.least, *found], dtype=np.int64))
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        last = max(0, len(heads) - 1)
        for batch in batches:
            column = batch.column("doc_id")
            ids, missing = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            bucket = np.where(missing, last, np.searchsorted(heads, ids, side="right") - 1)
            first = np.flatnonzero(~missing & (heads[bucket] == ids)) if len(heads) else np.zeros(0, dtype=np.int64)
            if not len(heads):  # no id at all: one ring of rows in text order
                first = np.arange(batch.num_rows)
            rows = np.append(np.arange(batch.num_rows), first)
            into = np.append(bucket, np.where(bucket[first] == 0, last, bucket[first] - 1))
            extra = np.arange(len(rows)) >= batch.num_rows
            yield pa.record_batch([pa.array(into), pa.array(extra), *batch.take(pa.array(rows)).columns], names=["bucket", "extra", "doc_id", "text"])

    order = ["bucket", "extra", F.col("doc_id").asc_nulls_last(), "text"]
    dealt = docs.mapInArrow(deal, "bucket long, extra boolean, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(compare_neighbours, EDIT_SCHEMA)


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order to results; a row waits for the one after it."""
    waiting: list[tuple] = []
    for batch in slices(batches):
        rows = waiting + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield _compared(rows)
        waiting = rows[-1:]


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last; a row that only closes its bucket has none."""
    texts = [r[3] for r in rows]
    prints = signatures(texts)
    real = [i for i in range(len(rows) - 1) if not rows[i][1]]
    changed = [edited(texts[i], texts[i + 1]) for i in real]
    edits = signatures(changed)
    own, after = prints[real], prints[[i + 1 for i in real]]
    columns = [
        pa.array([rows[i][2] for i in real], pa.int64()),
        pa.array([len(texts[i]) for i in real], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array([r.tobytes().hex() for r in own], pa.string()),
        pa.array([r.tobytes().hex() for r in edits], pa.string()),
        pa.array(likeness(own, edits), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in EDIT_SCHEMA.split(", ")])
