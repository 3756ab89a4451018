"""Operator 10: stupid-backoff scores from relational n-gram counts.

1. Documents are written as blocks: a row holds some megabytes of compressed texts.
2. Each block is exploded to its distinct n-grams (orders 1 and 2) with their
   counts, dealt by a hash of the n-gram to the buckets of the count table.
   Counting inside a block first keeps a very frequent n-gram at one entry a block.
3. A bucket adds up its n-grams over all blocks and joins the totals to the
   entries of every block.
4. Totals go back to their block, where each document is scored and summed.

A document is scored against all others: its own counts are taken off.  A word w
after v has the score c(vw)/c(v) if the others have vw, else ``BACKOFF`` times
c(w)/N; a word that the others lack counts as one in N + 1.  The first word of a
document has its unigram score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.pieces import mix, separate_hashes
from fieldlake.llm.staging import stage

BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
BLOCKS_PER_BUCKET = 2
BIGRAM = np.uint64(0xD1B54A32D192ED03)


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) of lower-cased texts, and their number in each."""
    flat = np.frombuffer(b"\n".join(blobs) + b"\n", dtype=np.uint8)
    gap = (flat == 0x20) | (flat - np.uint8(9) <= 4)
    change = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    begin, end = change[::2], change[1::2]
    starts = np.cumsum([0] + [len(b) + 1 for b in blobs])
    return separate_hashes(flat, begin, end), np.diff(np.searchsorted(begin, starts))


def grams_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and hash of the bigram that ends there of every word, its text, and whether it is a text's first."""
    words, counts = word_hashes(blobs)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, dtype=bool)
    with np.errstate(over="ignore"):
        before = np.concatenate((words[:1], words[:-1]))
        pairs = mix(before * BIGRAM + words + np.uint64(1))
    return words, pairs, text, first


def entries(words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block, sorted, and their counts."""
    return np.unique(np.concatenate((words, pairs[~first])), return_counts=True)


def bucketed(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams ^ BIGRAM) % np.uint64(buckets)).astype(np.int64)


def squeeze(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed bytes; like bytes stand together, so that small and near numbers take little room."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in _gathered(batches):
        blobs = [t.lower().encode() for t in batch.column("text").to_pylist()]
        words = int(word_hashes(blobs)[1].sum())
        columns = [pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([[len(b) for b in blobs]], pa.list_(pa.int64())), pa.array([press.compress(b"".join(blobs))], pa.binary()), pa.array([words], pa.int64())]
        yield pa.record_batch(columns, names=["ids", "sizes", "packed", "n_words"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BLOCK_BYTES`` from smaller ones."""
    waiting, size = [], 0
    for batch in slices(batches, "text", BLOCK_BYTES // 4):
        waiting.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _texts(packed: bytes, sizes: list[int]) -> list[bytes]:
    joined, out, at = zstandard.ZstdDecompressor().decompress(packed), [], 0
    for n in sizes:
        out.append(joined[at : at + n])
        at += n
    return out


def _counted(table: pa.Table) -> pa.Table:
    """A bucket of the count table: totals of its n-grams over all blocks, joined to each block's entries."""
    grams = [np.cumsum(unsqueeze(g), dtype=np.uint64) for g in table.column("grams").to_pylist()]
    counts = np.concatenate([unsqueeze(c) for c in table.column("counts").to_pylist()])
    _, back = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(back, weights=counts).astype(np.uint64)[back]
    ends = np.cumsum([len(g) for g in grams])
    out = [squeeze(t) for t in np.split(totals, ends[:-1])]
    return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "totals"])


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", backoff: float = BACKOFF) -> DataFrame:
    """``doc_id long, n_words long, log_score double, mean_score double, n_backed_off long``, a row per input row.

    ``log_score`` is the sum of the natural logarithms of the words' scores,
    ``mean_score`` that by the words.  A null or empty text has no words, score 0
    and a null mean.  Rows are documents of their own, repeated ones too: a copy
    is among the others.  Null ids are kept; an empty table gives no rows.
    """
    blocks = keyed_text(df, id_col, text_col).mapInArrow(_blocks, "ids array<long>, sizes array<long>, packed binary, n_words long")
    blocks = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    whole = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    buckets, words_in_all = max(1, -(-whole.n // BLOCKS_PER_BUCKET)), whole.words

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "packed")), strict=True):
                words, pairs, _, first = grams_of(_texts(packed, sizes))
                grams, counts = entries(words, pairs, first)
                bucket = bucketed(grams, buckets)
                order = np.argsort(bucket, kind="stable")
                used, begin = np.unique(bucket[order], return_index=True)
                parts = zip(np.split(grams[order], begin[1:]), np.split(counts[order], begin[1:]), strict=True) if len(used) else []
                data = [(squeeze(np.diff(g, prepend=np.uint64(0))), squeeze(c)) for g, c in parts]
                columns = [pa.array(used, pa.int64()), pa.array([block] * len(used), pa.int64()), pa.array([g for g, _ in data], pa.binary()), pa.array([c for _, c in data], pa.binary())]
                yield pa.record_batch(columns, names=["bucket", "block", "grams", "counts"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ids", "sizes", "packed", "answers")
        for batch in batches:
            for ids, sizes, packed, answers in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                yield _scored(ids, _texts(packed, sizes), answers or [], buckets, words_in_all, backoff)

    asked = blocks.select("block", "sizes", "packed").mapInArrow(explode, "bucket long, block long, grams binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_counted, "block long, bucket long, totals binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))
    joined = blocks.join(answers, "block", "left").select("ids", "sizes", "packed", "answers")
    return joined.mapInArrow(finish, "doc_id long, n_words long, log_score double, mean_score double, n_backed_off long")


def _scored(ids: list, blobs: list[bytes], answers: list[dict], buckets: int, words_in_all: int, backoff: float) -> pa.RecordBatch:
    words, pairs, text, first = grams_of(blobs)
    grams, _ = entries(words, pairs, first)
    bucket, totals = bucketed(grams, buckets), np.zeros(len(grams), dtype=np.float64)
    for answer in answers:
        totals[bucket == answer["bucket"]] = unsqueeze(answer["totals"])
    n = np.bincount(text, minlength=len(blobs))

    def others(where: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Count of each n-gram in all documents but the one it stands in; zero at the other words."""
        out, at = np.zeros(len(words)), np.searchsorted(grams, hashes[where])
        _, back, own = np.unique(text[where] * len(grams) + at, return_inverse=True, return_counts=True)
        out[where] = totals[at] - own[back]
        return out

    single, pair = others(np.arange(len(words)), words), others(np.flatnonzero(~first), pairs)
    context = np.concatenate((single[:1], single[:-1]))
    rest = (words_in_all - n)[text].astype(np.float64)
    unigram = np.where(single > 0, single / np.maximum(rest, 1), 1 / (rest + 1))
    seen = (pair > 0) & ~first
    value = np.where(seen, pair / np.maximum(context, 1), np.where(first, 1.0, backoff) * unigram)
    total = np.bincount(text, weights=np.log(value), minlength=len(blobs)).astype(np.float64)
    mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
    back_off = np.bincount(text, weights=~seen & ~first, minlength=len(blobs)).astype(np.int64)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(total), mean, pa.array(back_off)], names=["doc_id", "n_words", "log_score", "mean_score", "n_backed_off"])
