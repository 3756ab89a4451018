"""Operator 2: byte-level BPE encoding and decoding in padded numpy matrices.

The distinct pieces of a slice of documents are bucketed by length into padded
matrices of token ids.  In each round every row merges its leftmost pair of
minimum rank; pairs are looked up in an open-addressed hash table; the merged
row is compacted by one column, and rows without a pair left drop out.

Work is per document, so there is no shuffle: memory is bounded by one slice of
text and by a cache of encoded pieces that starts anew when it is full.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldlake.llm.arrow import keyed_text, ragged, slices, spans
from fieldlake.llm.pieces import split

NONE = np.int32(2**31 - 1)
CACHE_PIECES = 800_000
MATRIX_CELLS = 1 << 18
BLOCK = 1024


class Vocabulary:
    """Token bytes, pair ranks and their hash table, built from a public vocabulary file's content."""

    def __init__(self, tokens: list[bytes | None], pairs: np.ndarray, merged: np.ndarray):
        self.tokens = tokens
        ids = {t: i for i, t in enumerate(tokens) if t is not None}
        self.whole: dict[bytes, int] | None = None
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.merged = merged.astype(np.int32)
        self._fill(pairs)

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """A rank file (``base64 rank`` lines) or a tokenizer JSON with a byte-level BPE model."""
        return cls._from_json(json.loads(content)) if content.lstrip()[:1] == b"{" else cls._from_ranks(content)

    @classmethod
    def _from_ranks(cls, content: bytes) -> Vocabulary:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        pairs = [(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        # a rank file orders a pair by the id of what it becomes
        out = cls(_by_id(ids), table, np.arange(max(ids.values()) + 1))
        out.whole = ids
        return out

    @classmethod
    def _from_json(cls, spec: dict) -> Vocabulary:
        model = spec["model"]
        letters = _letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        raw, pairs, merged = model["vocab"], [], []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append((raw[left], raw[right], rank))
            merged.append(raw[left + right])
        return cls(_by_id(ids), np.array(pairs, dtype=np.int64).reshape(-1, 3), np.array(merged, dtype=np.int32))

    def _fill(self, pairs: np.ndarray) -> None:
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys, waiting = pairs[:, 0] << 20 | pairs[:, 1], np.arange(len(pairs))
        slot = self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[waiting[free]]  # of several for one slot, the last stays
            won = self.keys[slot] == keys[waiting]
            self.ranks[slot[won]] = pairs[waiting[won], 2]
            waiting, slot = waiting[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the vocabulary has no such merge (or a side is padding)."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64) & 0xFFFFF
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot_ = slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot_]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot_[hit]]
            open_ = open_[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), NONE, out)


def _by_id(ids: dict[bytes, int]) -> list[bytes | None]:
    tokens: list[bytes | None] = [None] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    return tokens


def _letters() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write for it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Encodes slices of texts; keeps the ids of pieces it has met, by their hash."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE_PIECES):
        self.vocabulary, self.limit = vocabulary, limit
        self._forget()

    def _forget(self) -> None:
        self.known, self.start = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.count, self.pool = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        pieces = split(texts)
        hashes, where, back = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != hashes) if len(self.known) else np.arange(len(hashes))
        if len(new):
            words = [pieces.joined[b:e].encode() for b, e in zip(pieces.begin[where[new]].tolist(), pieces.end[where[new]].tolist(), strict=True)]
            ids, counts = merge_pieces(self.vocabulary, words)
            order = np.argsort(known := np.append(self.known, hashes[new]), kind="stable")
            self.start = np.append(self.start, len(self.pool) + np.cumsum(counts) - counts)[order]
            self.count = np.append(self.count, counts)[order]
            self.known, self.pool = known[order], np.append(self.pool, ids)
        at = np.searchsorted(self.known, hashes)[back]
        counts = self.count[at]
        ends = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(pieces.per_text))]
        return self.pool[spans(self.start[at], counts)], np.diff(ends)


def merge_pieces(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, one after another, and their counts."""
    names, sizes, values = [], [], []  # of finished rows, in the order in which they finish

    def finish(rows: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        names.append(rows)
        sizes.append(counts)
        values.append(ids)

    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    whole = np.array([vocabulary.whole.get(w, -1) for w in words], dtype=np.int32) if vocabulary.whole else np.full(len(words), -1, dtype=np.int32)
    known = np.flatnonzero(whole >= 0)
    finish(known, np.ones(len(known), dtype=np.int64), whole[known])
    by_length = np.flatnonzero(whole < 0)
    by_length = by_length[np.argsort(lengths[by_length], kind="stable")]
    sorted_lengths, begin = lengths[by_length], 0
    while begin < len(by_length):
        # rows of nearly one length share a matrix of bounded size
        width = int(sorted_lengths[begin])
        end = int(np.searchsorted(sorted_lengths, width + max(1, width // 8), side="right"))
        end = min(end, begin + max(1, MATRIX_CELLS // int(sorted_lengths[end - 1])))
        rows = by_length[begin:end]
        if width > 4 * BLOCK:
            for r in rows:
                ids = _merge_long(vocabulary, words[r])
                finish(np.array([r]), np.array([len(ids)]), ids)
        else:
            _merge_matrix(vocabulary, [words[r] for r in rows], rows, finish)
        begin = end
    name, size = np.concatenate(names), np.concatenate(sizes)
    start, counts = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
    start[name], counts[name] = np.cumsum(size) - size, size
    return np.concatenate(values)[spans(start, counts)], counts


def _merge_matrix(vocabulary: Vocabulary, words: list[bytes], names: np.ndarray, finish: Callable) -> None:
    width = max(map(len, words))
    ids = np.full((len(words), width), -1, dtype=np.int32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ids[np.arange(width) < sizes[:, None]] = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ranks = vocabulary.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), width - 1)
    while True:
        if ranks.shape[1]:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            done = best == NONE
        else:
            done = np.ones(len(ids), dtype=bool)
        if done.any():
            finish(names[done], sizes[done], ids[done][np.arange(ids.shape[1]) < sizes[done][:, None]])
            keep = ~done
            names, ids, ranks, sizes = names[keep], ids[keep], ranks[keep], sizes[keep]
            if not len(ids):
                return
            at, best = at[keep], best[keep]
        rows = np.arange(len(ids))
        ids[rows, at] = vocabulary.merged[best]
        sizes -= 1
        # compaction: what stands right of the merged pair moves one column to the left
        width = ids.shape[1]
        right = np.arange(width - 1) > at[:, None]
        ids = np.where(right, ids[:, 1:], ids[:, :-1])
        shifted = np.full((len(ids), width - 1), NONE, dtype=np.int32)
        shifted[:, : width - 2] = ranks[:, 1:]
        ranks = np.where(right[:, : width - 2], shifted[:, : width - 2], ranks[:, : width - 2])
        for offset in (-1, 0):
            place = at + offset
            ok = (place >= 0) & (place < width - 2)
            r, p = rows[ok], place[ok]
            ranks[r, p] = vocabulary.rank(ids[r, p], ids[r, p + 1])


def _merge_long(vocabulary: Vocabulary, word: bytes) -> np.ndarray:
    """One long row: the same rounds, the leftmost minimum found through minima of blocks of pairs."""
    ids = vocabulary.byte_ids[np.frombuffer(word, dtype=np.uint8)]
    n = len(ids)
    blocks = -(-n // BLOCK)
    ranks = np.full(blocks * BLOCK, NONE, dtype=np.int32)
    ranks[: n - 1] = vocabulary.rank(ids[:-1], ids[1:])
    ranks = ranks.reshape(blocks, BLOCK)
    least = ranks.min(axis=1)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    alive = np.ones(n, dtype=bool)
    while True:
        block = int(least.argmin())
        if least[block] == NONE:
            return ids[alive]
        i = block * BLOCK + int(ranks[block].argmin())
        j = int(after[i])
        ids[i], alive[j] = vocabulary.merged[least[block]], False
        nxt, prev = int(after[j]), int(before[i])
        after[i] = nxt
        if nxt < n:
            before[nxt] = i
        lefts, rights, places = [], [], []
        if prev >= 0:
            lefts, rights, places = [ids[prev]], [ids[i]], [prev]
        if nxt < n:
            lefts, rights, places = [*lefts, ids[i]], [*rights, ids[nxt]], [*places, i]
        flat = ranks.reshape(-1)
        flat[[i, j]] = NONE
        if places:
            flat[places] = vocabulary.rank(np.array(lefts), np.array(rights))
        touched = list({p // BLOCK for p in (i, j, *places)})
        least[touched] = ranks[touched].min(axis=1)


_encoders: dict[bytes, Encoder] = {}


def encoder_of(content: bytes) -> Encoder:
    """The encoder of a vocabulary file's content, built once in each Python worker; it keeps its cache between tasks."""
    key = hashlib.sha256(content).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(Vocabulary.parse(content))
    return _encoders[key]


def share_vocabulary(df: DataFrame, path: str):
    """The vocabulary file's content as a broadcast: its size is that of a vocabulary, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and the bytes that these ids decode to.

    Returns ``doc_id long, ids array<int>, decoded binary``, a row per input row:
    repeated rows stay repeated, a null id stays null, a null or empty text has
    no ids and no bytes.  Columns of other names are not looked at.  An empty
    table gives an empty result.
    """
    content = share_vocabulary(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(content.value)
        for batch in slices(batches):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            decoded = decode_ids(encoder.vocabulary, ids, counts)
            yield pa.record_batch([batch.column("doc_id"), ragged(ids, counts, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bytes of each run of ids."""
    tokens, out, begin, flat = vocabulary.tokens, [], 0, ids.tolist()
    for count in counts.tolist():
        out.append(b"".join([tokens[i] for i in flat[begin : begin + count]]))
        begin += count
    return out
