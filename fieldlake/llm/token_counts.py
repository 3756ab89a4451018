"""Operator 11: token counts through vocabulary strings that encode alone as one token.

Before any document is read, every string of the vocabulary is proven or refuted:
its bytes go through all merges, and it counts as whole only if one token is left.
(Being in the vocabulary is not enough: an earlier merge can take a byte away from
it.)  A pre-token that equals a whole string is one token; it is looked up by its
exact bytes and never merged.  Only the rest goes through the merges, each distinct
pre-token once as long as its count is remembered.

Strings of special tokens are cut out first, as the library does by default; each is
one token, and the text on either side is split on its own.

Work is per document: no shuffle.  Memory is bounded by one slice of text and by the
remembered counts, which start anew at ``REMEMBERED`` pre-tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldlake.llm import exact
from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.bpe import Vocabulary, merge_pieces, share_vocabulary
from fieldlake.llm.pieces import bounds

REMEMBERED = 400_000
LONG_BYTES = 16 << 20
"""Bytes of remembered pre-tokens longer than a key."""


def special_strings(content: bytes) -> list[str]:
    """Contents of the tokens that the library cuts out of texts before it splits them."""
    spec = json.loads(content)
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError("only byte-level BPE without normalizer and prefix space is counted")
    if any(spec["model"].get(k) for k in ("ignore_merges", "dropout", "byte_fallback", "end_of_word_suffix", "continuing_subword_prefix")):
        raise ValueError("a setting of this BPE model is not supported")
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take their surroundings with them are not supported")
    return [t["content"] for t in added]


def whole_tokens(vocabulary: Vocabulary) -> list[bytes]:
    """The vocabulary strings that the merges turn into one token, proven by merging each of them."""
    strings = [t for t in vocabulary.tokens if t]
    _, counts = merge_pieces(vocabulary, strings)
    return [t for t, n in zip(strings, counts.tolist(), strict=True) if n == 1]


class Counter:
    """Counts tokens of slices of texts."""

    def __init__(self, content: bytes, limit: int = REMEMBERED):
        self.vocabulary, self.limit = Vocabulary.parse(content), limit
        special = special_strings(content)
        # of strings that begin at one place the library takes the longest
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        proven = whole_tokens(self.vocabulary)
        short = [t for t in proven if len(t) <= exact.SHORT]
        self.whole = exact.KeyTable(len(short))
        self.whole.add(*exact.keys_of(short), np.ones(len(short), dtype=np.int32))
        self.whole_long = {t for t in proven if len(t) > exact.SHORT}
        self._forget()

    def _forget(self) -> None:
        self.seen, self.seen_long, self.long_bytes = exact.KeyTable(1024), {}, 0

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and how many pre-tokens of it were proven whole."""
        found = [self.special.findall(t) if self.special else [] for t in texts]
        if not any(found):
            return self._count(texts)
        parts = [self.special.split(t) if f else [t] for t, f in zip(texts, found, strict=True)]
        tokens, whole = self._count([p for ps in parts for p in ps])
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        cut = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.add.reduceat(tokens, begins) + cut, np.add.reduceat(whole, begins)

    def _count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, begin, end, per_text = bounds(texts)
        at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        data = joined.encode()
        start, length = at[begin], at[end] - at[begin]
        counts = np.zeros(len(begin), dtype=np.int64)
        whole = np.zeros(len(begin), dtype=bool)
        short = np.flatnonzero(length <= exact.SHORT)
        one, two = exact.keys(data, start[short], length[short])
        hit = self.whole.find(one, two) > 0
        counts[short[hit]], whole[short[hit]] = 1, True
        rest = short[~hit]
        counts[rest] = self._short(data, start[rest], length[rest], one[~hit], two[~hit])
        long = np.flatnonzero(length > exact.SHORT)
        pieces = [data[b : b + n] for b, n in zip(start[long].tolist(), length[long].tolist(), strict=True)]
        whole[long] = [p in self.whole_long for p in pieces]
        counts[long] = self._long(pieces)
        text = np.repeat(np.arange(len(texts)), per_text)
        return tuple(np.bincount(text, weights, len(texts)).astype(np.int64) for weights in (counts, whole))

    def _short(self, data: bytes, start: np.ndarray, length: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        if self.seen.size > self.limit:
            self._forget()
        counts = self.seen.find(one, two)
        new = np.flatnonzero(counts < 0)
        if len(new):
            first, back = exact.distinct(one[new], two[new])
            first = new[first]
            words = [data[b : b + n] for b, n in zip(start[first].tolist(), length[first].tolist(), strict=True)]
            _, merged = merge_pieces(self.vocabulary, words)
            self.seen.add(one[first], two[first], merged.astype(np.int32))
            counts[new] = merged[back]
        return counts

    def _long(self, pieces: list[bytes]) -> list[int]:
        if self.long_bytes > LONG_BYTES:
            self.seen_long, self.long_bytes = {}, 0
        new = [p for p in dict.fromkeys(pieces) if p not in self.seen_long and p not in self.whole_long]
        fresh = dict(zip(new, merge_pieces(self.vocabulary, new)[1].tolist(), strict=True)) if new else {}
        counts = [1 if p in self.whole_long else fresh.get(p) or self.seen_long[p] for p in pieces]
        kept = [p for p in new if len(p) <= LONG_BYTES]
        self.seen_long.update((p, fresh[p]) for p in kept)
        self.long_bytes += sum(len(p) + 100 for p in kept)
        return counts


_counters: dict[bytes, Counter] = {}


def counter_of(content: bytes) -> Counter:
    """The counter of a vocabulary file's content; built, proofs included, once in each Python worker."""
    key = hashlib.sha256(content).digest()
    if key not in _counters:
        _counters[key] = Counter(content)
    return _counters[key]


RESULT = "doc_id long, n_bytes long, n_tokens long, n_whole long"


def count_tokens(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by a byte-level BPE tokenizer JSON, without added special tokens.

    Returns ``doc_id long, n_bytes long, n_tokens long, n_whole long``, a row per input
    row; ``n_whole`` counts the pre-tokens that the proof covers.  Repeated rows stay
    repeated, a null id stays null, a null or empty text has no bytes and no tokens, a
    text of any length is counted whole.  Columns of other names are not looked at.  An
    empty table gives an empty result.  A tokenizer with other parts fails at once.
    """
    content = share_vocabulary(df, vocabulary_path)
    special_strings(content.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(content.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            tokens, whole = counter.count(texts)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, pa.array(tokens), pa.array(whole)], names=["doc_id", "n_bytes", "n_tokens", "n_whole"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, RESULT)
