"""Operator 5: language identification by compression.

A text is encoded with one raw-content zstandard dictionary per language; the
language whose dictionary gives the fewest bytes wins, and the relative gap to
the next one is the margin.  A narrow margin is a rejection.

Fitting looks at a bounded, deterministic sample of the labelled rows: for each
language the ``SAMPLE_TEXTS`` rows with the smallest hash of their id, at most
``SAMPLE_CHARS`` code points of each, up to ``DICTIONARY_BYTES`` in all.  What is
sent to the executors is a dictionary for each language label.  Prediction is
per document, reads the whole text, and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.arrow import keyed_text, slices
from fieldlake.llm.staging import bounded_batches

SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 128, 2000, 1 << 16
LANGUAGES = 256
LEVEL, CHUNK_BYTES = 6, 2048
MIN_MARGIN = 0.001
UNKNOWN = "und"
CARRIER = bytes(np.random.default_rng(1).integers(33, 64, 512, dtype=np.uint8))
"""Signs without letters that go before every text: a block that is compressed anyway shows differences of a few bytes, which a block of two words on its own does not."""

_NO_LETTERS = regex.compile(r"\P{L}+")


def normalise(text: str) -> str:
    """Lower-cased words of letters, one blank between them."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def held_out(id_col: str = "doc_id"):
    """Rows kept from fitting: crc32 of the id as text leaves 2 by 4.  A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass
class LanguageModel:
    """Raw dictionary content of each language."""

    content: dict[str, bytes]
    level: int = LEVEL
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"content": self.content, "level": self.level, "_ready": []}

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes of the whole text under each language, in name order, less those of the carrier alone."""
        if not self._ready:
            for name in sorted(self.content):
                shared = zstandard.ZstdCompressionDict(self.content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=self.level)
                press = zstandard.ZstdCompressor(dict_data=shared, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._ready.append((press, len(press.compress(CARRIER + b" "))))
        # a chunk starts from the dictionary alone, so that a long text does not drown it
        text = CARRIER + b" " + text + b" "
        chunks = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
        return np.array([max(1, sum(len(c.compress(x)) for x in chunks) - alone) for c, alone in self._ready], dtype=np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Best language and margin in 0 to 1; ``und`` and 0 without a letter or without languages."""
        words = normalise(text or "")
        if not words or not self.content:
            return UNKNOWN, 0.0
        names, sizes = sorted(self.content), self.sizes(words.encode())
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return names[0], 1.0
        best, second = int(sizes[order[0]]), int(sizes[order[1]])
        return names[order[0]], 1.0 - best / second


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> LanguageModel:
    """Learn a dictionary per language from a bounded sample of rows that have a language and a text.

    The ``languages`` names with the most such rows are learned (ties: the smaller
    name), from the first ``SAMPLE_CHARS`` code points of ``sample_texts`` texts each, in
    the order of a hash of their id; so a column full of stray names neither floods the
    driver nor the model.  Rows with a null name, or a null or empty text, teach nothing;
    repeated rows count as they are; without any row the model knows no language.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(F.length("text") > 0, F.lit(False)))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    rows = rows.join(F.broadcast(common), "lang", "left_semi")
    # each task keeps its own first rows of a language before anything is shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= sample_texts).collect()
    content: dict[str, bytes] = {}
    for row in sorted(chosen, key=lambda r: (r.lang, r.rank)):
        words = normalise(row.text).encode()
        room = dictionary_bytes - len(content.get(row.lang, b""))
        if words and room > 0:
            content[row.lang] = content.get(row.lang, b"") + words[: room - 1] + b" "
    return LanguageModel(content)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id long, lang_pred string, score double, rejected boolean``, a row per input row.

    ``score`` is the margin; ``rejected`` marks a margin below ``min_margin`` and
    ``und`` (a null or empty text, or one without a letter).  Ties go to the
    smaller language name and are rejected.  Repeated rows and null ids are kept as
    they are; other columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield classify(shared.value, batch, min_margin)

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def classify(model: LanguageModel, batch: pa.RecordBatch, min_margin: float) -> pa.RecordBatch:
    found = [model.predict(t) for t in batch.column("text").to_pylist()]
    names = [n for n, _ in found]
    scores = np.array([s for _, s in found], dtype=np.float64)
    rejected = (scores < min_margin) | (np.array(names, dtype=object) == UNKNOWN)
    return pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Rows of ``df``, all their columns, without those that the model rejects.

    Null and empty texts, and those without a letter, go; whole texts are read however
    long.  Ties are rejected.  Repeated rows stay or go alike, null ids do not matter,
    columns may have any name, and an empty table stays empty.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    index = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = [shared.value.predict(t) for t in batch.column(index).to_pylist()]
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_margin for n, s in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
