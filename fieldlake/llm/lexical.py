"""Operator 12: ranked lexical search over classes of equal bags.

1. Items are dealt to blocks of bounded vocabulary; the terms of one block are broadcast.
2. Every document is cut down to the terms that the block's items have: a row holds its
   length and the counts of those terms.  The table is written once per block.
3. With the corpus counts known, a document is its term counts and its length weight m.
   Documents with the same counts and the same m score alike against every item.  They
   meet by a hash of both and are one class only if both are equal value by value.
4. Each class is scored once.  A task walks from a class's terms to the items that have
   them, so its work follows shared terms, not all pairs of classes and items.
5. A class stands for its members: those with the smallest ids, as many as a result has
   rows.  Of classes in the order of (score, smallest id), the first ``top`` hold the
   first ``top`` documents, so a task keeps no more for an item.

A class may hold a third of all documents: tasks cut it to its ``top`` smallest ids
before the shuffle.  Scores are sums of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm import exact
from fieldlake.llm.arrow import keyed_text, ragged, slices, spans
from fieldlake.llm.staging import stage

TOP, SLOPE = 10, 90
BLOCK_TERMS, BLOCK_ITEMS = 1 << 18, 4096
"""Terms (with repeats over items) and items of a block: this bounds what is broadcast, but for one item with more terms of its own."""
CELLS = 1 << 21
"""Scores (classes x items) and matches that a task holds at once."""

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_runs(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with A-Z lower-cased as bytes; where each term begins and how long it is; the terms of each text."""
    blobs = [t.encode().lower() for t in texts]  # of bytes only A-Z have a lower case
    data = b"\n".join(blobs) + b"\n"
    edge = np.flatnonzero(np.diff(_TERM[np.frombuffer(data, dtype=np.uint8)], prepend=False, append=False))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    starts = np.cumsum([0] + [len(b) + 1 for b in blobs])
    return data, begin, length, np.diff(np.searchsorted(begin, starts))


class TermTable:
    """Numbers of a list of terms, found by their exact bytes."""

    def __init__(self, terms: list[str]):
        coded = [t.encode() for t in terms]
        short = [i for i, t in enumerate(coded) if len(t) <= exact.SHORT]
        self.table = exact.KeyTable(len(short))
        self.table.add(*exact.keys_of([coded[i] for i in short]), np.array(short, dtype=np.int32))
        self.long = {t: i for i, t in enumerate(coded) if len(t) > exact.SHORT}
        self.lengths = np.array(sorted({len(t) for t in self.long}), dtype=np.int64)

    def find(self, data: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each run of ``data``, -1 for other terms."""
        out = np.full(len(begin), -1, dtype=np.int64)
        short = np.flatnonzero(length <= exact.SHORT)
        out[short] = self.table.find(*exact.keys(data, begin[short], length[short]))
        for i in np.flatnonzero(np.isin(length, self.lengths)).tolist():
            out[i] = self.long.get(data[begin[i] : begin[i] + length[i]], -1)
        return out


@dataclass
class Block:
    """Items of a block: for each term the items that have it, one run after another, and the term's weight."""

    item_ids: np.ndarray
    items: np.ndarray
    begin: np.ndarray
    count: np.ndarray
    weight: np.ndarray


def bags(df: DataFrame, table: TermTable) -> DataFrame:
    """``doc_id long, n long, terms array<int>, tfs array<int>``: all terms counted, those of the table kept, by number."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, begin, length, per_text = term_runs(batch.column("text").to_pylist())
            number, size = shared.value.find(data, begin, length), np.int64(max(1, len(shared.value.long) + shared.value.table.size))
            text = np.repeat(np.arange(batch.num_rows), per_text)
            known = number >= 0
            both, tf = np.unique(text[known] * size + number[known], return_counts=True)
            held = np.bincount(both // size, minlength=batch.num_rows)
            columns = [batch.column("doc_id"), pa.array(per_text), ragged((both % size).astype(np.int32), held, pa.list_(pa.int32())), ragged(tf.astype(np.int32), held, pa.list_(pa.int32()))]
            yield pa.record_batch(columns, names=["doc_id", "n", "terms", "tfs"])

    return df.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def classes(rows: DataFrame, top: int) -> DataFrame:
    """``m, terms, tfs, doc_ids``: one row per class of equal bags, with its smallest ids in order."""
    # the hash brings equal bags together; the value columns beside it keep different ones apart
    same = ["hash", "m", "terms", "tfs"]
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id"))
    hashed = rows.select(F.xxhash64("m", "terms", "tfs").alias("hash"), "m", "terms", "tfs", "doc_id")
    kept = hashed.withColumn("place", rank).where(F.col("place") <= top)
    return kept.groupBy(*same).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).drop("hash")


def score_rows(block: Block, m: np.ndarray, held: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Scores of classes against all items of a block, (classes x items)."""
    row = np.repeat(np.arange(len(m)), held)
    tf = tfs.astype(np.int64)
    gain = block.weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    out = np.zeros(len(m) * len(block.item_ids), dtype=np.int64)
    fan = block.count[terms]
    cut = np.flatnonzero(np.diff(np.cumsum(fan) // CELLS, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(terms)], strict=True):
        item = block.items[spans(block.begin[terms[a:b]], fan[a:b])]
        np.add.at(out, np.repeat(row[a:b], fan[a:b]) * len(block.item_ids) + item, np.repeat(gain[a:b], fan[a:b]))
    return out.reshape(len(m), -1)


class Best:
    """The best documents of every item among the classes seen so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)  # a score of 0 is no result
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)

    def take(self, scores: np.ndarray, held: np.ndarray, ids: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        begin = np.cumsum(held) - held
        self.item = np.append(self.item, np.repeat(item, held[row]))
        self.score = np.append(self.score, np.repeat(scores[row, item], held[row]))
        self.doc = np.append(self.doc, ids[spans(begin[row], held[row])])
        order = np.lexsort((self.doc, -self.score, self.item))
        first = np.searchsorted(self.item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - first[self.item[order]]
        full = order[place == self.top - 1]
        self.least[self.item[full]] = self.score[full]
        order = order[place < self.top]
        self.item, self.score, self.doc = self.item[order], self.score[order], self.doc[order]


def score_classes(found: DataFrame, block: Block, top: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's best documents of every item."""
    shared = found.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(shared.value.item_ids), top)
        step = max(1, CELLS // len(shared.value.item_ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                terms, tfs, ids = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs", "doc_ids"))
                held, members = (np.diff(batch.column(c).offsets.to_numpy()) for c in ("terms", "doc_ids"))
                best.take(score_rows(shared.value, batch.column("m").to_numpy(), held, terms, tfs), members, ids)
        yield pa.record_batch([pa.array(shared.value.item_ids[best.item]), pa.array(best.doc), pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return found.mapInArrow(run, "item_id long, doc_id long, score long")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id long, term string``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, begin, length, per_text = term_runs(batch.column("text").to_pylist())
            words = [data[b : b + n].decode() for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            item = np.repeat(batch.column("doc_id").to_numpy(), per_text)
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(words, pa.string())], names=["item_id", "term"])

    return keyed_text(items, id_col, text_col).where("doc_id is not null").mapInArrow(run, "item_id long, term string").distinct()


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slope: int = SLOPE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``top`` highest-scoring documents of every item.

    Returns ``item_id long, rank int, doc_id long, score long``, ranks from 1, equal
    scores by ascending doc_id; documents of score 0 are no results.  An item's terms
    are those of all rows with its id, each once; a row without id takes no part on
    either side and counts nowhere.  Repeated document rows are documents of their own and
    rank next to each other.  Null and empty texts have no terms: such a document is not
    counted, such an item has no rows.  Other columns are not looked at.  An empty table
    on either side gives an empty result.
    """
    spark = docs.sparkSession
    wanted = stage(item_terms(items, item_col, text_col), "lexical-items")
    size = wanted.agg(F.count("*").alias("terms"), F.count_distinct("item_id").alias("items")).first()
    blocks = max(1, -(-size.terms // BLOCK_TERMS), -(-size.items // BLOCK_ITEMS))
    texts = keyed_text(docs, id_col, text_col).where("doc_id is not null")
    results = [_search_block(texts, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), top, slope) for b in range(blocks)]
    results = [r for r in results if r is not None]
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = results[0]
    for other in results[1:]:
        best = best.unionAll(other)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, wanted: DataFrame, top: int, slope: int) -> DataFrame | None:
    rows = wanted.collect()  # bounded by the block
    if not rows:
        return None
    terms = sorted({r.term for r in rows})
    number = {t: i for i, t in enumerate(terms)}
    kept = stage(bags(texts, TermTable(terms)), "lexical-bags")
    total = kept.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total.terms:
        return None
    df = np.zeros(len(terms), dtype=np.int64)
    for r in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
        df[r.term] = r["count"]
    item_ids = np.array(sorted({r.item_id for r in rows}), dtype=np.int64)
    pairs = np.array([(number[r.term], r.item_id) for r in rows], dtype=np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    begin = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    weight = np.floor(1000 * np.log((2 * total.docs + 2) / (2 * df + 1))).astype(np.int64)
    block = Block(item_ids, np.searchsorted(item_ids, pairs[:, 1]), begin[:-1], np.diff(begin), weight)
    m = F.expr(f"{100 - slope} + ({slope} * n * {total.docs}L) div {total.terms}L")
    found = classes(kept.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs"), top)
    return score_classes(found, block, top)
