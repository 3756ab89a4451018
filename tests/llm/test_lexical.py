import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldlake.llm import lexical
from fieldlake.llm.lexical import Best, Block, TermTable, score_rows, search, term_runs

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scored.append((-score, doc))
        out += [(item, k + 1, doc, -s) for k, (s, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"),
    )


WORDS = ["alpha", "Beta", "GAMMA", "déjà", "İx", "7", "a" * 15, "b" * 16, "c" * 40, "d", "日本", "é", "x_y", "it's", "\0z", "\n"]


def corpus(seed, docs=150):
    rng = random.Random(seed)
    rows = [(3 * i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25)))) for i in range(docs)]
    rows += [(3 * i + 1, "Alpha beta, beta") for i in range(60)] + [(3 * i + 2, "beta BETA alpha!") for i in range(40)]
    return rows + [(None, "alpha alpha"), (900, None), (901, ""), (902, "..."), (903, "gamma " * 5000 + "tail"), rows[5], rows[5], (rows[7][0], "alpha d d")]


ITEMS = [(i, " ".join(random.Random(i).choices(WORDS, k=4))) for i in range(25)] + [(50, "alpha"), (50, "gamma alpha"), (51, None), (52, "nowhere"), (None, "alpha"), (53, "c" * 40), (50, "alpha"), (54, "beta beta beta")]


def test_terms_are_the_patterns_matches():
    texts = [*WORDS, "", "aZ09_é-Ü`{|}~\x7f\x80x", " ".join(WORDS)]
    data, begin, length, per_text = term_runs(texts)
    runs = [data[b : b + n].decode() for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
    assert runs == [t for text in texts for t in terms(text)]
    assert per_text.tolist() == [len(terms(t)) for t in texts]
    names = sorted(set(runs))[::2]
    assert TermTable(names).find(data, begin, length).tolist() == [names.index(r) if r in names else -1 for r in runs]


@pytest.mark.parametrize("limits", [(1 << 18, 4096, 1 << 21), (12, 4, 64)])
def test_ranks_against_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("BLOCK_TERMS", "BLOCK_ITEMS", "CELLS"), limits, strict=True):
        monkeypatch.setattr(lexical, name, value)
    docs = corpus(1)
    got = found(search(*frames(spark, docs, ITEMS)).repartition(3))
    assert got == brute(docs, ITEMS)


def test_classes_are_told_apart_by_value_not_by_hash(spark, monkeypatch):
    monkeypatch.setattr(lexical.F, "xxhash64", lambda *a: lexical.F.lit(7).cast("long"))
    docs = corpus(2, 60)
    assert found(search(*frames(spark, docs, ITEMS), top=3)) == brute(docs, ITEMS, 3)


def test_a_class_keeps_its_smallest_ids(spark):
    rows = spark.createDataFrame([(i, 11, [1, 2], [1, 1 + i % 2]) for i in range(500)], "doc_id long, m long, terms array<int>, tfs array<int>")
    got = sorted((tuple(r.tfs), r.doc_ids) for r in lexical.classes(rows.repartition(7), 4).collect())
    assert got == [((1, 1), [0, 2, 4, 6]), ((1, 2), [1, 3, 5, 7])]


def test_best_of_many_ties():
    best, rng = Best(2, 5), np.random.default_rng(1)
    every = []
    for _ in range(20):
        scores = rng.integers(0, 3, (30, 2))
        ids = rng.permutation(10_000)[:60]
        best.take(scores, np.full(30, 2), ids)
        every += [(item, -scores[r, item], ids[2 * r + k]) for r in range(30) for k in (0, 1) for item in (0, 1) if scores[r, item]]
    want = [x for item in (0, 1) for x in sorted(e for e in every if e[0] == item)[:5]]
    assert sorted(zip(best.item, -best.score, best.doc, strict=True)) == sorted(want)


def test_scores_are_exact_integers():
    block = Block(np.array([9]), np.zeros(3, dtype=np.int64), np.arange(3), np.ones(3, dtype=np.int64), np.array([40_000, 1, 7]))
    tf = np.array([1, 2**31 - 1, 3], dtype=np.int32)
    want = sum(w * (10**9 * t // (1000 * t + 8 * 123)) for w, t in zip((40_000, 1, 7), tf.tolist(), strict=True))
    assert score_rows(block, np.array([123]), np.array([3]), np.arange(3), tf).tolist() == [[want]]


@pytest.mark.parametrize("docs, items", [([], []), ([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "b")], [(1, "a")])])
def test_empty_sides(spark, docs, items):
    assert search(*frames(spark, docs, items)).collect() == []


def test_given_tables_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(search(docs, items)) == want and len(want) > 100
