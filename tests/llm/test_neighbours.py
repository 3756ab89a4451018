import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.llm import neighbours
from fieldlake.llm.neighbours import MultiIndex, search

SF = "/root/testdata/sf0.1"


def brute(rows, nearest=20, every=20):
    ids = np.array([i for i, _ in rows])
    data = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, data, strict=True):
        if i % every == 0:
            scores = (data * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:nearest]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    got = found(search(df, F.col("vec_id") % 20 == 0, visit=0.4))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(scores.get((q, i), s) - s) < 1e-12 for q, v in got.items() for i, s in v)


def test_recall_when_the_index_is_used(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_ENTRIES", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    want = brute(rows)
    got = found(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, visit=0.3, centroids=24))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_walk_is_in_order():
    rng = np.random.default_rng(3)
    index = MultiIndex((rng.standard_normal((6, 2)), rng.standard_normal((5, 2))), rng.integers(0, 4, 30))
    first, second = index.halves(rng.standard_normal((1, 4)))
    total = (first[0][:, None] + second[0][None, :]).ravel()
    cells, last = index.walk(first[0], second[0], 25)
    assert np.allclose(total[cells], np.sort(total)[: len(cells)]) and last == total[cells[-1]]
    assert index.counts[cells].sum() >= 25 > index.counts[cells[:-1]].sum()
    assert sorted(index.walk(first[0], second[0], 10**9)[0]) == list(range(30))


def test_copies_bad_vectors_and_ties(spark):
    rng = random.Random(4)
    good = [(i, [float(rng.randint(-3, 3)) for _ in range(3)] + [1.0]) for i in range(60)]
    good += [(100 + i, [1.0, 2.0, 2.0, 1.0]) for i in range(80)]
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (300, []), (None, [1.0] * 4), (320, [1.0, 2.0])]
    rows = good + bad + [good[0], good[70]]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, cell int, score double")
    assert found(search(df, F.col("vec_id") % 20 == 0)) == brute(good)


@pytest.mark.parametrize("rows", [[], [(20, [0.0, 0.0])]])
def test_nothing_usable(spark, rows):
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_a_lone_vector_has_no_neighbour(spark):
    assert search(spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []
