import math
import random
from collections import Counter

import pytest

from fieldlake.llm import lm
from fieldlake.llm.lm import score


def brute(rows, backoff=0.4):
    docs = [(t or "").lower().encode().split() for _, t in rows]
    ones, twos = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:], strict=False))
    out = []
    for (i, _), d in zip(rows, docs, strict=True):
        own1, own2 = Counter(d), Counter(zip(d, d[1:], strict=False))
        rest = sum(ones.values()) - len(d)
        total, backed = 0.0, 0
        for k, w in enumerate(d):
            c = ones[w] - own1[w]
            unigram = c / rest if c else 1 / (rest + 1)
            pair = twos[d[k - 1], w] - own2[d[k - 1], w] if k else 0
            if pair:
                total += math.log(pair / (ones[d[k - 1]] - own1[d[k - 1]]))
            else:
                backed += k > 0
                total += math.log(unigram * (backoff if k else 1.0))
        out.append((i is None, i or 0, len(d), backed, total, total / len(d) if d else None))
    return sorted(out, key=lambda r: r[:5])


def rows():
    rng = random.Random(6)
    words = [f"W{i}" for i in range(30)] + ["é", "x\x1cy"]
    out = [(i, rng.choice(" \n").join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    return out + [(7, out[7][1]), (7, out[7][1]), (None, "w1 w2"), (None, None), (200, ""), (201, " \n"), (202, "lonely"), (203, "w1 " * 3000)]


@pytest.mark.parametrize("block", [4 << 20, 500])
def test_scores_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(*r, 1, "b") for r in rows()], "doc_id long, text string, n_words int, block string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_backed_off, r.log_score, r.mean_score) for r in score(df).collect()), key=lambda r: r[:5])
    want = brute(rows())
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9)
        assert (a[5] is None and b[5] is None) or math.isclose(a[5], b[5], rel_tol=1e-9)


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, "alone here")]])
def test_small_tables(spark, data):
    got = score(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data) and all(r.log_score <= 0 for r in got)
