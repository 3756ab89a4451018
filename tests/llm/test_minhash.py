import hashlib
import random

import numpy as np
import pytest

from fieldlake.llm import minhash
from fieldlake.llm.minhash import edited, fingerprint_edits, likeness, shingle_hashes, signatures


def shingle_list(text):
    words = text.lower().encode().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def some_texts(n=60, seed=4):
    rng = random.Random(seed)
    words = ["a", "b", "Ä", "cat", "\x00", "x\x1cy", "é"]
    return ["", " ", "a", "A b", "\n"] + ["".join(rng.choice(words) + rng.choice("  \n\t") for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_shingle_hashes_name_shingles():
    texts, names = some_texts(), {}
    hashes, counts = shingle_hashes(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        expected = shingle_list(text)
        assert len(expected) == n
        for s, h in zip(expected, hashes[at : at + n].tolist(), strict=True):
            assert names.setdefault(s, h) == h
        at += n
    assert len(set(names.values())) == len(names)


def test_likeness_estimates_jaccard():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.0, 0.3, 0.9):
        one = [rng.choice(words) for _ in range(1500)]
        two = one[: int(1500 * share)] + [rng.choice(words) for _ in range(1500 - int(1500 * share))]
        a, b = set(shingle_list(" ".join(one))), set(shingle_list(" ".join(two)))
        pair = signatures([" ".join(one), " ".join(two)])
        assert abs(minhash.likeness(pair[:1], pair[1:])[0] - len(a & b) / len(a | b)) < 0.12


def expected(rows):
    order = sorted(((i is None, i or 0, t or "") for i, t in rows))
    out = []
    for k, (missing, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        change = edited(text, following)
        prints = signatures([text, change, following])
        near = minhash.likeness(prints[:1], prints[1:2])[0], minhash.likeness(prints[:1], prints[2:])[0]
        out.append((missing, i, len(text), hashlib.sha256(change.encode()).hexdigest(), prints[0].tobytes().hex(), prints[1].tobytes().hex(), *near))
    return sorted(out)


CASES = {
    "many": [(3 * i % 500, t) for i, t in enumerate(some_texts(300))],
    "ties": [(5, "b b"), (5, "a"), (5, "a"), (9, None), (None, "no id"), (None, None), (-3, "x" * 5000)],
    "one": [(1, "alone in the world")],
    "no ids": [(None, "a b"), (None, "c d")],
}


@pytest.mark.parametrize("name", CASES)
def test_edits_against_a_sorted_list(spark, monkeypatch, name):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 7)
    df = spark.createDataFrame([(i, t, True, "z") for i, t in CASES[name]], "doc_id long, text string, extra boolean, bucket string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprint_edits(df).collect())
    assert got == expected(CASES[name])
    assert all(0 <= x <= 1 for r in got for x in r[6:]) and np.isfinite([r[6] for r in got]).all()


def test_empty_table(spark):
    assert fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_texts_that_differ_have_fingerprints_that_differ():
    prints = signatures([f"word{i}" for i in range(2000)])
    assert len({p.tobytes() for p in prints}) == 2000
    assert likeness(prints[:-1], prints[1:]).max() < 0.2


def test_long_patterns_of_two_letters_are_different_words():
    morse = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(4096)) for k in (0, 1)]
    hashes, _ = shingle_hashes(morse)
    assert hashes[0] != hashes[1]
