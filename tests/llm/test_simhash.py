import random

import numpy as np
import pytest
import xxhash

from fieldlake.llm import golay
from fieldlake.llm.components import components
from fieldlake.llm.simhash import fingerprint, keep_one, links, near_duplicates


def test_golay_keys_meet_at_one_error():
    words = np.random.default_rng(5).integers(0, 1 << 23, 5000)
    found = golay.keys(words)
    assert ((found[:, :1] == golay.keys(words)[:, :1]).all()) and set((found >= 0).sum(axis=1)) == {1, 6}
    for bit in range(23):
        assert (golay.keys(words ^ 1 << bit) == found[:, :1]).any(axis=1).all()


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", " \n", "One", "one TWO", "É a b É c d", "a b c a b c a b c"] + ["".join(rng.choice("abC Ä\n\t") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    assert fingerprint(None) == 0


def random_prints(n, seed):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for base in list(out)[: n // 2]:
        for _ in range(rng.randint(1, 4)):
            flips = rng.sample(range(64), rng.randint(1, 5))
            out.add(base ^ sum(1 << b for b in flips))
    base = rng.getrandbits(64)
    out |= {base ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(1, 64, 5)}
    return sorted(out)


@pytest.mark.parametrize("distance", [3, 1])
def test_links_equal_all_pairs(spark, distance):
    values = np.array(random_prints(300, distance), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {(r.a, r.b) for r in links(df, distance).collect()}
    signed = np.sort(values.view(np.int64))
    near = np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None, :]) <= distance
    want = {(int(signed[i]), int(signed[j])) for i, j in zip(*np.nonzero(near), strict=True) if i < j}
    assert got == want and len(want) > 50


def union_find(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(80)] + [(5, 5)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {k: v for k, v in union_find([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)]
    out = [(i, t) for i, t in enumerate(texts)]
    for i in range(40):
        edited = texts[i % 5].split()
        edited[rng.randrange(300)] = "new"
        out.append((100 + i, " ".join(edited)))
    return out + [(7, texts[3]), (7, texts[3]), (None, texts[1]), (300, None), (301, " "), (None, "alone without id")]


def brute(data):
    prints = [fingerprint(t) for _, t in data]
    group = list(range(len(data)))
    changed = True
    while changed:
        changed = False
        for i in range(len(data)):
            for j in range(len(data)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    least = {g: min((d for (d, _), h in zip(data, group, strict=True) if h == g and d is not None), default=None) for g in group}
    return prints, group, least


def test_classes_against_all_pairs(spark):
    data = rows()
    prints, group, least = brute(data)
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, fp int, component_id int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted(((d is None, d or 0, p, least[g]) for (d, _), p, g in zip(data, prints, group, strict=True)), key=str)


def test_one_row_of_each_class_stays(spark):
    data = rows()
    _, group, least = brute(data)
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, copies int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(group)) and sorted(str(i) for i, _ in got) == sorted(str(least[g]) for g in set(group))
    assert keep_one(df.limit(0)).collect() == [] and near_duplicates(df.limit(0)).collect() == []


def test_kept_rows_keep_columns_of_any_name(spark):
    rows = [(i, f"one two three four five {i // 2}", 10 + i, 20 + i, 30 + i, 40 + i) for i in range(6)] + [(0, "one two three four five 0", 10, 20, 30, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_hash long, kept_id long, Kept_Hash long, kept_copies long")
    kept = keep_one(df, shingle=3, max_distance=0)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[4]]
