import json

import numpy as np
import public_tokenizers
import pytest
from test_bpe import HARD, JSON, random_texts
from tokenizers import Tokenizer

from fieldlake.llm import exact
from fieldlake.llm.bpe import Vocabulary
from fieldlake.llm.token_counts import Counter, count_tokens, special_strings, whole_tokens

SPECIAL = ["<|endoftext|>", "a<|endoftext|>", "<|endoftext|> b  <|endoftext|><|endoftext|>x", "  <|endoftext|>  ", "<|endoftext|", "it's\n<|endoftext|>'s"]
MORSE = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("limit", [400_000, 10])
def test_counts_equal_the_librarys(library, limit):
    texts = HARD + SPECIAL + MORSE + random_texts() + ["abcdefghijklmnopqrstuvwxyz" * 40, "x" * 15, "x" * 16, "x" * 17]
    counter = Counter(open(JSON, "rb").read(), limit)
    for begin in range(0, len(texts), 70):
        part = texts[begin : begin + 70]
        assert counter.count(part)[0].tolist() == sizes(library, part)


def test_proof_holds_for_every_string_of_the_vocabulary(library):
    vocabulary = Vocabulary.parse(open(JSON, "rb").read())
    proven = set(whole_tokens(vocabulary))
    shown = [t.decode() for t in vocabulary.tokens if t is not None and t.decode(errors="replace").encode() == t]
    alone = [t for t in shown if len(library.pre_tokenizer.pre_tokenize_str(t)) == 1]
    assert len(alone) > 40_000
    assert [t.encode() in proven for t in alone] == [n == 1 for n in sizes(library, alone)]


def test_a_string_that_an_earlier_merge_breaks_is_refuted():
    spec = json.loads(open(JSON).read())
    small = {k: v for k, v in spec["model"]["vocab"].items() if len(k) == 1}
    top = max(small.values())
    small |= {"bc": top + 1, "ab": top + 2, "abc": top + 3}
    spec["model"] |= {"vocab": small, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    content = json.dumps(spec).encode()
    assert b"abc" not in whole_tokens(Vocabulary.parse(content)) and b"bc" in whole_tokens(Vocabulary.parse(content))
    assert Counter(content).count(["abc", "bc", "abcbc"])[0].tolist() == [2, 1, 3]


def test_keys_tell_all_short_strings_apart():
    strings = sorted({b"", b"\0", b"\0\0", *(bytes([i % 7] * n) for i in range(7) for n in range(16)), b"a" * 15, b"a" * 14 + b"\0"})
    one, two = exact.keys_of(strings)
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len(strings)
    table = exact.KeyTable()
    for half in (slice(0, 50), slice(50, None)):
        table.add(one[half], two[half], np.arange(len(strings), dtype=np.int32)[half])
    assert table.find(one, two).tolist() == list(range(len(strings)))
    assert table.find(*exact.keys_of([b"nothing", b"q"])).tolist() == [-1, -1]
    rng = np.random.default_rng(2)
    many = [rng.bytes(int(n)) for n in rng.integers(0, 5, 5000)]
    first, back = exact.distinct(*exact.keys_of(many))
    assert len(first) == len(set(many)) and all(many[first[b]] == m for b, m in zip(back.tolist(), many, strict=True))


def test_rows_nulls_long_texts_and_clashing_names(spark, library):
    long = "word " * 200_000 + "z" * 50_000
    rows = [(i, t, 1, 2) for i, t in enumerate(HARD + SPECIAL)] + [(None, "no id", 0, 0), (7, None, 0, 0), (7, "again", 0, 0), (7, "again", 0, 0), (8, long, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df, JSON).collect())
    counts = sizes(library, [t or "" for _, t, _, _ in rows])
    want = sorted((-1 if i is None else i, len((t or "").encode()), n) for (i, t, _, _), n in zip(rows, counts, strict=True))
    assert got == want


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON).collect() == []


def test_other_tokenizers_fail_at_once(spark):
    with pytest.raises(ValueError):
        special_strings(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
