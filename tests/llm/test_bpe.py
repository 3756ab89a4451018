import base64
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from fieldlake.llm.bpe import Encoder, Vocabulary, encode_decode

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", "a", " ", "  ", "   x", "x   ", "x \n y", "\n\n y", "it's we'll I've 's 're ''s ''re '' 'st 'save 'lls 'v", "  's", "\t's", "he'S",
    "日本語 テスト", "a b  c", "12 34five ６７", "!!! '!'s", ".'s", "x\x1cy \x1f z\x85w", "é é", " \r\n" * 5, "\U0001f600\U0001f600 x",
    "aaaa" * 3000, "-" * 9000 + "x", "<|endoftext|>", "​﻿ x", "ǅ ⅷ ²", "\x00 \x00",
]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=800, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab'sre ve\n\t  1!é日 ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def runs(ids, counts):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@pytest.mark.parametrize("limit", [400_000, 10])
def test_ids_equal_the_libraries(limit):
    texts = HARD + random_texts()
    tik, hub = library(), Tokenizer.from_file(JSON)
    hub.encode_special_tokens = True
    ranks, merges = Encoder(Vocabulary.parse(open(RANKS, "rb").read()), limit), Encoder(Vocabulary.parse(open(JSON, "rb").read()), limit)
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        assert runs(*ranks.encode(part)) == [tik.encode_ordinary(t) for t in part]
        assert runs(*merges.encode(part)) == [hub.encode(t, add_special_tokens=False).ids for t in part]


def test_round_trip_with_nulls_repeats_and_clashing_names(spark):
    tik = library()
    rows = [(i, t, "x", b"y") for i, t in enumerate(HARD)] + [(None, "no id", None, None), (7, None, None, None), (7, "again", None, None), (7, "again", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary")
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), bytes(r.decoded)) for r in encode_decode(df, RANKS).collect())
    want = sorted((-1 if i is None else i, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in rows)
    assert got == want


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), RANKS).collect() == []


def test_long_patterns_of_two_letters_are_told_apart():
    texts = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n)) for n in (1024, 2048) for k in (0, 1)]
    assert runs(*Encoder(Vocabulary.parse(open(RANKS, "rb").read())).encode(texts)) == [library().encode_ordinary(t) for t in texts]
