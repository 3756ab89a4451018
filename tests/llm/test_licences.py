import random
import re

import pytest

from fieldlake.llm.licences import BASE_PHRASES, TEMPLATES, Index, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """The base columns, straight from their definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at, labels = WORD.findall(lowered), [], set()
    for phrase, label in BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def texts():
    rng = random.Random(1)
    pool = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "Reserved.", "é", "x1", "\x00", "日本", "-", "\n", "cc by"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [None, "", "cc", "cc by", "...", "ÄCC BY", "cc É by", "GENERAL PUBLIC LICENSE general public license", "x" * 50_000 + " cc by"] + out


def test_base_columns_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "all rights reserved"), (3, "cc by"), (3, "cc by")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, n_words int")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(df).collect()), key=str)
    assert got == sorted(((i is None, i or 0, *brute(t)) for i, t in rows), key=str)


@pytest.mark.parametrize("label, notice, _", TEMPLATES)
def test_every_template_is_found_inside_other_text(label, notice, _):
    rng = random.Random(5)
    noise = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    index = Index(TEMPLATES)
    rows = index.scan([f"{noise()}\n{notice}.\n{noise()}", noise(), notice.upper()])
    assert label in rows[0][5].split(",") and label in rows[2][5].split(",")
    assert rows[1][5] == "" and rows[1][6] == 0.0 and 0 < rows[0][6] <= 1


def test_missing_key_phrase_is_no_match():
    index = Index(TEMPLATES)
    assert index.scan(["Licensed under the Apache License, Version 1.1", "Released under the MIX License"]) == [(8, 0, None, None, "", "", 0.0), (5, 0, None, None, "", "", 0.0)]


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
