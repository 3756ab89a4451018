import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from fieldlake.llm.repeats import LEAST, NO_ID
from fieldlake.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def smallest_of_each_class(docs):
    prints = {d: fingerprint(t) for d, t in docs.items()}
    group = {d: d for d in docs}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d for d in docs if root(d) == d}


def without_repeats(docs):
    first = {}
    blobs = {d: t.encode() for d, t in docs.items()}
    for d in sorted(blobs):
        for k in range(len(blobs[d]) - LEAST + 1):
            first.setdefault(blobs[d][k : k + LEAST], d)
    out = {}
    for d, b in blobs.items():
        gone = bytearray(len(b))
        for k in range(len(b) - LEAST + 1):
            if first[b[k : k + LEAST]] < d:
                gone[k : k + LEAST] = b"\x01" * LEAST
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return out


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:3]:
        before = as_dict(docs)
        result = function(spark, docs, SF)
        assert result.columns == columns
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = as_dict(docs)
        sizes.append(len(after))
        if name == "language":
            assert all(before[d] == t for d, t in after.items()) and len(after) >= 0.98 * len(before)  # ties of two-word texts
        elif name == "near-duplicates":
            assert after.keys() == smallest_of_each_class(before) and all(before[d] == t for d, t in after.items())
        else:
            assert after == without_repeats(before)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert sizes[2] < sizes[1]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()
    tokens = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in as_dict(docs).items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == tokens


def test_registered_and_runs_as_a_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-duplicates", "repeats", "packing"]
    registered = __spark_entry__.queries()
    assert registered["pipeline"] is corpus_pipeline.run and sum(n.startswith("op") and n[2].isdigit() for n in registered) == 13
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_edge_rows_pass_every_stage(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the cat and the dog " * 30, "en", None, None), (4, "der hund und die katze " * 30, "de", "s", 5), (None, "the cat sat " * 20, None, "s", 9), (3, "the cat and the dog " * 30, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES[:3]:
        docs = function(spark, docs, SF)
    assert sorted((r.doc_id if r.doc_id is not None else NO_ID) for r in docs.collect()) == [3, 4, NO_ID]
    for data in (docs, docs.limit(0)):
        assert corpus_pipeline.STAGES[3][1](spark, data, SF).count() == (3 if data is docs else 0)
