import zlib

import pytest
from pyspark.sql import functions as F

from fieldlake.llm.language import fit, held_out, identify, keep_identified
from fieldlake.llm.queries import op5_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op5_language(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(judged) / len(judged) > 0.96
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def frame(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en"), (2, "der hund und die katze auf der matte", "de"), (3, None, "en"), (4, "", "de"), (5, "123 !!", "en"), (6, "the dog and the cat", None), (None, "the mat", "en"), (1, "the cat sat on the mat and the dog", "en")]
    return spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_defined_cases(spark):
    df = frame(spark)
    got = identify(df, fit(df)).collect()
    assert len(got) == 8
    assert [r for r in got if r.lang_pred == "und"] and {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5}
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (1, 2)} == {(1, "en"), (2, "de")}
    kept = keep_identified(df, fit(df))
    assert kept.columns == df.columns and kept.where(F.col("doc_id").isin(3, 4, 5)).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "some words", None)]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(df, fit(df)).collect()] == ["und"] * len(rows)


def test_prediction_ignores_source_and_id(spark):
    df = frame(spark)
    model = fit(df)
    moved = df.withColumn("doc_id", F.col("doc_id") + 100).withColumn("lang", F.lit("zz"))
    assert sorted(r.score for r in identify(moved, model).collect()) == sorted(r.score for r in identify(df, model).collect())
    assert df.where(held_out()).count() <= 8


def test_stray_names_are_not_learned(spark):
    rows = [(i, f"some words of text {i}", "en" if i % 2 else "fr") for i in range(40)] + [(100 + i, f"stray {i}", f"x{i:03d}") for i in range(60)]
    rows += [(200, "nothing", None), (201, None, "en"), (202, "", "x000"), (203, "again", "x001")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(fit(df, languages=3).content) == ["en", "fr", "x001"]
    assert sorted(fit(df, languages=4).content) == ["en", "fr", "x000", "x001"]
    every = fit(df)
    assert len(every.content) == 62
    assert {n: every.content[n] for n in ("en", "fr")} == {n: c for n, c in fit(df, languages=2).content.items()}
    empty = fit(df.where("doc_id < 0"))
    assert empty.content == {} and keep_identified(df, empty).collect() == []
