from pyspark.sql import functions as F

from fieldlake.functions import display as dp


def test_format_bytes(spark):
    cases = {0: "0 B", None: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1 KB", 1536: "1.5 KB", 9537866: "9.1 MB",
             1024**3: "1 GB", 1024**4: "1 TB", 2000 * 1024**4: "2000 TB"}
    df = spark.createDataFrame([(c,) for c in cases], "n bigint")
    assert [r[0] for r in df.select(dp.format_bytes(F.col("n"))).collect()] == list(cases.values())


def test_small_projections(spark):
    df = spark.sql(
        "select 'BC-MA200' id, 10L b, 7L s, array('a','b','c') c, map('a','1','b','2','c','3') v, "
        "map('a','1','b','9','n','x') k, cast(null as timestamp_ntz) u"
    )
    row = df.select(
        dp.display_name(F.col("id")), dp.duplicates_shown(F.col("b"), F.col("s")), dp.duplicates_shown(F.col("s"), F.col("b")),
        dp.sample_values(F.col("c"), F.col("v"), 2), dp.changed_values(F.col("k"), F.col("v")), dp.is_reporting(F.col("u")),
    ).first()
    assert tuple(row) == ("BC MA200", 3, None, {"a": "1", "b": "2"}, {"b": "9", "n": "x"}, False)
