from pyspark.sql import functions as F

from fieldlake.functions import times

TEXTS = [
    "2024-01-05 10:11:12", "2024-01-05T10:11:12", "2024-02-30 10:11:12", "2024-13-01 00:00:00", "2024-01-05 24:00:00", "2024-01-05 23:59:60",
    "0000-01-05 10:11:12", "0001-01-01 00:00:00", "9998-12-31 23:59:59", "2024-01-05 10:11:12\n", " 2024-01-05 10:11:12", '"2024-01-05 10:11:12"',
    "2024-01-05 10:11:12Z", "2024-01-05 10:11:12.5", "2024-01-05x10:11:12", "05/01/2024 10:11:12", "2024-1-5 10:11:12", "2024-01-05", "", "soon", None,
]


def test_plain_times_read_as_by_the_general_way(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for order in ("dmy", "mdy"):
        for zone in (None, "America/Los_Angeles"):
            got = times.with_times(df, "t", wall="w", compare="c", iso="i", date_order=order, naive_zone=zone)
            want = df.select("t", times.parse_datetime(F.col("t"), order).alias("w"), times.datetime_for_compare(F.col("t"), order, zone).alias("c"), times.iso_format(F.col("t"), order).alias("i"))
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_plain_times_skip_the_general_way(spark, monkeypatch):
    """A text without parts still has its readings: the general way would find none for it here."""
    monkeypatch.setattr(times, "_iso_parts", lambda text: F.lit(None).cast("array<string>"))
    monkeypatch.setattr(times, "_wall_clock", lambda text, parts, zone, date_order: F.lit(None).cast("timestamp_ntz"))
    df = spark.createDataFrame([("2024-01-05 10:11:12",)], "t string")
    row = times.with_times(df, "t", compare="c", iso="i").first()
    assert row.c is not None and row.i == "2024-01-05T10:11:12"
