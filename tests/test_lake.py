"""A hand-written lake of the five instruments, rebuilt and browsed."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from fieldlake.functions.rules import INSTRUMENT_RULES, RuleSet
from fieldlake.operators import totals
from fieldlake.plans import browse
from fieldlake.plans.inventory import dashboard_rows, lake_inventory
from fieldlake.plans.silver import build_results, build_silver
from fieldlake.sources import files, silver
from fieldlake.sources.instruments import read_instruments
from fieldlake.sources.reviews import with_item_columns
from fieldlake.sources.tail import list_matches

BC_HEAD = '"Serial","Num","Date / time local",' + ",".join(f'"c{i}"' for i in range(8))
BC_ROW = '"MA200-1","12","2026-03-02T18:00:0%d",' + ",".join(f'"{i},x"' for i in range(8))
NO2_HEAD = "id6,a,b,NO2,e,f,g,h,Timestamp,NO2"
NO2_ROW = "123456,0,0,8.25,1,2,3,4,2026-03-02 18:00:0%d,9"
SMPS_HEAD = "Sample #,DateTime Sample Start," + ",".join(f"d{i}" for i in range(39))
SMPS_ROW = "%d,3/%d/2026 1:05:06," + ",".join("0" for _ in range(39))

OBJECTS = {
    "BC-MA200/bronze/year=2026/month=03/a__1.txt": f"MA200 log\n{BC_HEAD}\n{BC_ROW % 1}\n{BC_ROW % 2}\n{BC_ROW % 1}\n",
    "CO2-LICOR/bronze/year=2026/month=03/2026Apr__1.txt": "2026-4-1\t1:0:0\t400\n2026-4-1\t1:0:1\t401\n",
    "CO2-LICOR/bronze/year=2026/month=03/2026Feb__1.txt": "System_Date_(Y-M-D)\tSystem_Time_(h:m:s)\tCO2\r\n"
    "2026-2-1\t1:0:0\t390\r\n2026-4-1\t1:0:0\t400\r\n\r\n# note\r\n",
    "NEPH-PM25/bronze/year=2026/month=03/n.csv": "﻿Date_Time,PM25,RH\n2026/03/02 18:00:00,5.1,44\n2026/03/02 18:00:01,1_0,44\n"
    "2026/03/02 18:00:02,1d,44\n",
    "NO2-CAPS/bronze/year=2026/month=03/b.dat": f"% made by hand\n{NO2_HEAD}\n{NO2_ROW % 1}\n{NO2_ROW % 2},extra,more\n",
    "NO2-CAPS/bronze/year=2026/month=04/c.dat": f"{NO2_ROW % 2},extra,more\n{NO2_ROW % 3} tail\n",
    "SMPS/bronze/year=2026/month=03/s.csv": f"Sample File,x\n{SMPS_HEAD}\n{SMPS_ROW % (1, 4)}\n{SMPS_ROW % (2, 14)}\n",
    "SMPS/bronze/year=2026/month=03/.keep": "",
}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for key, text in OBJECTS.items():
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    bad = root / "NO2-CAPS/bronze/year=2026/month=04/d.dat"
    bad.write_bytes(b"123456,\xff,0,1,1,2,3,4,2026-03-02 18:00:09,9\n")
    lines = files.scan_bronze_lines(spark, str(root)).withColumn("pos", F.col("pos"))
    path = str(tmp_path_factory.mktemp("silver"))
    results = build_silver(lines, RuleSet(), path, files.scan_bronze_objects(spark, str(root)), partitions=5)
    return {"root": str(root), "path": path, "results": {r.instrument_id: tuple(r)[1:6] for r in results.collect() if r.error is None}, "lines": lines}


def rows_of(spark, lake, instrument):
    return silver.read_silver(spark, lake["path"], instrument).orderBy("source_index").collect()


def test_statistics(lake):
    assert lake["results"] == {
        "BC-MA200": (1, 3, 2, 1, True),
        "CO2-LICOR": (2, 4, 3, 1, True),
        "NEPH-PM25": (1, 2, 2, 0, True),
        "NO2-CAPS": (3, 5, 4, 1, True),
        "SMPS": (1, 2, 2, 0, True),
    }


def test_key_order_decides_first_and_last(spark, lake):
    raws = [r.raw for r in rows_of(spark, lake, "CO2-LICOR")]
    assert raws == ["2026-4-1\t1:0:0\t400", "2026-4-1\t1:0:1\t401", "2026-2-1\t1:0:0\t390"]
    assert [r.source_index for r in rows_of(spark, lake, "CO2-LICOR")] == [0, 1, 2]


def test_headers_and_preambles(spark, lake):
    headers = {r.instrument_id: r.raw for r in silver.read_header(spark, lake["path"]).collect()}
    assert headers["BC-MA200"] == BC_HEAD and headers["NO2-CAPS"] == NO2_HEAD and headers["SMPS"] == SMPS_HEAD
    preamble = silver.read_preamble(spark, lake["path"]).filter("instrument_id = 'BC-MA200'").orderBy("seq").collect()
    assert [r.line for r in preamble] == ["MA200 log", BC_HEAD]


def test_times_and_values(spark, lake):
    first = rows_of(spark, lake, "BC-MA200")[0]
    assert first.ts == datetime(2026, 3, 2, 18, 0, 1) and first["values"]["c0"] == "0,x"
    assert [r.timestamp_iso for r in rows_of(spark, lake, "SMPS")] == ["2026-04-03T01:05:06", "2026-03-14T01:05:06"]
    neph = rows_of(spark, lake, "NEPH-PM25")
    assert [r["values"]["PM25"] for r in neph] == ["5.1", "1_0"]
    wide = rows_of(spark, lake, "NO2-CAPS")[1]["values"]
    # The repeated header name keeps its last value, extra fields are numbered.
    assert wide["NO2"] == "9" and wide["column_11"] == "extra" and wide["column_12"] == "more"


def test_invalid_bytes_become_replacement_characters(spark, lake):
    assert rows_of(spark, lake, "NO2-CAPS")[-1].fields[1] == "�"


def test_rebuild_is_idempotent_and_leaves_other_instruments(spark, lake):
    before = {i: [r.row_key for r in rows_of(spark, lake, i)] for i in RuleSet().instrument_ids}
    build_silver(lake["lines"].filter("instrument_id = 'SMPS'"), RuleSet(), lake["path"])
    assert before == {i: [r.row_key for r in rows_of(spark, lake, i)] for i in RuleSet().instrument_ids}
    idle = build_results(silver.read_silver_stats(spark, lake["path"]), spark.sql("select 'none' instrument_id")).first()
    assert tuple(idle) == ("none", 0, 0, 0, 0, False, None)


def test_a_rebuild_without_data_rows_empties_the_instrument(spark, tmp_path):
    path = str(tmp_path / "silver")
    lines = spark.sql("select 'CO2-LICOR' instrument_id, 'k' object_key, 0L pos, '2026-4-1\\t1:0:0\\t4' line")
    build_silver(lines, RuleSet(), path)
    assert silver.read_silver(spark, path).count() == 1
    result = build_silver(lines.withColumn("line", F.lit("note")), RuleSet(), path).first()
    assert tuple(result) == ("CO2-LICOR", 1, 0, 0, 0, True, None)
    assert silver.read_silver(spark, path).count() == 0


def test_browse_pages_filters_and_reviews(spark, lake):
    table = silver.read_silver(spark, lake["path"])
    keys = [r.row_key for r in rows_of(spark, lake, "NO2-CAPS")]
    items = with_item_columns(spark.createDataFrame(
        [("f1", "flag", "NO2-CAPS", "time_range", "2026-03-02T18:00:02Z", "2026-03-02 18:00:03", None, None),
         ("c1", "correction", "NO2-CAPS", "selected_rows", None, None, keys[1], {"NO2": "7"})],
        "_s3_key string, type string, instrument_id string, scope string, start_time string, end_time string, row_key string, "
        "corrected_values map<string,string>",
    ))
    rows = browse.browse_records(table, items, "NO2-CAPS").collect()
    assert [r.status for r in rows] == ["normal", "corrected", "flagged", "normal"]
    assert rows[1].timestamp == "2026-03-02 18:00:02" and len(rows[1].flags) == 1
    assert rows[2].timestamp_iso == "2026-03-02T18:00:03" and rows[2]["values"]["NO2"] == "9 tail"
    ranged = browse.browse_records(table, items, "NO2-CAPS", start="2026-03-02 18:00:02", end="nonsense", order="desc").collect()
    assert [r.source_index for r in ranged] == [3, 2, 1]
    answer = browse.browse_response(table, silver.read_header(spark, lake["path"]), items, "NO2-CAPS", limit=2, cursor=2)
    assert answer["columns"].first()[0][3] == "NO2" and answer["next_cursor"].first()[0] == 4
    assert answer["review_object_count"].first()[0] == 2 and answer["rows"].count() == 2


def test_inventory_of_the_lake(spark, lake, tmp_path):
    config = tmp_path / "instruments.json"
    entries = ", ".join(
        f'{{"id": "{r.instrument_id}", "ingestion_type": "growing_file", "data_glob": "x/*.txt"}}' for r in INSTRUMENT_RULES
    )
    config.write_text('{"instruments": [' + entries + ', {"id": "IDLE", "data_glob": ["a", "b"], "active": false}]}')
    instruments = read_instruments(spark, str(config))
    got = {r.instrument_id: (r.ordinal, r.globs, r.active) for r in instruments.collect()}
    assert got["BC-MA200"] == (0, ["x/*.txt"], True) and got["IDLE"] == (5, ["a", "b"], False)
    objects = files.scan_bronze_objects(spark, lake["root"])
    stats = silver.read_silver_stats(spark, lake["path"])
    per_object = objects.join(stats.select("instrument_id", F.col("data_rows_total").alias("data_rows")), "instrument_id")
    stock = lake_inventory(instruments, per_object.filter("instrument_id <> 'CO2-LICOR'"), stats)
    rows = {r.id: r for r in stock.collect()}
    assert rows["SMPS"].bronze_size == len(OBJECTS["SMPS/bronze/year=2026/month=03/s.csv"])
    assert rows["IDLE"].bronze_rows == 0 and rows["IDLE"].silver_rows is None and rows["IDLE"].last_update is None
    shown = {r.id: r for r in dashboard_rows(stock).collect()}
    assert shown["BC-MA200"].name == "BC MA200" and shown["BC-MA200"].duplicates_shown == 1
    assert shown["IDLE"].last_update_text == "NO DATA" and not shown["IDLE"].reporting
    nothing = stock.filter("id = 'IDLE'")
    assert totals.latest_instrument(nothing).first()["latest_instrument"] == "NONE"
    assert totals.system_status(nothing).first()[0] == "DEGRADED"


def test_ties_in_the_latest_update_go_to_the_lower_ordinal(spark):
    stock = spark.sql(
        "select * from values ('b', 1, timestamp_ntz'2026-01-01 00:00:00'), ('a', 2, timestamp_ntz'2026-01-01 00:00:00'), "
        "('c', 0, null) t(id, ordinal, last_update)"
    )
    assert totals.latest_instrument(stock).first()["latest_instrument"] == "b"


def test_month_to_date_is_half_open(spark):
    costs = spark.sql(
        "select * from values (timestamp_ntz'2026-03-01 00:00:00', 1.005), (timestamp_ntz'2026-03-04 23:59:59', 2.0), "
        "(timestamp_ntz'2026-03-05 00:00:00', 4.0), (timestamp_ntz'2026-02-28 00:00:00', 8.0) t(date, amount)"
    )
    assert float(totals.mtd_total(costs, "2026-03-05").first()[0]) == pytest.approx(3.01)
    assert float(totals.mtd_total(costs, "2026-03-01").first()[0]) == 0.0


def test_discovery_skips_quarantine_folders_and_missing_globs(spark, tmp_path):
    for name in ("a/x.csv", "a/y.csv", "a/_quarantine/z.csv", "a/deep/w.csv"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1\n")
    base = str(tmp_path)
    found = files.discover_files(spark, [f"{base}/a/*", f"{base}/a/*.csv", f"{base}/none/*", f"{base}/a/_quarantine/*.csv"])
    assert [r.path.split("/a/")[1] for r in found.collect()] == ["x.csv", "y.csv"]
    assert files.discover_files(spark, f"{base}/none/*").count() == 0


def test_discovery_sees_what_the_growing_file_source_sees(spark, tmp_path):
    names = ["_named.csv", "b.csv", "w[1].csv", ".hidden.csv", "n_quarantine.csv", "_quarantine/q.csv", "sub.csv/inner.csv"]
    for name in names:
        path = tmp_path / "x" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12\n")
    base = f"{tmp_path}/x"
    found = files.discover_files(spark, [f"{base}/*.csv", f"file://{base}/b.csv", f"file:{base}/b*.csv", f"{base}/_quarantine/*"]).collect()
    assert [(r.path, r.size) for r in found] == [(f"file:{base}/{n}", 3) for n in ("_named.csv", "b.csv", "n_quarantine.csv", "w[1].csv")]
    assert {r.path.removeprefix("file:") for r in found} == set(list_matches(f"{base}/*.csv"))
    assert [r.path for r in files.discover_files(spark, [f"{base}/.h*", f"{base}/w[1].csv"]).collect()] == [f"file:{base}/.hidden.csv", f"file:{base}/w[1].csv"]
    assert [r.path for r in files.discover_files(spark, f"{tmp_path}/*/_n*.csv").collect()] == [f"file:{base}/_named.csv"]
    assert files.discover_files(spark, []).collect() == []
    landed = {r.modified_at for r in found}
    assert all(abs((m - datetime.now(UTC).replace(tzinfo=None)).total_seconds()) < 600 for m in landed)
