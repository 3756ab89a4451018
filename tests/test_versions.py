"""Published versions: what readers see while builds fail, meet and are cleaned up."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldlake.functions.rules import InstrumentRule, RuleSet
from fieldlake.plans import silver as plan
from fieldlake.sources import silver, versions

RULES = RuleSet([], default=InstrumentRule("*", 2, patterns={0: "^d"}, timestamp_columns=("t",)))
NAMES = ["a", "b", "c"]


def lake_lines(spark, names, rows=3, tag=""):
    data = [(i, f"o{i}", n, "k,v" if n == 0 else f"d{n}{tag},{n}") for i in names for n in range(rows + 1)]
    return spark.createDataFrame(data, "instrument_id string, object_key string, pos bigint, line string")


def raws(spark, path):
    out = {}
    for r in silver.read_silver(spark, path).orderBy("instrument_id", "source_index").collect():
        out.setdefault(r.instrument_id, []).append(r.raw)
    return out


def test_a_build_that_fails_between_two_writes_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    plan.build_silver(lake_lines(spark, ["a"]), RULES, path)
    before, headers = raws(spark, path), silver.read_header(spark, path).count()
    written = []

    def failing(df, root, table, build):
        written.append(table)
        raise OSError("disk")

    monkeypatch.setattr(silver, "write_table", failing)
    results = plan.build_silver(lake_lines(spark, ["a"], tag="x"), RULES, path).collect()
    monkeypatch.undo()
    assert written and {r.error for r in results} == {"disk"} and not any(r.written for r in results)
    assert raws(spark, path) == before and silver.read_header(spark, path).count() == headers
    assert {r.instrument_id for r in silver.read_build_errors(spark, path).collect()} == {"a"}
    plan.build_silver(lake_lines(spark, ["a"], tag="x"), RULES, path)
    assert raws(spark, path)["a"] == ["d1x,1", "d2x,2", "d3x,3"] and silver.read_build_errors(spark, path).count() == 0


def test_readers_see_nothing_before_the_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        plan.build_silver(lake_lines(spark, ["a"]), RULES, path)
    assert silver.read_silver(spark, path).collect() == [] and silver.read_silver_stats(spark, path).collect() == []


def test_failing_instruments_stand_alone(spark, tmp_path):
    path = str(tmp_path / "lake")
    plan.build_silver(lake_lines(spark, NAMES), RULES, path)
    bad = F.col("instrument_id").isin("b") & (F.col("pos") == 2)
    lines = lake_lines(spark, NAMES, rows=2, tag="n").withColumn("line", F.when(bad, F.col("line").cast("int").cast("string")).otherwise(F.col("line")))
    results = {r.instrument_id: r for r in plan.build_silver(lines, RULES, path).collect()}
    assert {i for i, r in results.items() if r.error} == {"b"} and "CAST_INVALID_INPUT" in results["b"].error
    got = raws(spark, path)
    assert got["a"] == got["c"] == ["d1n,1", "d2n,2"] and got["b"] == ["d1,1", "d2,2", "d3,3"]
    stats = {r.instrument_id: r.data_rows_unique for r in silver.read_silver_stats(spark, path).collect()}
    assert stats == {"a": 2, "b": 3, "c": 2}


def test_two_builds_that_commit_at_once_both_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    plan.build_silver(lake_lines(spark, ["a"]), RULES, path)
    real, taken = versions._commit, []

    def slow(session, root, number, token):
        if not taken:  # another build takes this number first
            taken.append(number)
            monkeypatch.setattr(versions, "_commit", real)
            plan.build_silver(lake_lines(session, ["b"]), RULES, path)
        return real(session, root, number, token)

    monkeypatch.setattr(versions, "_commit", slow)
    plan.build_silver(lake_lines(spark, ["c"]), RULES, path)
    assert taken == [2] and versions.commits(spark, path) == [1, 2, 3]
    assert sorted(raws(spark, path)) == ["a", "b", "c"]
    assert not versions._commit(spark, path, 3, "late")


def test_old_versions_are_read_until_they_are_removed(spark, tmp_path):
    path = str(tmp_path / "lake")
    for tag in ("1", "2", "3"):
        plan.build_silver(lake_lines(spark, ["a", "b"] if tag == "1" else ["a"], tag=tag), RULES, path)
    first = versions.manifest(spark, path, 1)
    old = versions.read_live(spark, path, "rows", silver.SILVER_SCHEMA, first.filter("instrument_id = 'a'"))
    assert {r.raw for r in old.collect()} == {"d11,1", "d21,2", "d31,3"}
    removed = versions.vacuum(spark, path, silver.TABLES, keep=1)
    assert len(removed) == 4 and raws(spark, path) == {"a": ["d13,1", "d23,2", "d33,3"], "b": ["d11,1", "d21,2", "d31,3"]}


def test_pages_leave_out_row_groups(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    monkeypatch.setattr(silver, "ROW_GROUP_BYTES", 64 * 1024)
    lines = spark.sql("select 'a' instrument_id, 'o' object_key, id pos, concat('d', id, ',', repeat(sha2(string(id), 512), 4)) line from range(20000)")
    plan.build_silver(lines, RULES, path)
    rows = silver.read_silver(spark, path, "a").filter("source_index between 12000 and 12099")
    assert rows.count() == 100
    found = rows.collect()
    assert [r.pos for r in sorted(found, key=lambda r: r.source_index)] == list(range(12000, 12100))
    assert "GreaterThanOrEqual(source_index,12000)" in rows._jdf.queryExecution().toString()
    met = total = 0
    for name in glob.glob(f"{path}/rows/build=*/instrument_id=a/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index("source_index")
        for g in range(meta.num_row_groups):
            bounds = meta.row_group(g).column(at).statistics
            total += 1
            met += bounds.min <= 12099 and bounds.max >= 12000
    assert total > 20 and met <= 2
