"""Streaming Silver over many batches: merged folders, pruned look-ups, unchanged lines."""

import pytest

from fieldlake.functions.rules import InstrumentRule, RuleSet
from fieldlake.sources import versions
from fieldlake.sources.bronze import BRONZE_SCHEMA
from fieldlake.streaming import silver

RULES = RuleSet([InstrumentRule("A", 1, patterns={0: "^[0-9]"})])


def batch_of(spark, lines):
    rows = [(f"k{i:03}", i, line, "f", 0, 1, None, "A", "2026", "01", "r", 0) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, BRONZE_SCHEMA).coalesce(1)


def lines_in(spark, path):
    return sorted(r.line for r in silver.read_streamed_lines(spark, path).collect())


def test_merged_batches_keep_their_lines_and_few_folders(spark, tmp_path):
    path, seen = str(tmp_path / "lines"), set()
    for n in range(10):
        lines = [f"{n // 2},2026-01-0{n % 3 + 1}", f"{n},undated", "7,again"]  # some are there already
        seen.update(lines)
        silver.append_batch(batch_of(spark, lines), "run", n, RULES, path)
        assert lines_in(spark, path) == sorted(seen)
        if n % 3 == 2:
            before = silver.read_streamed_lines(spark, path)
            left = silver.compact(spark, path)
            assert lines_in(spark, path) == sorted(seen)
            assert sorted(r.line for r in before.collect()) == sorted(seen)  # a reader that began before goes on
            assert left <= 3
    assert silver.compact(spark, path) <= 3
    assert silver.compact(spark, path) <= 3  # nothing to merge, replaced folders go
    folders = list((tmp_path / "lines").glob("instrument_id=*/content_month=*/run_id=*/batch_id=*"))
    assert {f.name for f in folders} <= {"batch_id=9"}
    assert lines_in(spark, path) == sorted(seen)
    # The newest batch may run again, also after it was passed over by a merge.
    silver.append_batch(batch_of(spark, ["9,undated", "3,2026-01-01"]), "run", 9, RULES, path)
    assert lines_in(spark, path) == sorted(seen)


def test_two_compactions_and_one_that_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines")
    assert silver.compact(spark, path) == 0  # nothing there yet
    for n in range(3):
        silver.append_batch(batch_of(spark, [f"{n},2026-02-01"]), "run", n, RULES, path)
    with monkeypatch.context() as patch:
        patch.setattr(versions, "_commit", lambda *a: False)
        with pytest.raises(RuntimeError, match="committed first"):
            silver.compact(spark, path)
    assert lines_in(spark, path) == ["0,2026-02-01", "1,2026-02-01", "2,2026-02-01"]
    assert silver.compact(spark, path) == 1
    silver.append_batch(batch_of(spark, ["0,2026-02-01", "5,2026-02-01"]), "other", 0, RULES, path)
    assert lines_in(spark, path) == ["0,2026-02-01", "1,2026-02-01", "2,2026-02-01", "5,2026-02-01"]


def test_a_look_up_reads_the_folders_of_its_labels_only(spark, tmp_path):
    path = str(tmp_path / "lines")
    silver.append_batch(batch_of(spark, [f"{m},2026-0{m}-01" for m in range(1, 10)] + [f"{m},x" for m in range(60)]), "run", 0, RULES, path)
    undated = {r.content_month for r in silver.read_streamed_lines(spark, path).where("content_month like 'none-%'").collect()}
    assert 8 <= len(undated) <= 16
    labels = spark.sql("select 'A' instrument_id, '2026-03' content_month")
    labels.write.parquet(str(tmp_path / "labels"))
    found = silver.of_labels(silver.read_streamed_lines(spark, path), spark.read.parquet(str(tmp_path / "labels")))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.line for r in found.collect()] == ["3,2026-03-01"]
