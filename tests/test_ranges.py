import random

import pytest
from pyspark.sql import DataFrameWriter
from test_reviews import BASE

from fieldlake.functions.rules import InstrumentRule, RuleSet
from fieldlake.sources import bronze, tail
from fieldlake.streaming import silver


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, handle, seen):
        self.handle, self.seen = handle, seen

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()

    def seek(self, at):
        self.handle.seek(at)

    def read(self, n):
        self.seen.append(n)
        return self.handle.read(n)


def test_a_range_reads_itself_and_the_rest_of_its_last_line(tmp_path, monkeypatch):
    path, seen, size = tmp_path / "a.txt", [], 40_000
    rng = random.Random(3)
    lines = ["x" * int(10 ** rng.uniform(0, 2.5)) for _ in range(20_000)] + ["y" * 300_000, "", "z"]
    path.write_text("".join(f"{line}\n" for line in lines))
    real = tail._filesystem

    class Files:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, local):
            return Counted(self.inner.open_input_file(local), seen)

    monkeypatch.setattr(tail, "_filesystem", lambda p: (Files(real(p)[0]), real(p)[1]))
    end = path.stat().st_size
    got = []
    for part in tail.split_range(str(path), 0, end, size):
        before = len(seen)
        got += [line for batch in tail.read_range(part) for line in batch.column("line").to_pylist()]
        if part.end < end - 600_000:
            assert sum(seen[before:]) <= 1 + size + tail.PROBE_BYTES
    assert got == lines


@pytest.mark.parametrize("split", [64 * 1024, tail.SPLIT_BYTES])
def test_the_number_of_tasks_does_not_grow_with_the_bytes(split):
    files = [(str(n), 0, 10_000_000 + n) for n in range(40)]
    parts = tail.cut_tasks(files, split, 16)
    assert 16 <= len(parts) <= 40
    ranges = [r for t in parts for r in t.ranges]
    assert max(r.end - r.begin for r in ranges) <= split
    assert max(sum(r.end - r.begin for r in t.ranges) for t in parts) <= 26_000_000
    for path, _, end in files:
        own = [(r.begin, r.end) for r in ranges if r.path == path]
        assert own[0][0] == 0 and own[-1][1] == end and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    assert len(tail.cut_tasks([("a", 0, 1000)], 100, 16)) == 10
    assert len(tail.cut_tasks([("a", 0, 10**12)], tail.SPLIT_BYTES, 16)) >= 10**12 // tail.SPLIT_BYTES


def test_landing_and_streamed_lines_sort_no_rows_by_folder(spark, tmp_path, monkeypatch):
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    rows = spark.range(50).selectExpr(
        "concat('i', id % 12) AS instrument_id", "'2024' AS year", "'01' AS month", "'k' AS object_key", "id AS pos", "concat(id, ',x') AS line",
        "'f' AS source_file", "0L AS range_start", "1L AS range_end", f"timestamp_ntz'{BASE}' AS ingest_ts",
    ).coalesce(1)
    seen, real = [], DataFrameWriter.parquet

    def parquet(writer, path, *more, **options):
        seen.append((path, spark.conf.get(conf, "0")))
        return real(writer, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    landed, lines = str(tmp_path / "b"), str(tmp_path / "l")
    bronze.write_bronze(rows, landed, "run", 1)
    silver.append_batch(bronze.read_bronze(spark, landed), "run", 1, RuleSet([InstrumentRule(f"i{n}", 2) for n in range(12)]), lines)
    assert dict(seen)[landed] == dict(seen)[lines] == "8" and spark.conf.get(conf, "0") == "0"
    # More folders than open files: the rest is sorted, no row is lost.
    assert bronze.read_bronze(spark, landed).count() == silver.read_streamed_lines(spark, lines).count() == 50


def test_object_keys_keep_their_form(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        bronze.object_key(F.lit("A"), F.lit("/x/a b.txt"), F.lit(7).cast("bigint"), F.lit(10**19 // 2).cast("bigint"),
                          F.lit(str(BASE)).cast("timestamp_ntz"), F.lit("run"), F.lit(12345678901).cast("bigint")).alias("k"),
        F.format_string("__%020d-%020d__%s-%010d.txt", F.lit(7), F.lit(10**19 // 2).cast("bigint"), F.lit("run"), F.lit(12345678901).cast("bigint")).alias("w"),
    ).first()
    assert row.k.endswith(row.w)
