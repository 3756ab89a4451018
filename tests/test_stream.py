"""Growing files: byte offsets, passes, replays and streaming Silver."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlake.functions.rules import InstrumentRule, RuleSet, classify_lines
from fieldlake.operators import consolidate as cs
from fieldlake.operators import offsets
from fieldlake.sources import bronze, reviews
from fieldlake.sources.tail import (
    FileRange, GrowingTextStream, last_line_end, list_matches, pack_ranges, plan_batch, probe_file, read_growing_files, read_range, split_range,
)
from fieldlake.streaming import ingest, silver

RULES = RuleSet([InstrumentRule("A", 1, patterns={0: "^[0-9]"})])


def read_all(path, split, block):
    end = last_line_end(str(path), path.stat().st_size, probe=3)
    out = []
    for part in split_range(str(path), 0, end, split):
        for batch in read_range(part, read_bytes=block):
            out += list(zip(batch.column("pos").to_pylist(), batch.column("line").to_pylist()))
    return out


@pytest.mark.parametrize("split, block", [(1, 1), (3, 2), (7, 4), (10, 100), (1000, 8), (1000, 1000)])
def test_ranges_cut_anywhere_give_each_line_once(tmp_path, split, block):
    rng = random.Random(split * 1000 + block)
    for _ in range(20):
        data = "".join(rng.choice(["a", "é", "\n", "\r\n", "bb", " "]) for _ in range(rng.randrange(0, 40))).encode()
        path = tmp_path / "f.txt"
        path.write_bytes(data)
        complete = data[: data.rfind(b"\n") + 1]
        want, at = [], 0
        for piece in complete.split(b"\n")[:-1]:
            want.append((at, piece.decode().removesuffix("\r")))
            at += len(piece) + 1
        assert read_all(path, split, block) == want


def test_invalid_bytes_do_not_shift_offsets(tmp_path):
    path = tmp_path / "f.txt"
    path.write_bytes(b"a\xff\nok\n\xe2\x82\nz\n")
    part = FileRange(str(path), 0, path.stat().st_size, 0, path.stat().st_size)
    rows = [(p, t) for b in read_range(part) for p, t in zip(b.column("pos").to_pylist(), b.column("line").to_pylist())]
    assert rows == [(0, "a�"), (3, "ok"), (6, "�"), (9, "z")]


def test_matches_are_not_recursive_and_skip_quarantine(tmp_path):
    for name in ("d1/a.txt", "d2/b.txt", "d1/_quarantine/c.txt", "d1/sub/e.txt", "d1/.hid.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    names = {p.removeprefix(str(tmp_path)) for p in list_matches(f"{tmp_path}/d*/*.txt")}
    assert names == {"/d1/a.txt", "/d2/b.txt"}
    assert list_matches(f"{tmp_path}/d1/_quarantine/*.txt") == {}
    assert list_matches(f"{tmp_path}/nothing/*.txt") == {}
    assert len(list_matches(f"{tmp_path}/d1/a.txt")) == 1


def test_batch_read_can_include_the_unfinished_line(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"1\n2\nhalf")
    pattern = f"{tmp_path}/*.txt"
    assert [r.line for r in read_growing_files(spark, pattern).orderBy("pos").collect()] == ["1", "2"]
    whole = read_growing_files(spark, pattern, split_bytes=2, final=True).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in whole] == [(0, "1"), (2, "2"), (4, "half")]


class Lake:
    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.source, self.path = root / "in", str(root / "lake")
        self.source.mkdir()

    def run(self, checkpoints="cp"):
        query = ingest.ingest_stream(
            self.spark, "A", [f"{self.source}/*.txt", f"{self.source}/o*.txt"], self.path, f"{self.path}/{checkpoints}", RULES, split_bytes=3
        )
        query.awaitTermination()
        return query

    def bronze(self):
        return bronze.read_bronze(self.spark, f"{self.path}/bronze")

    def landed(self):
        rows = self.bronze().orderBy("batch_id", "object_key", "pos").collect()
        return [(r.batch_id, r.source_file.split("/")[-1], r.pos, r.line) for r in rows]

    def offsets(self):
        return {r.file.split("/")[-1]: r.offset for r in bronze.file_offsets(self.bronze()).collect()}

    def silver(self):
        silver.streaming_silver(self.spark, f"{self.path}/bronze", f"{self.path}/lines", f"{self.path}/cp", RULES).awaitTermination()
        return silver.read_streamed_lines(self.spark, f"{self.path}/lines")


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, tmp_path)


def test_five_passes_over_growing_and_replaced_files(spark, lake):
    old, new = lake.source / "old.txt", lake.source / "new.txt"
    old.write_bytes(b"1\n2\n3,pa")
    lake.run()
    assert lake.landed() == [(0, "old.txt", 0, "1"), (0, "old.txt", 2, "2")]
    assert lake.offsets() == {"old.txt": 4}

    old.write_bytes(old.read_bytes() + b"rt\n")
    new.write_bytes(b"9\n8")
    lake.run()
    assert lake.landed()[2:] == [(1, "new.txt", 0, "9"), (1, "old.txt", 4, "3,part")]
    assert lake.offsets() == {"old.txt": 11, "new.txt": 2}

    new.write_bytes(new.read_bytes() + b"\n")
    lake.run()
    assert lake.landed()[4:] == [(2, "new.txt", 2, "8")]
    first_silver = {r.line for r in lake.silver().collect()}
    assert first_silver == {"1", "2", "3,part", "9", "8"}

    old.write_bytes(b"1\n7\n")
    lake.run()
    assert lake.landed()[5:] == [(3, "old.txt", 0, "1"), (3, "old.txt", 2, "7")]
    assert lake.offsets() == {"old.txt": 4, "new.txt": 4}

    lake.run()
    assert len(lake.landed()) == 7

    # Streaming Silver holds what a full rebuild of the same Bronze holds.
    streamed = lake.silver()
    rebuilt = cs.dedup_keep_first(classify_lines(lake.bronze(), RULES))
    assert sorted(r.line for r in streamed.collect()) == sorted(r.line for r in rebuilt.collect()) == ["1", "2", "3,part", "7", "8", "9"]
    stats = bronze.read_bronze_stats(spark, f"{lake.path}/bronze_stats")
    assert stats.agg(F.sum("data_rows")).first()[0] == 7 and stats.count() == 5
    assert tuple(silver.streamed_stats(stats, streamed).first()) == ("A", 5, 7, 6, 1)
    ledger = bronze.batch_ledger(lake.bronze()).collect()
    assert sorted((r.start_offset, r.end_offset) for r in ledger) == [(0, 2), (0, 4), (0, 4), (2, 4), (4, 11)]


def test_a_batch_that_runs_again_leaves_one_copy(spark, lake):
    (lake.source / "a.txt").write_bytes(b"1\n2\n")
    lake.run()
    run_id = ingest.checkpoint_id(spark, f"{lake.path}/cp/ingest/A")
    landed = lake.bronze().drop("run_id", "batch_id")
    kept = [tuple(r) for r in landed.collect()]
    again = spark.createDataFrame(kept, landed.schema)
    bronze.write_bronze(again, f"{lake.path}/bronze", run_id, 0)
    assert len(lake.landed()) == 2
    lines = f"{lake.path}/lines"
    for _ in range(2):
        silver.append_batch(again, "run", 5, RULES, lines)
    assert silver.read_streamed_lines(spark, lines).count() == 2
    silver.append_batch(again.withColumn("line", F.concat("line", F.lit("0"))), "next", 5, RULES, lines)
    assert sorted(r.line for r in silver.read_streamed_lines(spark, lines).collect()) == ["1", "10", "2", "20"]


def test_a_new_checkpoint_goes_on_and_keeps_what_the_old_one_landed(spark, lake):
    source = lake.source / "a.txt"
    source.write_bytes(b"1\n2\n")
    lake.run()
    source.write_bytes(b"1\n2\n3\n")
    (lake.source / "b.txt").write_bytes(b"4\n")
    lake.run("new")
    assert sorted(line for *_, line in lake.landed()) == ["1", "2", "3", "4"]
    source.write_bytes(b"9\n")
    lake.run("third")
    assert sorted(line for *_, line in lake.landed()) == ["1", "2", "3", "4", "9"]
    assert lake.offsets() == {"a.txt": 2, "b.txt": 2}
    assert lake.bronze().select("run_id").distinct().count() == 3


def test_lines_of_a_batch_without_statistics_are_read_again(spark, lake):
    (lake.source / "a.txt").write_bytes(b"1\n2\n")
    lake.run()
    assert set(ingest.landed_offsets(spark, lake.path, "A").values()) == {4}
    lake.bronze().write.partitionBy(*bronze.PARTITIONS).parquet(f"{lake.path}/other/bronze")
    assert ingest.landed_offsets(spark, f"{lake.path}/other", "A") == {}
    saved = spark.createDataFrame([("A", "x", 7), ("B", "y", 8)], "instrument_id string, file string, offset bigint")
    assert ingest.landed_offsets(spark, f"{lake.path}/other", "A", saved) == {"x": 7}
    assert ingest.landed_offsets(spark, f"{lake.path}/nothing", "A") == {}


def test_a_half_landed_batch_is_replaced_after_the_checkpoint_is_lost(spark, lake, monkeypatch):
    source = lake.source / "a.txt"
    source.write_bytes(b"1\n2\n")
    lake.run()
    source.write_bytes(b"1\n2\n3\n4\n")
    with monkeypatch.context() as broken:
        broken.setattr(bronze, "write_bronze_stats", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(Exception, match="disk"):
            lake.run()
    assert sorted(line for *_, line in lake.landed()) == ["1", "2", "3", "4"]  # lines are there, the batch did not end
    assert set(ingest.landed_offsets(spark, lake.path, "A").values()) == {4}
    lake.run("new")
    assert sorted(line for *_, line in lake.landed()) == ["1", "2", "3", "4"]
    assert set(ingest.landed_offsets(spark, lake.path, "A").values()) == {8}
    ranges = [(r.range_start, r.range_end, r.lines) for r in bronze.read_ledger(spark, f"{lake.path}/ledger").orderBy("range_start").collect()]
    assert ranges == [(0, 4, 2), (4, 8, 2)]


def test_a_backlog_takes_several_batches_and_no_line_twice(spark, lake):
    rng = random.Random(5)
    want = []
    for name in ("a", "b", "old"):
        lines = [f"{rng.randrange(10**6)},{name}{n}" for n in range(rng.randrange(20, 60))]
        (lake.source / f"{name}.txt").write_text("".join(f"{line}\n" for line in lines) + "unfinished")
        want += lines
    entry = spark.createDataFrame([("A", 0, "growing_file", [f"{lake.source}/*.txt"], None)], "instrument_id string, ordinal int, ingestion_type string, globs array<string>, active boolean")
    done = ingest.ingest_pass(spark, entry, lake.path, f"{lake.path}/cp", RULES, max_bytes=600).first()
    assert sorted(line for *_, line in lake.landed()) == sorted(want)
    sizes = [r.n for r in lake.bronze().groupBy("batch_id").agg(F.sum(F.length("line") + 1).alias("n")).collect()]
    assert done.instrument_status == "ok" and done.batches_written == len(sizes) >= 3 and max(sizes) <= 600
    assert {f.split("/")[-1]: n for f, n in done.files.items()} == {f"{n}.txt": (lake.source / f"{n}.txt").stat().st_size - 10 for n in ("a", "b", "old")}


def test_plans_share_the_bytes_of_a_batch(tmp_path):
    ready = {}
    for name, lines in (("big", 100), ("small", 2), ("long", 1)):
        path = tmp_path / name
        path.write_bytes((b"x" * (500 if name == "long" else 9) + b"\n") * lines)
        ready[str(path)] = probe_file(str(path), (path.stat().st_size, 0), None)
    big, small, long = (str(tmp_path / n) for n in ("big", "small", "long"))
    plan = plan_batch({}, ready, 300)
    assert plan[small][0] == 20 and plan[long][0] == 501 and plan[big][0] == 0
    plan = plan_batch(plan, ready, 300)
    assert plan[big][0] == 300 and plan_batch(plan, ready, 0)[big][0] == 1000
    assert plan_batch(plan, ready, 5)[big][0] == 310  # a line longer than the share goes whole
    parts = pack_ranges([FileRange(str(i), 0, 10, 0, 10) for i in range(100)] + [FileRange("b", 0, 250, 0, 100)], 100)
    assert [len(p.ranges) for p in parts] == [10] * 10 + [1]


def test_a_file_replaced_by_a_larger_one_loses_no_line(spark, lake):
    source = lake.source / "a.txt"
    source.write_bytes(b"1\n2\n")
    lake.run()
    source.write_bytes(b"5\n6\n7\n8\n")
    lake.run()
    assert [line for *_, line in lake.landed()] == ["1", "2", "5", "6", "7", "8"]
    source.write_bytes(b"9\n6\n7\n8\n")  # of the same size
    lake.run()
    source.write_bytes(b"9\n6\n7\n8\n3\n")  # the same file, grown
    lake.run()
    assert [line for *_, line in lake.landed()] == ["1", "2", "5", "6", "7", "8", "9", "6", "7", "8", "3"]


def test_a_restart_without_offsets_tells_replaced_files_by_their_head(tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"1\n2\n")
    options = {"path": str(path), "maxBytes": "2"}
    first = GrowingTextStream(options)
    start = first.initialOffset()
    end = first.latestOffset()
    assert [r.end for t in first.partitions(start, end) for r in t.ranges] == [2]
    end = first.latestOffset()
    path.write_bytes(b"1\n2\n3\n")
    again = GrowingTextStream(options)
    assert [(r.begin, r.end) for t in again.partitions(end, again.latestOffset()) for r in t.ranges] == [(4, 6)]
    path.write_bytes(b"7\n8\n9\n0\n")
    other = GrowingTextStream(options)
    assert [(r.begin, r.end) for t in other.partitions(end, other.latestOffset()) for r in t.ranges] == [(0, 8)]


def test_names_with_pattern_signs_and_file_urls(tmp_path):
    for name in ("a[1].txt", "a1.txt", "b?.txt"):
        (tmp_path / name).write_text("x\n")
    assert [p.split("/")[-1] for p in list_matches(f"{tmp_path}/a[1].txt")] == ["a[1].txt"]
    assert [p.split("/")[-1] for p in list_matches(f"{tmp_path}/b?.txt")] == ["b?.txt"]
    assert list(list_matches(f"file://{tmp_path}/a1.txt")) == [f"file://{tmp_path}/a1.txt"]
    assert sorted(list_matches(f"file:{tmp_path}/a*.txt")) == [f"file:{tmp_path}/a1.txt", f"file:{tmp_path}/a[1].txt"]


def test_a_file_cut_and_grown_to_the_same_end_makes_other_objects(spark, lake):
    source = lake.source / "a.txt"
    for content in (b"7\n", b"", b"5\n"):
        source.write_bytes(content)
        lake.run()
    rows = lake.bronze().collect()
    assert sorted(r.line for r in rows) == ["5", "7"]
    assert len({(r.object_key, r.pos) for r in rows}) == 2
    marked = cs.first_occurrence(classify_lines(lake.bronze(), RULES)).collect()
    assert sorted((r.line, r.is_first) for r in marked) == [("5", True), ("7", True)]


def test_a_store_without_review_items_is_empty(spark, tmp_path):
    none = reviews.read_review_items(spark, f"{tmp_path}/reviews")
    assert none.count() == 0 and "_s3_key" in none.columns


def test_an_unfinished_only_line_and_blank_ranges(spark, lake):
    (lake.source / "a.txt").write_bytes(b"half")
    (lake.source / "b.txt").write_bytes(b"\n  \n")
    lake.run()
    assert [line for *_, line in lake.landed()] in ([], ["", "  "])
    assert bronze.read_bronze_stats(spark, f"{lake.path}/bronze_stats").count() == 0


def test_a_pass_isolates_unsupported_and_inactive_instruments(spark, lake):
    (lake.source / "a.txt").write_bytes(b"1\n")
    rows = [("A", 0, "growing_file", [f"{lake.source}/*.txt"], True), ("B", 1, "api", [], None), ("C", 2, "growing_file", [], False)]
    instruments = spark.createDataFrame(
        rows, "instrument_id string, ordinal int, ingestion_type string, globs array<string>, active boolean"
    )
    status = ingest.ingest_pass(spark, instruments, lake.path, f"{lake.path}/cp", RULES)
    got = {r.instrument_id: (r.status, r.instrument_status, r.batches_written, r.error) for r in status.collect()}
    assert got == {
        "A": ("degraded", "ok", 1, None),
        "B": ("degraded", "error", 0, "Unknown ingestion_type: api"),
    }
    assert ingest.status_rows(spark, [("A", "ok", 1, None)]).first().status == "ok"


def test_stream_status_lists_every_batch_that_ended(spark, lake):
    for n in range(3):
        (lake.source / f"{n}.txt").write_text("1\n" * (n + 1))
        lake.run("other" if n == 2 else "cp")
    rows = ingest.stream_status(spark, lake.path).orderBy("landed_at", "input_rows").collect()
    assert [(r.instrument_id, r.input_rows, r.input_bytes, r.files) for r in rows] == [("A", 1, 2, 1), ("A", 2, 4, 1), ("A", 3, 6, 1)]
    assert len({(r.run_id, r.batch_id) for r in rows}) == 3
    many = spark.sql("select 'f' source_file, id range_start, id + 1 range_end, 1L lines, timestamp_ntz'2026-01-01 00:00:00' ingest_ts, 'B' instrument_id, 'r' run_id, id batch_id from range(150)")
    bronze.write_ledger(many, f"{lake.path}/ledger")
    assert ingest.stream_status(spark, lake.path).filter("instrument_id = 'B'").count() == 150



def test_offset_tables(spark):
    payloads = spark.createDataFrame(
        [("M", {"a": 5, "b": None}, 9), ("L1", None, 7), ("L2", None, 7), ("L0", None, 7), ("Z", None, 0)],
        "instrument_id string, files map<string,bigint>, offset bigint",
    )
    known = spark.createDataFrame([("M", "a"), ("L1", "x"), ("L2", "p"), ("L2", "q"), ("Z", "x")], "instrument_id string, file string")
    got = sorted(tuple(r) for r in offsets.checkpoint_normalize(payloads, known).collect())
    assert got == [("L1", "x", 7), ("L2", "q", 7), ("M", "a", 5), ("M", "b", 0)]
    local = spark.createDataFrame([("A", "f", 5), ("A", "g", 9)], "instrument_id string, file string, offset bigint")
    remote = spark.createDataFrame([("A", "f", 7), ("A", "h", 1)], "instrument_id string, file string, offset bigint")
    merged = sorted(tuple(r) for r in offsets.checkpoint_merge(local, remote).collect())
    assert merged == [("A", "f", 7, True), ("A", "g", 9, False), ("A", "h", 1, True)]
