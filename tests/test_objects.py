"""Raw objects read by byte range: the same rows at every range size, errors kept to their object."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlake.operators import consolidate as cs
from fieldlake.sources import files

BLANKS = b"a\n\nb\r\n\r\nc"
BREAKS = [b"a", b"bc", b"\xc3\xa9", b"\xff", b"\n", b"\n", b"\r", b"\r\n", b"\x0b", b"\x0c", b"\x1d", b"\xc2\x85", b"\xe2\x80\xa8", b"\xe2\x82"]


def put(root, contents):
    for name, content in contents.items():
        path = root / "X/bronze/year=2026/month=03" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def lines_of(df):
    out = {}
    for r in df.orderBy("object_key", "pos").collect():
        out.setdefault(r.object_key.split("/")[-1], []).append((r.pos, r.line))
    return out


def test_rows_and_positions_do_not_depend_on_the_range_size(spark, tmp_path):
    rng = random.Random(5)
    contents = {f"r{i:02}.txt": b"".join(rng.choices(BREAKS, k=rng.randrange(0, 40))) for i in range(40)}
    contents |= {"blank.txt": BLANKS, "long.txt": b"x" * 5000 + b"\n" + b"y" * 700, "cr.txt": b"a\r\r\nb\r", "empty.txt": b"", ".keep": b"z"}
    put(tmp_path, contents)
    whole = lines_of(files.scan_bronze_lines(spark, str(tmp_path)))
    expected = {name: content.decode(errors="replace").splitlines() for name, content in contents.items() if not name.startswith(".")}
    assert {name: [line for _, line in found] for name, found in whole.items()} == {n: lines for n, lines in expected.items() if lines}
    assert whole["blank.txt"] == [(0, "a"), (2, ""), (3, "b"), (6, ""), (8, "c")]
    assert all(len({pos for pos, _ in found}) == len(found) for found in whole.values())
    for size in (29, 512):
        assert lines_of(files.scan_bronze_lines(spark, str(tmp_path), range_bytes=size)) == whole


def test_an_unreadable_object_counts_nothing_and_the_others_go_on(spark, tmp_path):
    put(tmp_path, {"good.txt": b"1\n2\n", "lost.txt": b"1\n2\n3\n"})
    lines = files.scan_bronze_lines(spark, str(tmp_path), on_error="column")
    strict = files.scan_bronze_lines(spark, str(tmp_path))
    lost = tmp_path / "X/bronze/year=2026/month=03/lost.txt"
    lost.unlink()
    lost.mkdir()  # listed as an object, and no longer one that can be read
    got = lines.withColumn("is_data", F.col("line").isNotNull())
    counted = {r.object_key.split("/")[-1]: r.data_rows for r in cs.count_data_rows(got).collect()}
    assert counted == {"good.txt": 2, "lost.txt": 0}
    assert cs.bronze_rows(got).first().bronze_rows == 2
    errors = {r.object_key.split("/")[-1] for r in lines.where("error is not null").collect()}
    assert errors == {"lost.txt"}
    with pytest.raises(Exception, match="lost.txt"):
        strict.collect()


def test_an_error_in_one_range_voids_the_object(spark):
    lines = spark.sql(
        "select * from values ('X', 'a', 0L, '1', true, null), ('X', 'a', null, null, null, 'broken'), ('X', 'b', 0L, '1', true, null) "
        "t(instrument_id, object_key, pos, line, is_data, error)"
    )
    assert sorted((r.object_key, r.data_rows) for r in cs.count_data_rows(lines).collect()) == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="raise or column"):
        files.scan_bronze_lines(spark, "/none", on_error="skip")


def test_no_objects_give_no_lines(spark, tmp_path):
    assert files.scan_bronze_lines(spark, str(tmp_path), on_error="column").columns == ["instrument_id", "object_key", "pos", "line", "error"]
    assert files.scan_bronze_lines(spark, str(tmp_path)).count() == 0
