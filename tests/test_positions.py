from pyspark.sql import functions as F

from fieldlake.functions.rules import InstrumentRule, RuleSet, classify_lines
from fieldlake.operators import consolidate as cs
from fieldlake.operators import paging, positions

RULES = RuleSet([], default=InstrumentRule("*", 1, patterns={0: "^d"}))


def build(spark, lines):
    df = spark.createDataFrame(lines, "instrument_id string, object_key string, pos bigint, line string")
    return classify_lines(df, RULES)


# A small lake, and what consolidation makes of it.
LAKE = [
    ("A", "o1", 0, "h-start"), ("A", "o1", 5, "# note"), ("A", "o1", 9, "d1"), ("A", "o1", 12, "d2"), ("A", "o1", 15, "d1"),
    ("A", "o10", 0, "h-later"), ("A", "o10", 4, "d3"), ("A", "o10", 7, "d2"),
    ("A", "o2", 0, " "), ("A", "o2", 2, "d4"), ("A", "o2", 6, "h-start"), ("A", "o2", 8, "d1"),
    ("B", "o1", 0, "d1"), ("B", "o1", 3, "h-b"), ("B", "o1", 6, " "), ("B", "o1", 8, "d9"),
    ("B", "z", 0, "d9"), ("B", "z", 3, "d1"), ("B", "z", 6, "d0"),
    ("C", "only", 0, "h-c"), ("C", "only", 4, "# c"), ("C", "only", 8, "h-c"),
]
KEPT = {
    "A": [("d1", "o1", 9), ("d2", "o1", 12), ("d3", "o10", 4), ("d4", "o2", 2)],
    "B": [("d1", "o1", 0), ("d9", "o1", 8), ("d0", "z", 6)],
}
HEADERS = {"A": "# note", "B": "h-b"}
PREAMBLES = {"A": ["h-start", "# note", "h-later"], "B": ["h-b"], "C": ["h-c", "# c"]}
COUNTS = {"A": (3, 7, 4, 3), "B": (2, 5, 3, 2)}  # objects, data lines, kept, repeated
PREVIOUS = {
    ("A", "o1"): [None, "h-start", "# note", "# note", "# note"], ("A", "o10"): [None, "h-later", "h-later"],
    ("A", "o2"): [None, None, None, "h-start"], ("B", "o1"): [None, None, "h-b", "h-b"], ("B", "z"): [None] * 3,
    ("C", "only"): [None, "h-c", "# c"],
}


def enlarged(copies):
    """The lake with its data lines repeated in further objects: only the counts of repeated lines change."""
    more = [(i, f"zz{n:03d}", pos, line) for n in range(copies) for i, _, pos, line in LAKE if line in ("d1", "d9") and i == "B"]
    return LAKE + list(dict.fromkeys(more))


def found_rows(df, partitions):
    rows = {}
    for r in positions.assign_source_index(cs.dedup_keep_first(df), partitions=partitions).collect():
        rows.setdefault(r.instrument_id, {})[r.source_index] = (r.line, r.object_key, r.pos)
    return {i: [by_index[n] for n in range(len(by_index))] for i, by_index in rows.items()}


def test_consolidation_of_a_small_lake(spark):
    df = build(spark, LAKE)
    assert {r.instrument_id: r.line for r in cs.recover_header(df).collect()} == HEADERS
    for partitions in (1, 3, 9):
        assert found_rows(df, partitions) == KEPT
        preamble = {}
        for r in cs.collect_preamble(df, partitions).orderBy("seq").collect():
            preamble.setdefault(r.instrument_id, []).append(r.line)
        assert preamble == PREAMBLES
    objects = df.select("instrument_id", "object_key").distinct()
    stats = {r.instrument_id: tuple(r)[1:] for r in cs.silver_stats(cs.dedup_keep_first(df), objects).collect()}
    assert {i: stats[i] for i in COUNTS} == COUNTS


def test_repeats_in_later_objects_change_nothing_but_their_count(spark):
    df = build(spark, enlarged(40))
    assert found_rows(df, 7) == KEPT
    objects = df.select("instrument_id", "object_key").distinct()
    stats = {r.instrument_id: tuple(r)[1:] for r in cs.silver_stats(cs.dedup_keep_first(df), objects).collect()}
    extra = len(enlarged(40)) - len(LAKE)
    assert stats["A"] == COUNTS["A"] and stats["B"] == (42, 5 + extra, 3, 2 + extra)


def test_header_needs_a_line_before_data_in_the_same_object(spark):
    lines = [("A", "a", 0, "h-tail-only"), ("A", "a", 1, " "), ("A", "b", 0, "d1"), ("A", "b", 1, "h1"), ("A", "b", 2, "h2"),
             ("A", "b", 3, " "), ("A", "b", 4, "d2"), ("A", "c", 0, "h3"), ("A", "c", 1, "d3"), ("B", "x", 0, "d1")]
    assert [(r.instrument_id, r.line) for r in cs.recover_header(build(spark, lines)).collect()] == [("A", "h2")]


def test_previous_nondata_line_crosses_blocks(spark):
    for block_rows in (1, 2, 41):
        got = {}
        for r in positions.previous_nondata_line(build(spark, LAKE), block_rows=block_rows).orderBy("instrument_id", "object_key", "pos").collect():
            got.setdefault((r.instrument_id, r.object_key), []).append(r.previous_nondata)
        assert got == PREVIOUS


def test_first_occurrence_marks_one_row_per_line(spark):
    every = cs.first_occurrence(build(spark, LAKE)).collect()
    marked = {(r.instrument_id, r.line, r.object_key, r.pos) for r in every if r.is_first}
    assert marked == {(i, *row) for i, rows in KEPT.items() for row in rows}
    assert len(every) == sum(line.startswith("d") for *_, line in LAKE)


def test_pages_of_both_kinds_join_up_to_the_whole(spark):
    rows = spark.range(0, 1000).filter("id % 3 > 0").select(F.col("id").alias("source_index")).cache()
    ids = [r[0] for r in rows.orderBy("source_index").collect()]
    for order, want in (("asc", ids), ("desc", ids[::-1])):
        for fan_out, fine in ((4096, 20_000), (3, 70), (2, 1)):
            seen = []
            for cursor in range(0, 700, 200):
                part = paging.page(rows, cursor, 200, order, fan_out=fan_out, fine=fine)
                seen += [r[0] for r in part.collect()]
            assert seen == want
            assert paging.page(rows, 5000, 10, order, fan_out=fan_out, fine=fine).collect() == []
    after = [r[0] for r in paging.page_after(rows, 100, 5).collect()]
    assert after == [i for i in ids if i > 100][:5]
    rows.unpersist()


def test_limits_and_cursors(spark):
    assert [paging.clamp_limit(v) for v in (None, 0, -5, 7, 9999)] == [100, 100, 1, 7, 500]
    assert [paging.clamp_cursor(v) for v in (None, -1, 5)] == [0, 0, 5]
    rows = spark.range(30).withColumnRenamed("id", "source_index")
    assert paging.next_cursor(paging.page(rows, 10, 20), 10, 20).first()[0] == 30
    assert paging.next_cursor(paging.page(rows, 20, 20), 20, 20).first()[0] is None


def test_dense_pages_need_no_count(spark):
    rows = spark.range(30).withColumnRenamed("id", "source_index")
    for cursor in (0, 7, 25, 30, 99):
        for order, ids in (("asc", list(range(30))), ("desc", list(range(29, -1, -1)))):
            assert [r[0] for r in paging.page_dense(rows, cursor, 8, order).collect()] == ids[cursor : cursor + 8]
    assert paging.page_dense(rows.filter("false"), 0, 8, "desc").collect() == []


def test_a_page_of_a_sparse_index_with_one_far_row(spark):
    rows = spark.sql("select id as source_index from range(100) union all select 1000000000000")
    assert [r[0] for r in paging.page(rows, 99, 5, fan_out=4, fine=10).collect()] == [99, 10**12]
    assert [r[0] for r in paging.page(rows, 0, 2, "desc", fan_out=4, fine=10).collect()] == [10**12, 99]


def test_ranks_of_many_objects_use_no_window_and_stay_spread(spark):
    lines = spark.sql("select 'A' instrument_id, format_string('o%05d', id) object_key, 0L pos from range(1000) "
                      "union all select 'B', 'one', id from range(500) union all select null, 'x', id from range(3)")
    ranked = positions.assign_source_index(lines.repartition(4), partitions=16)
    assert "Window" not in ranked._jdf.queryExecution().toString()
    got = {}
    for r in ranked.orderBy("source_index").collect():
        got.setdefault(r.instrument_id, []).append((r.object_key, r.pos, r.source_index))
    assert got["A"] == [(f"o{i:05d}", 0, i) for i in range(1000)]
    assert got["B"] == [("one", i, i) for i in range(500)] and [i for *_, i in got[None]] == [0, 1, 2]
    staged = spark.read.parquet(*[f for f in ranked.inputFiles() if "ordered-rows" in f]).filter("instrument_id = 'A'")
    sizes = [r["count"] for r in staged.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 250


def test_rank_of_an_empty_table(spark):
    lines = spark.createDataFrame([], "instrument_id string, object_key string, pos bigint")
    assert positions.assign_source_index(lines).collect() == []
