import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldlake.functions.rules import InstrumentRule, RuleSet
from fieldlake.operators import reviews as rv
from fieldlake.sources.reviews import ITEM_SCHEMA, read_review_items, with_item_columns, write_review_items

BASE = datetime(2020, 1, 1)
ITEM = f"_s3_key string, {ITEM_SCHEMA}"
FIELDS = [f.strip().split()[0].strip("`") for f in ITEM.replace("string,string", "").split(", ")]


def items_df(spark, items):
    return spark.createDataFrame([tuple(item.get(f) for f in FIELDS) for item in items], ITEM)


def rows_df(spark, rows):
    return spark.createDataFrame(rows, "instrument_id string, row_key string, ts timestamp_ntz")


def sample(seed, n_rows=300, n_items=120):
    """Rows, items, and the (instrument, row key, item) links that the items are made from.

    Every item starts from the rows that it shall meet: their keys, or the times
    of the first and last row of a run in time order.
    """
    rng = random.Random(seed)
    rows, runs = [], {}
    for instrument, share in (("A", 3), ("B", 1)):
        seconds = sorted(rng.sample(range(400_000_000), n_rows * share // 4))
        timed = [(instrument, f"{instrument}{k}", BASE + timedelta(seconds=t)) for k, t in enumerate(seconds)]
        timed = [(instrument, f"{instrument}-early", datetime(1, 1, 1)), *timed, (instrument, f"{instrument}-late", datetime(9999, 12, 31, 23, 59, 59))]
        runs[instrument] = timed
        rows += timed + [(instrument, f"{instrument}-undated{k}", None) for k in range(8)]
    items, links = [], set()
    for i in range(n_items):
        name, instrument = f"{i:04d}", rng.choice("AAB")
        item = {"_s3_key": name, "id": str(i), "type": rng.choice(["flag", "correction"]), "instrument_id": instrument, "created_at": name, "status": rng.choice(["active", None, "inactive"])}
        met = set()
        if i % 4 == 0:
            met = set(rng.sample([k for a, k, _ in rows if a == instrument], rng.randrange(4)))
            item["row_keys"] = [*met, None, "unknown"]
            if met and i % 8 == 0:
                item["row_key"] = item["row_keys"].pop(0)
        else:
            timed, item["scope"] = runs[instrument], "time_range"
            first = rng.randrange(len(timed))
            last = min(len(timed) - 1, first + rng.choice([0, 0, 1, 5, 60]))
            low, high = timed[first][2].isoformat(), timed[last][2].isoformat() + "Z"
            if rng.random() < 0.15:
                first, low = 0, rng.choice([None, "", "soon"])
            if rng.random() < 0.15:
                last, high = len(timed) - 1, rng.choice([None, "later"])
            item["start_time"], item["end" if rng.random() < 0.3 else "end_time"] = low, high
            met = {k for _, k, _ in timed[first : last + 1]}
            if i % 4 == 3:
                item["row_key"] = f"{instrument}-undated{rng.randrange(8)}"
                met.add(item["row_key"])
        if item["status"] != "inactive":
            links |= {(instrument, k, name) for k in met}
        items.append(item)
    return rows, items, links


def test_matching_finds_the_links_that_items_are_made_from(spark):
    rows, items, links = sample(1)
    got = rv.match_reviews(rows_df(spark, rows), items_df(spark, items)).select("instrument_id", "row_key", "_s3_key")
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == links


def test_range_pairs_meet_once_and_split_rows_agree(spark):
    rows, items, links = sample(2, n_items=60)
    pairs = rv.match_by_time_range(rows_df(spark, rows), items_df(spark, items)).select("row_key", "_s3_key").collect()
    assert len(pairs) == len(set(pairs))
    linked = {(i, k) for i, k, _ in links}
    df, it = rows_df(spark, rows), items_df(spark, items)
    flagged = {tuple(r)[:2] for r in rv.flagged_rows(df, it).collect()}
    clean = {tuple(r)[:2] for r in rv.unflagged_rows(df, it).collect()}
    assert flagged == linked
    assert clean == {(i, k) for i, k, _ in rows} - linked


def test_attached_arrays_are_ordered_and_set_the_status(spark):
    rows, items, links = sample(3, n_rows=80, n_items=60)
    kinds = {i["_s3_key"]: i["type"] for i in items}
    got = rv.attach_reviews(rows_df(spark, rows), items_df(spark, items)).collect()
    assert len(got) == len(rows)
    for row in got:
        want = sorted(k for i, r, k in links if (i, r) == (row.instrument_id, row.row_key))
        flags = [k for k in want if kinds[k] == "flag"]
        fixes = [k for k in want if kinds[k] == "correction"]
        assert [f["_s3_key"] for f in row.flags] == flags
        assert [c["_s3_key"] for c in row.corrections] == fixes
        assert row.status == ("corrected" if fixes else "flagged" if flags else "normal")


def test_validation_messages_and_defaults(spark):
    rules = RuleSet([InstrumentRule("A", 1)])
    cases = [
        ({"type": "flag", "instrument_id": "X", "row_key": "k"}, rv.BAD_INSTRUMENT),
        ({"type": "flag", "instrument_id": None, "row_key": "k"}, rv.BAD_INSTRUMENT),
        ({"type": "flag", "instrument_id": "A", "scope": "time_range", "start_time": "x"}, rv.RANGE_NEEDS_BOUNDS),
        ({"type": "flag", "instrument_id": "A", "scope": "time_range", "start_time": "", "end_time": "x"}, rv.RANGE_NEEDS_BOUNDS),
        ({"type": "flag", "instrument_id": "A", "scope": "time_range", "start_time": "x", "end_time": "y"}, None),
        ({"type": "flag", "instrument_id": "A", "row_keys": []}, rv.FLAG_NEEDS_ROWS),
        ({"type": "flag", "instrument_id": "A", "row_keys": ["k"]}, None),
        ({"type": "correction", "instrument_id": "A", "row_key": "k", "corrected_values": {}}, rv.CORRECTION_NEEDS_VALUES),
        ({"type": "correction", "instrument_id": "A", "row_keys": ["k"], "corrected_values": {"a": "1"}}, rv.CORRECTION_NEEDS_VALUES),
        ({"type": "correction", "instrument_id": "A", "row_key": "k", "corrected_values": {"a": "1"}}, None),
    ]
    df = items_df(spark, [{**c, "id": str(n)} for n, (c, _) in enumerate(cases)])
    rows = sorted(rv.validate_review_items(df, rules).collect(), key=lambda r: int(r.id))
    assert [r.error for r in rows] == [want for _, want in cases]
    assert {(r.status, r.reason, r.notes) for r in rows} == {("active", "", "")}
    assert rows[0].scope == "selected_rows"


def test_ids_are_random_without_a_suffix(spark):
    df = spark.range(50).select(rv.review_id(F.lit("flag"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")).alias("i"))
    ids = [r.i for r in df.collect()]
    assert len(set(ids)) == 50
    assert all(i.startswith("flag_20260102T030405_") and len(i) == 31 for i in ids)


def test_items_survive_storage_and_broken_json_is_skipped(spark, tmp_path):
    items = with_item_columns(items_df(spark, [
        {"id": "1", "type": "flag", "instrument_id": "A", "row_keys": ["k"], "created_at": "2026-03-02T00:00:00", "status": "inactive"},
        {"id": "2", "type": "correction", "instrument_id": "A", "row_key": "k", "corrected_values": {"v": "1"}, "created_at": "2026-04-02T00:00:00"},
    ]))
    path = str(tmp_path / "items")
    write_review_items(items, path)
    write_review_items(items, path)
    back = read_review_items(spark, path)
    assert back.count() == 4
    assert {(r.id, r.type, r.instrument_id) for r in back.collect()} == {("1", "flag", "A"), ("2", "correction", "A")}
    docs = tmp_path / "docs" / "A" / "flags"
    docs.mkdir(parents=True)
    (docs / "a.json").write_text('{\n "id": "9",\n "type": "flag",\n "instrument_id": "A",\n "row_keys": ["x"]\n}')
    (docs / "b.json").write_text("{broken")
    got = read_review_items(spark, str(tmp_path / "docs"), documents=True).collect()
    assert [(r.id, r.row_keys, r._s3_key.endswith("/a.json")) for r in got] == [("9", ["x"], True)]


def bounds_df(spark, ranges):
    return spark.createDataFrame([("A", str(i), a, b) for i, (a, b) in enumerate(ranges)], "instrument_id string, _s3_key string, _from timestamp_ntz, _to timestamp_ntz")


def test_covers_are_disjoint_small_and_barely_larger_than_their_range(spark):
    rng = random.Random(7)
    ranges = [(BASE, BASE), (BASE, BASE - timedelta(seconds=1)), (BASE - timedelta(days=20000), BASE)]
    for _ in range(60):
        low = BASE + timedelta(seconds=rng.randrange(10**9))
        ranges.append((low, low + timedelta(seconds=int(10 ** rng.uniform(0, 8.5)))))
    covers = {}
    for r in rv.range_cells(bounds_df(spark, ranges)).collect():
        covers.setdefault(int(r["_s3_key"]), []).append((r["_cell"] * 8 ** r["_level"], (r["_cell"] + 1) * 8 ** r["_level"]))
    zero = datetime(1970, 1, 1)
    for i, (low, high) in enumerate(ranges):
        if low > high:
            continue
        cells = sorted(covers[i])
        begin, end = int((low - zero).total_seconds()), int((high - zero).total_seconds()) + 1
        assert all(a[1] == b[0] for a, b in zip(cells, cells[1:])) and len(cells) <= 14 * 9
        assert cells[0][0] <= begin and cells[-1][1] >= end
        assert cells[-1][1] - cells[0][0] <= 1.25 * (end - begin) + 2


def test_open_ranges_reach_from_the_first_year_to_the_last(spark):
    rows = [("A", "first", datetime(1, 1, 1)), ("A", "mid", BASE), ("A", "after", BASE + timedelta(microseconds=1)), ("A", "last", datetime(9999, 12, 31, 23, 59, 59, 999999)), ("B", "other", BASE)]
    items = [{"_s3_key": n, "type": "flag", "instrument_id": "A", "scope": "time_range", "start_time": a, "end_time": b}
             for n, a, b in (("till", None, BASE.isoformat()), ("from", BASE.isoformat(), None), ("all", None, None))]
    got = {(r.row_key, r["_s3_key"]) for r in rv.match_by_time_range(rows_df(spark, rows), items_df(spark, items)).collect()}
    every = {"first", "mid", "after", "last"}
    assert got == {("first", "till"), ("mid", "till"), *((k, "from") for k in every - {"first"}), *((k, "all") for k in every)}


def test_candidates_are_few_and_the_join_needs_no_salt(spark):
    rows, items, _ = sample(5, n_rows=2000, n_items=200)
    df, it = rows_df(spark, rows), items_df(spark, items).filter("start_time > '1' and coalesce(end_time, `end`) > '1' and start_time <> 'soon'")
    met = rv.meet_by_time(df, it, "ts", "inner", exact=False).count()
    true = rv.match_by_time_range(df, it).count()
    assert true <= met <= 2 * true
