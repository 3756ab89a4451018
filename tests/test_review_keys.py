from datetime import datetime, timedelta

from test_reviews import BASE, items_df, rows_df, sample

from fieldlake.operators import reviews as rv


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_of_a_row_need_no_items(spark):
    """An item names thousands of rows: it must not travel once for each of them unless it is asked for."""
    rows, items, _ = sample(4, n_rows=40, n_items=20)
    attached = rv.attach_reviews(rows_df(spark, rows), items_df(spark, items))
    assert " AS item#" in plan_of(attached.select("row_key", "flags"))
    assert " AS item#" not in plan_of(attached.select("row_key", "flag_keys", "correction_keys", "status"))


def test_ranges_of_a_cell_in_several_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(rv, "LIST_RANGES", 2)
    rows, items, links = sample(6)
    kinds = {i["_s3_key"]: i["type"] for i in items}
    got = rv.attach_reviews(rows_df(spark, rows), items_df(spark, items)).select("instrument_id", "row_key", "flag_keys", "correction_keys").collect()
    assert len(got) == len(rows)
    for kind, column in (("flag", "flag_keys"), ("correction", "correction_keys")):
        for r in got:
            assert r[column] == sorted(k for i, row, k in links if (i, row) == (r.instrument_id, r.row_key) and kinds[k] == kind)


def test_status_reads_no_items(spark):
    rows, items, links = sample(8, n_rows=40, n_items=20)
    kinds = {i["_s3_key"]: i["type"] for i in items}
    status = rv.attach_reviews(rows_df(spark, rows), items_df(spark, items)).select("instrument_id", "row_key", "status")
    assert " AS item#" not in plan_of(status)
    for r in status.collect():
        met = {kinds[k] for i, row, k in links if (i, row) == (r.instrument_id, r.row_key)}
        assert r.status == ("corrected" if "correction" in met else "flagged" if met else "normal")


def test_status_alone_builds_no_keys(spark):
    """With many ranges over the same time a row would carry the keys of all of them."""
    rows, items, links = sample(9)
    kinds = {i["_s3_key"]: i["type"] for i in items}
    copies = items + [{**i, "_s3_key": f"{i['_s3_key']}-again{k}"} for i in items for k in range(3)]
    attached = rv.attach_reviews(rows_df(spark, rows), items_df(spark, copies), arrays=False)
    assert attached.columns == ["instrument_id", "row_key", "ts", "status"]
    assert "collect_list" not in plan_of(attached)
    got = attached.collect()
    assert len(got) == len(rows)
    for r in got:
        met = {kinds[k] for i, row, k in links if (i, row) == (r.instrument_id, r.row_key)}
        assert r.status == ("corrected" if "correction" in met else "flagged" if met else "normal")


def test_edges_hold_what_ranges_hold(spark):
    """Copies of a range add no row, and parts of a second count."""
    at = "2020-01-01T00:00:00"
    bounds = [(f"{at}.250", f"{at}.750"), (at, f"{at}.100"), (f"{at}.900", "2020-01-01T00:10:00.500"), ("2020-01-01T00:10:00.800", "2020-01-01T00:09:00")]
    items = [{"_s3_key": f"{k}-{n}", "type": "flag", "instrument_id": "A", "scope": "time_range", "start_time": low, "end_time": high} for k in range(5) for n, (low, high) in enumerate(bounds)]
    assert rv.range_edges(items_df(spark, items)).count() == rv.range_edges(items_df(spark, items[: len(bounds)])).count()
    times = [BASE + timedelta(microseconds=m) for s in (-1, 0, 1, 64, 512, 599, 600, 601) for m in (s * 10**6 + p for p in (0, 100_000, 100_001, 250_000, 500_000, 750_000, 750_001, 900_000))]
    rows = [("A", str(k), t) for k, t in enumerate(times)]
    held = {str(k) for k, t in enumerate(times) if any(datetime.fromisoformat(low) <= t <= datetime.fromisoformat(high) for low, high in bounds)}
    attached = rv.attach_reviews(rows_df(spark, rows), items_df(spark, items), arrays=False)
    assert {r.row_key for r in attached.filter("status = 'flagged'").collect()} == held


def test_levels_do_not_deal_rows_by_instrument(spark):
    rows, items, _ = sample(5, n_rows=40, n_items=20)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rv.match_by_time_range(rows_df(spark, rows), items_df(spark, items))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin [instrument_id" in plan
