"""No table that grows with the documents is broadcast, also where Spark takes it for a small one."""

import random
import re

import corpus_pipeline
from fieldlake.llm import components, repeats, simhash
from fieldlake.llm.staging import stage

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def broadcast_joins(spark, monkeypatch, function):
    """The hash joins with a broadcast side in the plans, as they ran, of what ``function`` stages and returns."""
    plans = []

    def run(df):
        df.collect()  # from here on the plan is the final one
        plans.append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])

    def recorded(df, name):
        run(df)
        return stage(df, name)

    for module in (simhash, components, repeats):
        monkeypatch.setattr(module, "stage", recorded)
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "10m")
    try:
        run(function())
    finally:
        spark.conf.set(LIMIT, before)
    return [x for p in plans for x in re.findall(r"Broadcast\w*Join \[([^\]]*)\]|(BroadcastNestedLoopJoin|CartesianProduct)", p)]


def documents(spark, folder):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    for k in range(30):
        edited = texts[k % 6].split()
        edited[rng.randrange(200)] = "new"
        texts.append(" ".join(edited))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[0]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents")
    return spark.read.parquet(f"{folder}/documents")


def test_links_are_a_merge_join(spark, tmp_path):
    prints = stage(simhash.fingerprints(documents(spark, tmp_path)).select("fp").distinct(), "prints")
    plan = simhash.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_near_duplicates_broadcasts_nothing(spark, tmp_path, monkeypatch):
    docs = documents(spark, tmp_path)
    assert broadcast_joins(spark, monkeypatch, lambda: simhash.near_duplicates(docs)) == []


def test_pipeline_near_duplicates_broadcasts_nothing(spark, tmp_path, monkeypatch):
    docs = documents(spark, tmp_path)
    assert broadcast_joins(spark, monkeypatch, lambda: corpus_pipeline.drop_near_duplicates(spark, docs, "")) == []


def test_pipeline_repeats_broadcasts_nothing_that_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 2)
    docs = documents(spark, tmp_path)
    found = broadcast_joins(spark, monkeypatch, lambda: corpus_pipeline.cut_repeats(spark, docs, ""))
    # anchors with very many contexts: one row for each GROUP contexts at most
    assert all(re.match(r"group#\d+L?$", keys) for keys, _ in found)
