import json
import os
import subprocess
import sys
from datetime import datetime as at
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from assayline.catalog import fixtures
from assayline.catalog.oracle import ORACLE
from assayline.catalog.queries import QUERIES
from assayline.plans import report
from assayline.session import shared_folder
from assayline.settings import Settings
from assayline.sources import ab_json, config, requests, runs
from assayline.streaming.spot_check import SpotCheck, current_windows, read_table, sampled, start_spot_check

SF = "/root/testdata/sf0.001"


def test_ab_document(spark, tmp_path):
    doc = {
        "prompts": ["p0", "p1"], "sources": ["s0"],
        "model_a": {"outputs": ["plain", {"text": "t", "rank": 1}, {"generated": "g"}, {"other": 2}]},
        "model_b": {"id": "b-1", "outputs": [{"text": "both", "generated": "no", "x": {"y": 1}}]},
    }
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    rows = ab_json.read_ab_json(spark, str(tmp_path)).orderBy("slot", "sample_index").collect()
    assert [(r["slot"], r["model_id"], r["generated"], r["prompt"], r["source"]) for r in rows] == [
        ("a", "model_a", "plain", "p0", "s0"), ("a", "model_a", "t", "p1", ""),
        ("a", "model_a", "g", "", ""), ("a", "model_a", "", "", ""),
        ("b", "b-1", "both", "p0", "s0")]
    assert [dict(r["metadata"]) for r in rows] == [{}, {"rank": "1"}, {}, {"other": "2"}, {"x": '{"y":1}'}]


def test_bad_ab_documents_are_quarantined(spark):
    good = {"model_a": {"outputs": ["x", {"text": "y"}]}, "model_b": {"outputs": ["z", "w"]}, "prompts": ["p"]}
    bad = {
        "no document": None, "not valid JSON": '{"model_a": ', "not an object": "[1]",
        "model_a has no list of outputs": json.dumps({**good, "model_a": {"id": "a"}}),
        "model_b has no list of outputs": json.dumps({**good, "model_b": {"outputs": "text"}}),
        "model_b has outputs that are neither text nor object: 3": json.dumps(
            {**good, "model_b": {"outputs": [1, None, ["x"], "t"]}}),
        "sources is no list": json.dumps({**good, "sources": "s"}),
        "unequal outputs: 2 and 0": json.dumps({**good, "model_b": {"outputs": []}}),
    }
    docs = spark.createDataFrame(
        [(i, "keep", v) for i, v in enumerate([json.dumps(good), *bad.values()])], "id int, `a.b` string, value string")
    out = ab_json.quarantined_ab(docs)
    assert out.columns == ["id", "a.b", "value", "reason"]
    assert [(r.reason, r.value) for r in out.orderBy("id").collect()] == list(bad.items())
    rows = ab_json.parse_ab(docs, comparable=True).collect()
    assert {r.id for r in rows} == {0} and len(rows) == 4 and {r["a.b"] for r in rows} == {"keep"}
    assert sorted(r.prompt for r in rows) == ["", "", "p", "p"]
    # without the demand every readable side is read
    assert {r.id for r in ab_json.parse_ab(docs).collect()} == {0, 4, 5, 6, 7, 8}


def test_requests(spark, tmp_path):
    lines = [
        {"input": {"prompt": "p"}, "candidate": {"output": "o"}},
        {"input": {"prompt": "p", "source": "s"}, "candidate": {"id": "c", "output": "o"},
         "baseline": {"output": "b"}, "thresholds": {"min_score": "0.5", "block_on_flags": ["x"]},
         "metadata": {"k": 1}, "version_metadata": {"commit_sha": "abc"}, "store_full_payloads": True,
         "reference": {"gold_output": "g", "rubric": {"r": True}}, "unknown": 1},
        {"input": {}, "candidate": {"output": 5}, "baseline": {}, "thresholds": {"min_score": "high"}},
        {"input": {"prompt": "p"}, "candidate": {"output": "o"}, "suite_id": None, "baseline": None,
         "metadata": None, "thresholds": {"block_on_flags": ["a", 1]}},
    ]
    path = tmp_path / "requests.jsonl"
    path.write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", "[1]"]))
    parsed = requests.read_requests(spark, str(path)).coalesce(1).collect()
    a, b, c, d, broken, array = parsed
    assert a["errors"] == [] and (a["suite_id"], a["task_type"]) == ("default-quality-gate", "summary")
    assert (a["min_score"], a["block_on_flags"], a["source"]) == (0.8, [], "")
    assert (a["candidate_id"], a["baseline"], a["metadata"]) == ("default", None, "{}")
    assert a["store_full_payloads"] is False
    assert b["errors"] == [] and (b["min_score"], b["block_on_flags"]) == (0.5, ["x"])
    assert (b["baseline_id"], b["baseline"], b["store_full_payloads"]) == ("default", "b", True)
    assert b["version_metadata"]["commit_sha"] == "abc" and b["gold_output"] == "g"
    assert c["errors"] == [
        "input.prompt: field required", "baseline.output: field required",
        "thresholds.min_score: must be a number", "candidate.output: must be a string"]
    assert d["errors"] == ["thresholds.block_on_flags: must be a list of strings",
                           "suite_id: must be a string"]
    assert d["metadata"] is None and d["baseline"] is None
    assert "request: not valid JSON" in broken["errors"]
    assert "request: must be an object" in array["errors"]
    read = requests.read_requests(spark, str(path))
    assert requests.valid_requests(read).count() == 2
    assert requests.quarantined_requests(read).count() == 4


def test_run_ids_repeat(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    ids = [r["run_id"] for r in requests.with_run_id(df, "batch", "n").orderBy("n").collect()]
    assert len(set(ids)) == 2
    assert ids == [r["run_id"] for r in requests.with_run_id(df, "batch", "n").orderBy("n").collect()]


def test_config(spark, tmp_path):
    text = """
evaluators:
  hallucination: {enabled: false, contradiction_threshold: 0.2, nli_model: some-model}
  content_safety: {forbidden_terms: [a, b], forbidden_topics: [], toxicity_threshold: 0.4}
  mine: {enabled: false}
"""
    path = tmp_path / "c.yaml"
    path.write_text(text)
    pytest.importorskip("yaml")
    s = config.load_settings(str(path))
    assert s.hallucination.entailment_floor == 0.2 and not s.is_enabled("hallucination")
    assert s.is_enabled("quality") and not s.is_enabled("mine")
    assert s.content_safety.forbidden_terms == ("a", "b")
    assert [r["value"] for r in config.rules_table(spark, s).orderBy("rule_id").collect()] == [
        "a", "b", "politics", "religion", "gambling", "weapons"]
    assert config.load_settings(str(tmp_path / "none.yaml"), missing_ok=True) == Settings()
    with pytest.raises(OSError):
        config.load_settings(str(tmp_path / "none.yaml"))


def test_run_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = [(f"r{i}", "s", f"2024-01-0{i + 1}T00:00:00Z", 0.1 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "run_id string, suite_id string, created_at string, aggregate_score double")
    runs.save_runs(df, path, ingest_seq=1)
    again = df.filter("run_id = 'r1'").withColumn("aggregate_score", F.lit(0.9))
    runs.save_runs(again, path, ingest_seq=2)
    stored = runs.read_runs(spark, path)
    assert [r["run_id"] for r in runs.recent_runs(stored, 3).collect()] == ["r3", "r2", "r1"]
    assert runs.get_run(stored, "r1").first()["aggregate_score"] == 0.9
    assert runs.get_run(stored, "none").count() == 0
    plan = runs.get_run(stored, "r1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run_id,r1)" in plan
    assert "TakeOrderedAndProject" in runs.recent_runs(stored)._jdf.queryExecution().executedPlan().toString()
    day = stored.filter("run_date = '2024-01-02'")
    assert "PartitionFilters: [isnotnull(run_date" in day._jdf.queryExecution().executedPlan().toString()
    runs.save_runs(df.drop("created_at").limit(1), path, ingest_seq=3)
    assert runs.get_run(runs.read_runs(spark, path), "r0").first()["created_at"].endswith("Z")


def test_report_files(spark, tmp_path):
    reports = spark.createDataFrame([("s", '{"ci":{"passed":true}}')], "suite_id string, report string")
    details = spark.createDataFrame([("s", 1)], "suite_id string, sample int")
    report.write_reports(reports, str(tmp_path / "out"), details)
    assert spark.read.json(str(tmp_path / "out" / "summary")).first()["ci"]["passed"] is True
    assert spark.read.json(str(tmp_path / "out" / "details")).count() == 1


def test_compaction_keeps_all_versions_and_skips_files(spark, tmp_path):
    path = str(tmp_path / "runs")
    saved = []

    def save(seq, ids, day):
        rows = [(f"run-{i:03d}", f"2024-01-{day:02d}T{i % 24:02d}:00:00Z", "s: 5%" if i % 2 else "t", seq / 10) for i in ids]
        df = spark.createDataFrame(rows, "run_id string, created_at string, suite_id string, aggregate_score double")
        runs.save_runs(df, path, seq)
        saved.extend((r[0], seq, r[3]) for r in rows)

    def all_of(**which):
        return sorted((r.run_id, r.ingest_seq, r.aggregate_score) for r in runs.read_runs(spark, path, **which).collect())

    save(1, range(0, 40), 1)
    assert runs.manifest(spark, path) is None and all_of() == sorted(saved)
    save(2, range(20, 60), 1)
    save(3, range(100, 140), 2)
    runs.compact_runs(spark, path)
    assert all_of() == sorted(saved)
    many = len(spark.read.parquet(path).inputFiles())
    live = runs.manifest(spark, path).where("live")
    assert live.count() == 4 < many  # a file for each day and suite
    save(4, range(30, 35), 3)  # appended after the manifest
    assert all_of() == sorted(saved)
    # one run: files of other days are not opened
    one = runs.read_runs(spark, path, run_id="run-120")
    compacted = [f for f in one.inputFiles() if "compacted" in f]
    assert len(compacted) == 2 and all("run_date=2024-01-02" in f for f in compacted)
    assert all_of(run_id="run-031") == [x for x in sorted(saved) if x[0] == "run-031"]
    assert runs.get_run(runs.read_runs(spark, path, run_id="run-031"), "run-031").first()["ingest_seq"] == 4
    assert all_of(since="2024-01-02T00:00:00Z", until="2024-01-02T23:00:00Z") == [x for x in sorted(saved) if x[1] == 3]
    assert all_of(run_id="nothing") == []
    runs.compact_runs(spark, path)
    assert all_of() == sorted(saved)
    runs.compact_runs(spark, path, target_bytes=1)  # nothing is small enough
    assert all_of() == sorted(saved)


def test_a_lost_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", "s"), ("b", "s")], "run_id string, suite_id string")
    for seq in (1, 2):
        runs.save_runs(df, path, seq)
    monkeypatch.setattr(runs, "_described", lambda df, root: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        runs.compact_runs(spark, path)
    assert runs.read_runs(spark, path).count() == 4
    monkeypatch.undo()
    runs.compact_runs(spark, path)
    assert runs.read_runs(spark, path).count() == 4
    assert {r.run_id: r.ingest_seq for r in runs.latest_runs(runs.read_runs(spark, path)).collect()} == {"a": 2, "b": 2}


def stream_rows(spark, folder, rows):
    schema = "run_id string, saved_at timestamp, suite_id string, verdict string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return schema


def run_check(spark, tmp_path, schema, decide=lambda d: d.withColumn("decision", F.col("verdict")), rate=1.0):
    start_spot_check(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), decide, str(tmp_path / "out"),
        str(tmp_path / "state"), key="run_id", time="saved_at", rate=rate, available_now=True,
    ).awaitTermination()


def windows(spark, tmp_path):
    got = current_windows(spark, str(tmp_path / "out")).collect()
    return sorted(((r.window_start.hour, r.suite_id, r.decision, r.n) for r in got), key=str)


def test_spot_check_upserts_windows_and_keeps_late_rows_apart(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = stream_rows(spark, tmp_path / "in", [
        ("a", at(2024, 1, 1, 0, 5), "s", "pass"), ("b", at(2024, 1, 1, 0, 50), "s", "pass"),
        ("c", at(2024, 1, 1, 1, 0), "s", "fail"), ("e", at(2024, 1, 1, 1, 5), None, "fail")])
    run_check(spark, tmp_path, schema)
    assert windows(spark, tmp_path) == sorted([(0, "s", "pass", 2), (1, "s", "fail", 1), (1, None, "fail", 1)], key=str)
    # after 01:05 less ten minutes the first window is open still
    stream_rows(spark, tmp_path / "in", [
        ("f", at(2024, 1, 1, 0, 55), "s", "pass"), ("g", at(2024, 1, 1, 1, 30), None, "fail"),
        ("d", at(2024, 1, 1, 5, 0), "s", "pass")])
    run_check(spark, tmp_path, schema)
    stream_rows(spark, tmp_path / "in", [("late", at(2024, 1, 1, 0, 56), "s", "pass"), ("h", at(2024, 1, 1, 5, 1), "s", "pass")])
    run_check(spark, tmp_path, schema)
    want = sorted([(0, "s", "pass", 3), (1, "s", "fail", 1), (1, None, "fail", 2), (5, "s", "pass", 2)], key=str)
    assert windows(spark, tmp_path) == want
    assert [r.key for r in read_table(spark, out, "late").collect()] == ["late"]
    assert read_table(spark, out, "decisions").count() == 8
    progress = read_table(spark, out, "progress").orderBy("batch").collect()
    assert [(r.seen, r.sampled, r.late) for r in progress] == [(4, 4, 0), (3, 3, 0), (2, 2, 1)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    check = SpotCheck(lambda d: d.withColumn("decision", F.lit("pass")), str(tmp_path / "out"), "k", "t", 1.0, "1 hour", "10 minutes")
    make = lambda *hours: spark.createDataFrame([(h, at(2024, 1, 1, h), "s") for h in hours], "k long, t timestamp, suite_id string")
    check(make(1, 1, 3), 0)
    check(make(1, 3, 4), 1)
    before = windows(spark, tmp_path)
    check(make(1, 3, 4), 1)
    assert windows(spark, tmp_path) == before
    assert read_table(spark, str(tmp_path / "out"), "late").count() == 1  # the hour from 01:00 has closed by 02:50


def test_failed_batches_are_redone_from_the_checkpoint(spark, tmp_path):
    schema = stream_rows(spark, tmp_path / "in", [(str(i), at(2024, 1, 1, i % 5), "s", "pass") for i in range(50)])

    def broken(d):
        raise RuntimeError("the gate is down")

    with pytest.raises(Exception, match="the gate is down"):
        run_check(spark, tmp_path, schema, broken)
    run_check(spark, tmp_path, schema)
    assert sum(n for *_, n in windows(spark, tmp_path)) == 50


def test_sampling_keeps_the_same_share_of_keys(spark, tmp_path):
    keys = spark.range(2000)
    half = {r.id for r in keys.where(sampled(F.col("id"), 0.5)).collect()}
    assert 900 < len(half) < 1100
    assert {r.id for r in keys.where(sampled(F.col("id"), 0.25)).collect()} < half
    assert keys.where(sampled(F.col("id"), 1.0)).count() == 2000 and keys.where(sampled(F.col("id"), 0.0)).count() == 0
    schema = stream_rows(spark, tmp_path / "in", [(str(i), at(2024, 1, 1, 1), "s", "pass") for i in range(200)])
    run_check(spark, tmp_path, schema, rate=0.5)
    assert sum(n for *_, n in windows(spark, tmp_path)) == len(half & set(range(200)))


def test_shared_folder_follows_the_cluster_setting(spark):
    conf = SimpleNamespace(get=lambda key, default=None: "hdfs:///shared/")
    assert shared_folder(SimpleNamespace(conf=conf), "x").startswith("hdfs:///shared/x-")
    assert os.path.isabs(shared_folder(spark, "x"))  # unset, and a local master


def test_pair_fixture_has_the_surveyed_counts(spark):
    sf = "/root/testdata/sf0.01"
    rating = entry_point.queries()["content_rating"](spark, sf)
    got = {r["rating"]: r["n"] for r in rating.groupBy("rating").agg(F.sum("n").alias("n")).collect()}
    assert got == {"G": 328, "PG": 594, "PG-13": 26, "R": 52}
    claims = entry_point.queries()["verify_numerical"](spark, SF)
    assert claims.filter("verified").count() == 1125 and claims.count() == 1500


def test_scan_reads_only_what_the_query_needs(spark):
    df = fixtures.samples(spark, SF).select("generated")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


DUCK = """
import sys, json, duckdb
c = duckdb.connect()
for t in ("documents", "labels", "conversations", "benchmark", "orders", "events"):
    c.execute(f"create view {t} as select * from '{sys.argv[1]}/{t}.parquet'")
cur = c.execute(sys.stdin.read())
names = [d[0] for d in cur.description]
print(json.dumps([names, cur.fetchall()], default=str))
"""


@pytest.mark.parametrize(
    "name",
    ["decisions_by_suite", "wilcoxon_signed_rank", "hallucination_score", "factual_score",
     "safety_score", "quality_score", "detect_pii", "save_run", "ab_json_source"],
)
def test_oracle(spark, name):
    done = subprocess.run(
        [sys.executable, "-c", DUCK, SF], input=entry_point.oracle_sql()[name], text=True,
        capture_output=True, check=True, env=dict(os.environ))
    names, want = json.loads(done.stdout)
    df = entry_point.queries()[name](spark, SF)
    got = [list(r) for r in df.select(*names).collect()]
    assert len(got) > 0 and sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_of_the_library_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE) <= set(entry_point.oracle_sql())


def test_small_files_of_the_history_have_small_filters(spark, tmp_path):
    import pathlib

    from assayline.sources import runs as history

    runs = spark.range(2000).selectExpr(
        "concat('run-', uuid()) run_id", "'2024-01-01T00:00:00Z' created_at", "'s' suite_id", "'pass' decision"
    )
    path = str(tmp_path / "runs")
    history.save_runs(runs, path, 1)
    history.save_runs(runs, path, 2)
    history.compact_runs(spark, path)
    files = [f.stat().st_size for f in pathlib.Path(tmp_path).rglob("*.parquet")]
    # 2,000 distinct ids: a filter of the default size alone takes a megabyte in each file
    assert len(files) > 2 and max(files) < 600_000
    assert history.read_runs(spark, path).count() == 4000


def test_ab_documents_are_parsed_once(spark):
    from assayline.sources import ab_json

    docs = spark.createDataFrame(
        [(1, '{"model_a":{"outputs":["x"]},"model_b":{"outputs":["y"]}}'), (2, "["), (3, None)], "doc_id long, value string"
    )
    for df in (ab_json.parse_ab(docs, comparable=True), ab_json.quarantined_ab(docs)):
        assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 1
    assert ab_json.parse_ab(docs, comparable=True).count() == 2
    assert {r.doc_id: r.reason for r in ab_json.quarantined_ab(docs).collect()} == {2: "not valid JSON", 3: "no document"}
