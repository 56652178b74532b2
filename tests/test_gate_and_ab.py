import math
import random

import pytest
from pyspark.sql import functions as F

from assayline.functions import stats
from assayline.plans import ab, gate, monitoring, report
from assayline.plans.monitoring import enforcement_level, regressed_dimensions, weighted_score
from assayline.settings import BUILT_IN, Settings, Slot

# --- decisions


@pytest.mark.parametrize(
    "flags, agg, base, floor, block, code, reason",
    [
        (["x", "toxic", "bad"], 0.9, 0.8, 0.8, ["bad", "toxic"], "1", "Blocked on critical flag: toxic"),
        ([], 0.5, 0.9, 0.8, ["toxic"], "2", "Aggregate score 0.50 is below minimum threshold 0.80"),
        ([], 0.8, None, 0.8, [], "5b", "Candidate meets all promotion criteria."),
        ([], 0.8, 0.8, 0.8, [], "5a",
         "Candidate meets or exceeds baseline aggregate score with no critical regressions."),
        (["a", "b"], 0.9, 0.9, 0.8, ["c"], "4", "Passed thresholds but flagged for review: a, b"),
        ([], 0.85, 0.8999999, 0.8, [], "3b",
         "Slight regression: Candidate (0.85) vs Baseline (0.90). Requires review."),
        ([], 0.8499999, 0.9, 0.8, [], "3a",
         "Regression detected: Candidate (0.85) is significantly worse than Baseline (0.90)"),
        ([], 0.85, 0.9, 0.8, [], None, None),
        (["pii:email"], 0.9, None, 0.8, ["pii"], "4",
         "Passed thresholds but flagged for review: pii:email"),
    ],
)
def test_cascade(spark, flags, agg, base, floor, block, code, reason):
    df = spark.createDataFrame(
        [(flags, agg, base, floor, block)],
        "flags array<string>, aggregate_score double, baseline_aggregate_score double, "
        "min_score double, block_on_flags array<string>")
    r = gate.with_decision(df).first()
    if code is None:  # at the margin the doubles decide
        assert r["reason_code"] == ("3a" if agg < base - 0.05 else "3b")
        return
    assert (r["reason_code"], r["reason"]) == (code, reason)
    assert r["decision"] == {"1": "fail", "2": "fail", "3a": "fail", "3b": "human_review",
                             "4": "human_review"}.get(code, "pass")


REQUEST = (
    "request_id long, suite_id string, task_type string, prompt string, source string, "
    "candidate_id string, candidate string, baseline_id string, baseline string, "
    "candidate_toxicity map<string,double>, baseline_toxicity map<string,double>, "
    "min_score double, block_on_flags array<string>, metadata string, "
    "version_metadata struct<suite_version:string>, store_full_payloads boolean, run_id string"
)


def requests(spark, keep=False):
    src = "The harbour stayed closed this morning because of thick fog."
    tox = {"toxicity": 0.01}
    return spark.createDataFrame(
        [(1, "default", "summary", "What happened?", src, "v2",
          "Thick fog kept the harbour closed this morning.", "v1", "The harbour stayed closed.",
          tox, tox, 0.5, ["critical_error"], "{}", ("v1.0",), keep, "run-1"),
         (2, "default", "summary", "p", "", "c", "o", None, None, tox, None, 0.0, [], "{}",
          ("v1.0",), keep, "run-2")], REQUEST)


def test_gate_end_to_end(spark):
    a, b = gate.decide(requests(spark)).orderBy("request_id").collect()
    assert a["decision"] in ("pass", "fail", "human_review")
    assert a["aggregate_score"] == sum([a["subscores"][n] for n in BUILT_IN]) / 4
    assert a["baseline_aggregate_score"] is not None
    assert a["evaluator_method"] == "Deterministic + Heuristic Fallback"
    # No source: both guards flag, and the score adds no second hallucination flag.
    assert list(b["flags"]) == ["hallucination", "factual", "quality:coherence", "quality:fluency",
                                "quality:relevance"]
    assert b["baseline_aggregate_score"] is None and b["reason_code"] == "4"


def test_no_evaluators_score_zero(spark):
    r = gate.decide(requests(spark), names=[]).orderBy("request_id").first()
    assert (r["aggregate_score"], list(r["flags"]), r["subscores"]) == (0.0, [], {})
    assert r["evaluator_method"] == "Deterministic Only"


@pytest.mark.parametrize("keep", [True, False])
def test_run_records_redact(spark, keep):
    r = gate.run_records(gate.decide(requests(spark, keep))).filter("run_id = 'run-1'").first()
    assert r["status"] == "completed" and r["created_at"].endswith("Z")
    assert (r["input"] is not None) is keep and (r["candidate_output"] is not None) is keep
    assert r["input_redacted"] is (None if keep else True)
    assert r["version_metadata"]["suite_version"] == "v1.0"


# --- statistics


def test_tail_constants():
    assert stats.t_two_sided(2.0, 29) == pytest.approx(0.0549436371829666, abs=1e-14)
    assert stats.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-14)
    assert stats.t_two_sided(-3.0, 1e6) == pytest.approx(0.0026999, abs=1e-5)
    assert stats.t_two_sided(math.inf, 29) == 0.0 and math.isnan(stats.t_two_sided(math.nan, 9))
    assert stats.signed_rank_two_sided(8, 10, 0) == 50 / 1024
    assert stats.normal_two_sided(0.0) == 1.0


def pairs(spark, groups, parts=3):
    rows = [(g, "e", 0, float(a), float(b)) for g, ds in groups.items() for a, b in ds]
    df = spark.createDataFrame(
        rows, "suite_id string, evaluator string, evaluator_order int, score_a double, score_b double")
    return df.repartition(parts)


BY = ["suite_id", "evaluator_order", "evaluator"]


def test_special_cases(spark):
    got = {r["suite_id"]: r for r in ab.compare(pairs(spark, {
        "equal29": [(0.5, 0.5)] * 29, "equal30": [(0.5, 0.5)] * 30,
        "shift30": [(0.6, 0.5)] * 30, "down30": [(0.5, 0.6)] * 30,
        "single": [(0.5, 0.5)] * 5 + [(0.9, 0.5)],
        "exact": [(0.5, 0.5 - d / 100) for d in (1, 2, 3, 4, 5, 6, 7, 9, 10)] + [(0.5, 0.58)],
        "tied": [(0.75, 0.5)] * 6 + [(0.5, 0.75)],
        "single_sample": [(0.9, 0.1)],
    }), BY).collect()}
    assert (got["equal29"]["method"], got["equal29"]["p_value"], got["equal29"]["winner"]) == ("none", 1.0, "tie")
    assert math.isnan(got["equal30"]["p_value"]) and got["equal30"]["winner"] == "tie"
    assert got["equal30"]["test"] == 0 and got["equal29"]["test"] == 1
    assert got["shift30"]["p_value"] == 0.0 and got["shift30"]["winner"] == "model_a"
    assert got["down30"]["winner"] == "model_b" and got["down30"]["t_statistic"] == -math.inf
    assert got["shift30"]["effect_size"] == pytest.approx(0.1 / 1e-10)
    assert got["single"]["p_value"] == 1.0 and got["single"]["w_statistic"] is None
    assert (got["exact"]["method"], got["exact"]["w_statistic"]) == ("wilcoxon_exact", 8.0)
    assert got["exact"]["p_value"] == round(50 / 1024, 6)
    assert got["tied"]["method"] == "wilcoxon_normal" and got["tied"]["w_statistic"] == 4.0
    variance = (7 * 8 * 15 - (7**3 - 7) / 2) / 24
    assert got["tied"]["p_value"] == pytest.approx(
        math.erfc(abs(4 - 14) / math.sqrt(variance) / math.sqrt(2)), abs=1e-6)
    assert got["single_sample"]["p_value"] == 1.0


def brute(ds):
    d = [a - b for a, b in ds]
    n, mean = len(d), sum(d) / len(d)
    std = math.sqrt(sum((x - mean) ** 2 for x in d) / n)
    out = {"mean_diff": mean, "effect": mean / max(std, 1e-10)}
    nz = sorted((x for x in d if x != 0), key=abs)
    ranks, i = {}, 0
    while i < len(nz):
        j = i
        while j < len(nz) and abs(nz[j]) == abs(nz[i]):
            j += 1
        ranks[abs(nz[i])] = (i + 1 + j) / 2
        i = j
    out["w"] = min(sum(ranks[abs(x)] for x in nz if x > 0), sum(ranks[abs(x)] for x in nz if x < 0))
    if n > 1 and std:
        out["t"] = mean / (std * math.sqrt(n / (n - 1)) / math.sqrt(n))
    return out


def test_against_brute_force_whatever_the_partitions(spark):
    rng = random.Random(11)
    grid = [round(k / 15, 4) for k in range(5, 16)]
    groups = {f"g{n}": [(rng.choice(grid), rng.choice(grid)) for _ in range(n)]
              for n in (2, 7, 29, 30, 400)}
    first = ab.compare(pairs(spark, groups, 1), BY).orderBy("suite_id").collect()
    assert first == ab.compare(pairs(spark, groups, 16), BY).orderBy("suite_id").collect()
    for r in first:
        want = brute(groups[r["suite_id"]])
        assert r["mean_diff"] == pytest.approx(want["mean_diff"], abs=1e-6)
        assert r["effect_size"] == pytest.approx(want["effect"], abs=1e-5)
        if r["test"] == 0:
            assert r["t_statistic"] == pytest.approx(want["t"], abs=1e-5)
        elif r["w_statistic"] is not None:
            assert r["w_statistic"] == want["w"]


def test_raw_scores_have_exact_ranks_whatever_the_partitions(spark):
    rng = random.Random(12)
    groups = {f"g{n}": [(rng.random(), rng.choice([rng.random(), 0.25])) for _ in range(n)] for n in (1, 2, 7, 29, 30, 500)}
    groups["ties"] = [(x, y) for x in (0.1, 1 / 3, 1e-9, 3.5e5) for y in (0.1, 2 / 7, 1e-9)] * 4
    groups["equal"] = [(0.3, 0.3)] * 40
    groups["shift"] = [(0.75, 0.5)] * 40
    groups[None] = [(1.0, 2.0), (5.0, 3.0), (2.0, 1.0)]
    first = ab.raw_statistics(pairs(spark, groups, 1), BY).orderBy("suite_id").collect()
    again = ab.raw_statistics(pairs(spark, groups, 16), BY).orderBy("suite_id").collect()
    assert str(first) == str(again)  # as text, since a test statistic may be undefined
    for r in first:
        want = brute(groups[r["suite_id"]])
        assert r["w"] == want["w"], r["suite_id"]
        assert r["mean_diff"] == pytest.approx(want["mean_diff"], rel=1e-12, abs=1e-15)
        assert r["effect_size"] == pytest.approx(want["effect"], rel=1e-9)
        a = [x for x, _ in groups[r["suite_id"]]]
        mean = sum(a) / len(a)
        assert r["std_a"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in a) / len(a)), rel=1e-9, abs=1e-12)
        if "t" in want and r["suite_id"] != "shift":
            assert r["t"] == pytest.approx(want["t"], rel=1e-9)
    by_suite = {r["suite_id"]: r for r in first}
    assert by_suite["shift"]["t"] == math.inf and math.isnan(by_suite["equal"]["t"]) and by_suite["equal"]["n_nonzero"] == 0
    won = {r["suite_id"]: r["winner"] for r in ab.compare(pairs(spark, groups), BY, raw=True).collect()}
    assert won["shift"] == "model_a" and won["equal"] == "tie"


def test_no_window_holds_a_whole_suite_of_raw_scores(spark):
    plan = ab.raw_statistics(pairs(spark, {"s": [(0.1, 0.2)]}), BY)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert len(windows) == 2 and all("bucket" in line for line in windows)


def test_a_hot_suite_is_folded_before_the_shuffle(spark):
    plan = ab.paired_statistics(pairs(spark, {"s": [(0.1, 0.2)]}), BY)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.index("partial_count") > 0 and "collect_list" not in text


def test_overall_winner_and_ci(spark):
    rows = [("s", "a", 0.4, 0.6, "model_b"), ("s", "b", 0.9, 0.2, "model_a"),
            ("t", "a", 0.4, 0.4, "tie"), ("u", "a", 0.9, 0.9, "model_a")]
    df = spark.createDataFrame(rows, "suite_id string, evaluator string, mean_a double, mean_b double, winner string")
    won = ab.overall_winner(df, ["suite_id"], F.lit("m1"), F.lit("m2"))
    assert {r["suite_id"]: r["overall_winner"] for r in won.collect()} == {"s": "tie", "t": "tie", "u": "m1"}
    ci = {r["suite_id"]: r["passed"] for r in report.ci_verdict(df, ["suite_id"]).collect()}
    assert ci == {"s": True, "t": False, "u": True}
    assert df.limit(0).agg(report.all_passed(F.lit(True))).first()[0] is True


def test_unpaired_outputs_are_reported(spark):
    df = spark.createDataFrame(
        [("s", 0, "a", "x"), ("s", 0, "b", "y"), ("s", 1, "a", "z")],
        "suite_id string, sample_index int, slot string, generated string")
    got = ab.pair_outputs(df).orderBy("sample_index").collect()
    assert [(r["generated_a"], r["generated_b"], r["paired"]) for r in got] == [
        ("x", "y", True), ("z", None, False)]


def test_extensions(spark):
    df = spark.createDataFrame([(0.5, 1.0)], "a double, b double")
    r = df.select(
        weighted_score({"hallucination": F.col("a"), "quality": F.col("b")}).alias("w"),
        enforcement_level(F.lit("3a"), F.lit(False)).alias("l"),
        enforcement_level(F.lit("5b"), F.lit(True)).alias("h"),
        regressed_dimensions({"x": F.col("a"), "y": F.col("b")},
                             {"x": F.col("b"), "y": F.col("a")}).alias("d")).first()
    assert r["w"] == pytest.approx(0.7) and (r["l"], r["h"]) == ("ticket", "hard_gate")
    assert list(r["d"]) == ["x"]
    assert Slot().prefix == "" and Settings().is_enabled("quality")


def test_metrics_by_suite_and_evaluator_merge(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["s", "t"]), rng.choice(["m", "n"]), round(rng.random(), 4), round(rng.random(), 4) if i % 3 else None,
         "down" if i % 10 == 0 else None)
        for i in range(4000)
    ] + [("u", "m", None, None, "down")]
    df = spark.createDataFrame(rows, "suite_id string, evaluator string, score double, baseline double, error string")
    whole = monitoring.metric_report(monitoring.metric_partials(df)).collect()
    parts = [monitoring.metric_partials(df.where(F.expr(c))) for c in ("score < 0.3", "score >= 0.3 or score is null")]
    merged = monitoring.metric_report(parts[0].union(parts[1])).collect()
    exact = ("results", "errors", "scored", "regressions", "error_rate", "mean_score", "sketched")
    key = lambda r: (r.level, r.suite_id, r.evaluator)
    assert {key(r): [r[c] for c in exact] for r in whole} == {key(r): [r[c] for c in exact] for r in merged}
    assert len(whole) == 5 + 3 + 2 + 1
    for r in merged:
        own = [x for x in rows if r.suite_id in (None, x[0]) and r.evaluator in (None, x[1])]
        good = [x for x in own if x[4] is None]
        assert (r.results, r.errors, r.scored) == (len(own), len(own) - len(good), len(good))
        assert r.regressions == sum(x[3] is not None and x[2] < x[3] for x in good)
        if not good:
            assert r.mean_score is None and r.p50 is None and r.error_rate == 1.0
            continue
        assert r.mean_score == pytest.approx(sum(x[2] for x in good) / len(good), abs=1e-9)
        for q, got in ((0.5, r.p50), (0.05, r.p05)):
            assert abs(sum(x[2] <= got for x in good) / len(good) - q) < 0.03


def test_scores_are_computed_once_for_a_report_and_its_winner(spark):
    pairs = spark.createDataFrame(
        [("s", 0, "quality", 0.5 + i / 100, 0.25) for i in range(40)],
        "suite_id string, evaluator_order int, evaluator string, score_a double, score_b double",
    )
    result = ab.compare(pairs, ["suite_id", "evaluator_order", "evaluator"])
    a, b = F.lit("x"), F.lit("y")
    overall = ab.overall_winner(result, ["suite_id"], a, b).select("suite_id", "overall_winner")
    documents = report.json_reports(result, overall, "suite_id", a, b, F.lit("now"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = documents._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("Scan ExistingRDD") == 1
    assert '"overall_winner":"x"' in documents.first()["report"]
