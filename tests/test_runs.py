"""Arrow functions: one worker per task for all of them, and bounded work per call."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline import session
from assayline.functions import batches, lexical, rules
from assayline.operators.registry import evaluate
from assayline.session import BATCH_BYTES, bound_batches
from assayline.settings import BUILT_IN, Slot


def test_all_evaluators_and_slots_share_one_python_projection(spark):
    rows = spark.createDataFrame(
        [("The sky is blue today. Water is wet and cold.", "The sky is green today.", "The sky is blue.", "Why?", {"t": 0.1})],
        "candidate string, baseline string, source string, prompt string, toxicity map<string,double>",
    )
    slots = (Slot(text="candidate", prefix="a_"), Slot(text="baseline", prefix="b_"))
    scored = evaluate(rows, slots, names=BUILT_IN, parts=("score",))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    both = scored.first()
    for slot in slots:
        for name in BUILT_IN:
            alone = evaluate(rows, slot, names=[name], parts=("score",)).first()
            assert both[slot.out(f"{name}_score")] == alone[slot.out(f"{name}_score")]


def test_row_bytes_of_nested_slices():
    rows = pa.array([[["ab", "c"], []], None, [["defg"]], []], pa.list_(pa.list_(pa.string())))
    sizes = batches.row_bytes(rows)
    assert sizes[1] == sizes[3] == 0 and sizes[0] > sizes[2] > 4
    assert batches.row_bytes(rows.slice(2)).tolist() == sizes[2:].tolist()
    assert batches.row_bytes(pa.array(["ab", None, "ü"])).tolist() == [2, 0, 2]


@pytest.mark.parametrize("most", [1, 60, 1 << 20])
def test_runs_give_what_the_whole_batch_gives(most):
    sets = pa.array(
        [[["a", "b"], ["c"]], [], None, [["d", "e", "f"]], [["a"], ["b", "d"], []]] * 7, pa.list_(pa.list_(pa.string()))
    )
    whole = pa.array([["a", "c"], ["x"], [], ["f"], None] * 7, pa.list_(pa.string()))
    seen = []

    def grounding(s, w):
        seen.append(len(s))
        return lexical._grounding(s, w)

    assert batches.in_runs(grounding, sets, whole, most=most) == lexical._grounding(sets, whole)
    assert sum(seen) == len(sets) and (most > 60 or max(seen) < len(sets))
    assert batches.in_runs(lambda s, e: lexical._matches(s, e, [["a"]]), sets, sets, most=most) == lexical._matches(
        sets, sets, [["a"]]
    )


def test_a_large_batch_is_unpacked_in_runs(monkeypatch):
    calls = []
    monkeypatch.setattr(lexical, "_grounding", lambda s, w: calls.append(len(s)) or pa.array([None] * len(s), pa.int32()))
    sets = pa.array([[["word" * 250] * 10]] * 1000, pa.list_(pa.list_(pa.string())))
    words = pa.array([["word"]] * 1000, pa.list_(pa.string()))
    batches.in_runs(lexical._grounding, sets, words)
    assert sum(calls) == 1000 and max(calls) * 10_000 <= batches.RUN_BYTES
    assert rules.in_runs is batches.in_runs and lexical.in_runs is batches.in_runs


KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("setting", ["64m", "2147483647"])
def test_evaluators_get_small_batches_whatever_the_session_says(spark, setting):
    own = spark.newSession()
    own.conf.set(KEY, setting)
    rows = own.range(0, 2000, 1, 1).select(
        F.concat(F.repeat(F.lit("The sky is blue today. "), 500), F.col("id").cast("string")).alias("generated"),
        F.lit("The sky is green.").alias("source"),
    )
    scored = evaluate(rows, names=["hallucination"], parts=("score",))
    batch = F.arrow_udf(lambda texts: pa.array([texts.nbytes] * len(texts)), "long").asNondeterministic()
    sizes = scored.select(batch("generated").alias("n"), "hallucination_score").agg(F.max("n"), F.count("n")).first()
    assert sizes[1] == 2000 and sizes[0] < BATCH_BYTES + 20_000


@pytest.mark.parametrize("setting, bound", [("64k", 65536), ("1048576", 1048576), ("4mb", 4194304), ("1g", 4194304)])
def test_a_smaller_bound_of_the_session_stays(spark, setting, bound):
    own = spark.newSession()
    own.conf.set(KEY, setting)
    bound_batches(own)
    assert session._bytes(own.conf.get(KEY)) == bound
