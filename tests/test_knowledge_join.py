"""The set-cosine join of knowledge bases, against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline.operators import knowledge


def _sets(rng, n, longest):
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return {tuple(sorted(set(rng.choices(words, weights, k=rng.randint(1, longest))))) for _ in range(n)}


@pytest.mark.parametrize(("floor", "most", "long"), [(0.65, 20, 96), (0.65, 60, 6), (0.3, 8, 5), (1.0, 0, 96)])
def test_every_best_fact_is_found(spark, monkeypatch, floor, most, long):
    monkeypatch.setattr(knowledge, "LONG", long)
    rng = random.Random(floor * 10 + long)
    facts, asked = sorted(_sets(rng, 150, 14)), sorted(_sets(rng, 80, 14))
    asked += [facts[3], facts[4] + ("zz",)]
    asked = sorted(set(asked))
    known = spark.createDataFrame([(i, list(f)) for i, f in enumerate(facts)], "fact_id long, words array<string>")
    sentences = spark.createDataFrame([(list(a),) for a in asked], "words array<string>")
    got = {tuple(r.words): (r.similarity, r.fact_id) for r in knowledge.similar_sets(sentences, known, floor, most).collect()}
    want = {}
    for a in asked:
        likeness = [(len(set(a) & set(f)) / math.sqrt(len(a) * len(f)), -i) for i, f in enumerate(facts)]
        best, back = max(likeness)
        if best >= floor:
            want[a] = (best, -back)
    assert got == want and len(want) > 1


def test_a_frequent_word_alone_does_not_make_sets_meet(spark):
    sets = [[f"own{i}{j}" for j in range(4)] + ["the", "of", "and", "for"] for i in range(8)]
    words = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, words array<string>")
    frequent = knowledge.frequent_words(words, 3)
    keys = knowledge.keyed(words, frequent, 0.65).collect()
    assert len(frequent) == 3 and {k["id"] for k in keys} == set(range(8))
    # 8 - ceil(0.65**2 * 8) + 1 words: at most one of them is common to all, and that one is not frequent
    assert len({k["hash"] for k in keys}) >= len(keys) - 7


def test_keys_of_long_sets_are_no_pairs():
    size = 4 * knowledge.LONG
    keys = knowledge.set_keys(pa.array([list(range(size))], pa.list_(pa.int64())), np.arange(size), 0.65)
    assert len(keys.field("keys").flatten()) <= size


@pytest.mark.parametrize("most_keys", [0, 1 << 21])
def test_only_sentences_that_can_meet_a_fact_are_moved(spark, monkeypatch, most_keys):
    monkeypatch.setattr(knowledge, "MOST_KEYS", most_keys)
    rng = random.Random(3)
    facts, asked = sorted(_sets(rng, 30, 14)), sorted(_sets(rng, 200, 14))
    known = spark.createDataFrame([(i, list(f)) for i, f in enumerate(facts)] + [(99, list(facts[0]))], "fact_id long, words array<string>")
    sentences = spark.createDataFrame([(list(a),) for a in asked] + [([],)], "words array<string>")
    likely = {tuple(r.words) for r in knowledge._likely(sentences, known, 0.65, 10)[0].collect()}
    like = {a for a in asked if any(len({*a} & {*f}) / math.sqrt(len(a) * len(f)) >= 0.65 for f in facts)}
    assert like <= likely and (len(likely) < len(asked) if most_keys else likely == {*asked})
    best = {tuple(r.words): r.fact_id for r in knowledge.similar_sets(sentences, known, 0.65, 10).collect()}
    assert {*best} == like and 99 not in best.values()


def test_words_of_facts_are_shuffled_once(spark):
    sets = spark.createDataFrame([(i, ["a", "b", f"w{i}"]) for i in range(40)], "fact_id long, words array<string>")
    keys = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ["false", "-1"], strict=True):
        spark.conf.set(k, v)
    try:
        plan = knowledge.similar_sets(sets, sets, 0.65)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") <= 3, plan
