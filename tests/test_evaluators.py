import math
import random
import re

import pytest
from pyspark.sql import functions as F

from assayline.functions import brand
from assayline.functions.expr import elements
from assayline.functions.lexical import best_matches, sentence_grounding
from assayline.functions.text import split_sentences
from assayline.functions.vectors import best_vector_matches, vector_cosines
from assayline.operators import quality
from assayline.operators.hallucination import nli_label
from assayline.operators.knowledge import indexed, match_with_knowledge
from assayline.operators.registry import (
    available_evaluators, enabled_evaluators, evaluate, get_evaluator, register, unregister,
)
from assayline.operators.results import passed_from_flags, result_json, result_rows
from assayline.schema import CRITICAL, WARNING, flag
from assayline.settings import (
    BUILT_IN, FactualSettings, HallucinationSettings, SafetySettings, Settings, Slot,
)

CALM = {"toxicity": 0.05, "insult": 0.03}


def rows(spark, data):
    full = [(i, *d) for i, d in enumerate(data)]
    return spark.createDataFrame(
        full,
        "sample_id long, generated string, source string, prompt string, "
        "toxicity map<string,double>",
    )


def score(spark, names, generated, source="", prompt="", tox=CALM, settings=Settings(), slot=Slot()):
    return evaluate(rows(spark, [(generated, source, prompt, tox)]), slot, settings, names).first()


# --- safety


def test_brand_violations_one_per_occurrence(spark):
    settings = Settings(content_safety=SafetySettings(
        forbidden_terms=("murder",), forbidden_topics=("politics", "gambling"),
        competitor_names=("Netflix",)))
    text = "No murder, no gambling, and politics only at noon. Murder? NETFLIX netflix"
    r = score(spark, ["content_safety"], text, settings=settings)
    got = [(v["type"], v["value"], v["start"]) for v in r["content_safety_details"]["brand_violations"]]
    assert got == [
        ("forbidden_term", "murder", 3), ("forbidden_term", "murder", 51),
        ("forbidden_topic", "politics", 28), ("forbidden_topic", "gambling", 14),
        ("competitor_mention", "Netflix", None),
    ]
    assert r["content_safety_sub_scores"]["brand_alignment"] == 0.5
    assert r["content_safety_flags"][0]["message"] == (
        "Brand violation: {'type': 'forbidden_term', 'term': 'murder', 'span': (3, 9)}")
    assert r["content_safety_flags"][-1]["message"] == (
        "Brand violation: {'type': 'competitor_mention', 'name': 'Netflix'}")
    assert list(r["content_safety_categories"]) == [f["category"] for f in r["content_safety_flags"]]


def test_empty_rule_list_falls_back_to_the_defaults(spark):
    r = score(spark, ["content_safety"], "They kill for politics, and ſlaughter.")
    assert [v["value"] for v in r["content_safety_details"]["brand_violations"]] == [
        "kill", "slaughter", "politics"]


@pytest.mark.parametrize(
    "tox, issues, rating",
    [(0.05, 0, "G"), (0.2, 1, "PG"), (0.8, 7, "R"), (0.1, 0, "PG"), (0.05, 1, "PG"),
     (0.59, 3, "PG-13"), (0.59, 4, "R"), (0.6, 0, "R")],
)
def test_content_rating(spark, tox, issues, rating):
    df = spark.createDataFrame([(tox, issues)], "t double, i int")
    assert df.select(brand.content_rating(F.col("t"), F.col("i"))).first()[0] == rating


def test_safety_flags_scores_and_severity(spark):
    text = "Ask p.lind@example.org or ring 415-867-5309."
    r = score(spark, ["content_safety"], text, tox={"toxicity": 0.5, "threat": 0.0625, "insult": 0.9})
    assert list(r["content_safety_categories"]) == [
        "toxicity:toxicity", "toxicity:insult", "pii:email", "pii:phone_us"]
    assert [f["message"] for f in r["content_safety_flags"]] == [
        "High toxicity score: 0.500", "High insult score: 0.900",
        "PII detected (email): p.lind@example.org...", "PII detected (phone_us): 415-867-5309..."]
    assert {f["severity"] for f in r["content_safety_flags"]} == {CRITICAL}
    assert not r["content_safety_passed"]
    assert r["content_safety_score"] == round((1 - 0.9 + 1 + max(0.0, 1 - 0.2 * 2)) / 3, 4)
    soft = Settings(content_safety=SafetySettings(pii_is_critical=False))
    assert score(spark, ["content_safety"], text, settings=soft)["content_safety_passed"]
    clean = score(spark, ["content_safety"], "Rain is due in the valley by the evening.", tox={})
    assert clean["content_safety_score"] == 1.0
    assert clean["content_safety_details"]["content_rating"] == "G"


def test_failed_evaluator_scores_zero_without_flags(spark):
    r = evaluate(rows(spark, [(None, "src", "p", CALM), ("text a@b.com", "", "p", None)]),
                 names=["content_safety", "quality", "factual_accuracy"]).orderBy("sample_id").collect()
    assert r[0]["quality_error"] and r[0]["quality_score"] == 0.0 and r[0]["quality_flags"] == []
    assert r[0]["factual_accuracy_error"] and r[0]["content_safety_passed"]
    assert r[1]["content_safety_error"] and r[1]["content_safety_score"] == 0.0
    assert list(r[1]["content_safety_categories"]) == []
    assert r[1]["factual_accuracy_error"] is None  # the source guard comes first


# --- quality


@pytest.mark.parametrize(
    "mean, level", [(4.9, 2), (5.0, 3), (9.9, 3), (10.0, 4), (25.0, 4), (25.1, 3), (40.0, 3), (40.1, 2)]
)
def test_fluency_edges(spark, mean, level):
    df = spark.createDataFrame([(mean,)], "m double")
    assert df.select(quality.fluency(F.col("m"))).first()[0] == level


@pytest.mark.parametrize(
    "text, level",
    [("plain", 2), ("However it is", 3), ("however however", 3),
     ("However, therefore, and for example", 4)],
)
def test_coherence_counts_distinct_phrases(one, text, level):
    assert one(lambda c: quality.coherence(quality.transition_count(c)), text) == level


@pytest.mark.parametrize(
    "prompt, level",
    [("", 3), ("  ", 2), (None, 3), ("a x y z w", 2), ("a b x y z", 3), ("a b c x y", 4)],
)
def test_relevance(spark, prompt, level):
    df = spark.createDataFrame([("A b c d", prompt)], "t string, p string")
    assert df.select(quality.relevance(F.col("t"), F.col("p"))).first()[0] == level


def test_quality_judge_or_rules(spark):
    judge = "struct<coherence:int,fluency:int,coherence_rationale:string>"
    df = rows(spark, [("Some words here", "", "other", CALM), ("Some words here", "", "", CALM)])
    df = df.withColumn("judge", F.when(F.col("sample_id") == 0, F.struct(
        F.lit(2).alias("coherence"), F.lit(7).alias("fluency"),
        F.lit("weak").alias("coherence_rationale"))).cast(judge))
    df = df.withColumn("judge", F.col("judge").cast(
        "struct<coherence:int,fluency:int,coherence_rationale:string>"))
    df = df.withColumn("judge", F.when(F.col("judge").isNotNull(), F.struct(
        "judge.coherence", "judge.fluency", F.lit(None).cast("int").alias("relevance"),
        "judge.coherence_rationale")))
    a, b = evaluate(df, Slot(judge="judge"), names=["quality"]).orderBy("sample_id").collect()
    assert (a["quality_method"], a["quality_score"]) == ("judge", round(12 / 15, 4))
    assert a["quality_details"]["judge_out_of_range"]
    assert a["quality_flags"][0]["message"] == "Low coherence score: 2/5 — weak"
    assert b["quality_method"] == "heuristic" and b["quality_score"] == round(7 / 15, 4)
    assert [f["category"] for f in b["quality_flags"]] == ["quality:coherence", "quality:fluency"]
    assert b["quality_flags"][1]["message"].endswith("avg sentence length = 3.0 words.")


# --- grounding


def words(t):
    return set(re.findall(r"\w+", t.lower()))


def test_lexical_scores_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    data = []
    for i in range(40):
        def some(n):
            return [[rng.choice(vocabulary) for _ in range(rng.randint(0, 8))] for _ in range(n)]
        big = i % 13 == 12
        data.append((i, [sorted(set(s)) for s in some(90 if big else rng.randint(0, 5))],
                     [sorted(set(s)) for s in some(60 if big else rng.randint(1, 5))]))
    df = spark.createDataFrame(data, "i int, s array<array<string>>, e array<array<string>>")
    facts = ["w1 w2 w3", "w5"]
    got = df.repartition(3).select(
        "i",
        best_matches(F.col("s"), F.col("e")).alias("m"),
        best_matches(F.col("s"), F.col("e"), facts).alias("f"),
        sentence_grounding(F.col("s"), F.array_distinct(F.flatten("e"))).alias("g"),
    ).orderBy("i").collect()

    def cosine(a, b):
        return len(set(a) & set(b)) / math.sqrt(len(a) * len(b)) if a and b else 0.0

    def first_best(s, evidence):
        sims = [cosine(s, e) for e in evidence]
        return (max(sims), sims.index(max(sims)))

    for (_, sentences, evidence), row in zip(data, got):
        more = evidence + [f.split() for f in facts]
        assert [(m["similarity"], m["position"]) for m in row["m"]] == [
            first_best(s, evidence) for s in sentences]
        assert [(m["similarity"], m["position"]) for m in row["f"]] == [
            first_best(s, more) for s in sentences]
        whole = set().union(*evidence) if evidence else set()
        assert [(g["containment"], g["cosine"]) for g in row["g"]] == [
            (len(set(s) & whole) / len(s) if s else 0.0, cosine(s, whole)) for s in sentences]


def test_vector_matches(spark):
    df = spark.createDataFrame(
        [([[1.0, 0.0], [1.0, 1.0]], [[0.0, 2.0], [3.0, 0.0], [1.0, 1.0], [2.0, 2.0]], [1.0, 0.0]),
         ([], [[1.0, 0.0]], [1.0, 0.0])],
        "s array<array<float>>, e array<array<float>>, w array<float>",
    ).coalesce(1)
    a, b = df.select(
        best_vector_matches(F.col("s"), F.col("e")).alias("m"),
        vector_cosines(F.col("s"), F.col("w")).alias("c"),
    ).collect()
    assert [m["position"] for m in a["m"]] == [1, 2] and b["m"] == [] and b["c"] == []
    assert a["c"] == [1.0, pytest.approx(1 / math.sqrt(2))]


def test_nli_label_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame(
        [(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "c double, e double, n double")
    got = df.select(nli_label(F.col("c"), F.col("e"), F.col("n"))).collect()
    assert [g[0] for g in got] == ["contradiction", "entailment", "neutral"]


def test_contradiction_counts_as_unsupported_but_is_flagged_once(spark):
    df = rows(spark, [("First sentence is here. Second sentence is here. Third sentence is here.",
                       "src", "", CALM)])
    df = df.withColumns({
        "nli": F.expr("array(named_struct('contradiction', 0.7D, 'entailment', 0.1D, 'neutral', 0.2D),"
                      "named_struct('contradiction', 0.1D, 'entailment', 0.2D, 'neutral', 0.7D),"
                      "named_struct('contradiction', 0.1D, 'entailment', 0.3D, 'neutral', 0.6D))"),
        "sim": F.expr("array(0.1D, 0.2D, 0.4D)")})
    r = evaluate(df, Slot(nli="nli", similarity="sim"), names=["hallucination"]).first()
    d = r["hallucination_details"]
    assert (d["num_sentences"], d["num_contradictions"], d["num_unsupported"]) == (3, 1, 2)
    assert list(r["hallucination_categories"]) == [
        "hallucination:contradiction", "hallucination:unsupported"]
    assert [f["severity"] for f in r["hallucination_flags"]] == [CRITICAL, WARNING]
    assert not r["hallucination_passed"] and r["hallucination_method"] == "model"
    expected = 0.6 * ((0.1 + 0.2 + 0.3) / 3) + 0.4 * ((0.1 + 0.2 + 0.4) / 3)
    assert r["hallucination_score"] == round(expected, 4)
    loose = Settings(hallucination=HallucinationSettings(entailment_floor=0.05))
    r = evaluate(df, Slot(nli="nli", similarity="sim"), loose, ["hallucination"]).first()
    assert list(r["hallucination_categories"]) == ["hallucination:contradiction"]


@pytest.mark.parametrize("source", ["", None])
def test_no_source(spark, source):
    r = score(spark, ["hallucination", "factual_accuracy"], "Some text here.", source)
    assert r["hallucination_score"] == 0.0 and r["factual_accuracy_score"] == 0.0
    assert list(r["hallucination_categories"]) == ["hallucination"]
    assert list(r["factual_accuracy_categories"]) == ["factual"]
    assert r["hallucination_passed"] and r["hallucination_sub_scores"] == {}


def test_no_content(spark):
    r = score(spark, ["hallucination", "factual_accuracy"], "", "Source document text here.")
    assert r["hallucination_score"] == 1.0 and r["factual_accuracy_score"] == 1.0
    assert r["hallucination_flags"] == [] and r["factual_accuracy_flags"] == []


@pytest.mark.parametrize(
    "claimed, source, ok",
    [("-5 degrees", "It was 5 there", True), ("$5 today", "Up 5% now", True),
     ("0 errors", "Had 0 faults", True), ("1 error", "Had 0 faults", False),
     ("105 units", "We sold 100", True), ("105.1 units", "We sold 100", False),
     ("2 million", "Sold 2,000 thousand", True), ("7 units", "no numbers", False)],
)
def test_numerical_claims(spark, claimed, source, ok):
    r = score(spark, ["factual_accuracy"], f"The figure is {claimed}.", source)
    claim = [c for c in r["factual_accuracy_details"]["claim_results"] if c["type"] == "numerical"][0]
    assert claim["verified"] is ok


def test_signed_numbers_and_first_match_and_knowledge(spark):
    signed = Settings(factual_accuracy=FactualSettings(signed=True))
    r = score(spark, ["factual_accuracy"], "The figure is -5 now.", "It was 5 there", settings=signed)
    assert r["factual_accuracy_sub_scores"]["numerical_accuracy"] == 0.0
    r = score(spark, ["factual_accuracy"], "The figure is 100 now.", "Seen 98, 100 and 102.")
    number = r["factual_accuracy_details"]["claim_results"][1]
    assert (number["source_value"], number["evidence"]) == (98.0, "98, ")  # the pattern takes the comma
    known = Settings(factual_accuracy=FactualSettings(knowledge_base=("Water boils at sea level",)))
    r = score(spark, ["factual_accuracy"], "Water boils at sea level.", "Unrelated text.", settings=known)
    assert r["factual_accuracy_score"] == 1.0
    assert r["factual_accuracy_details"]["claim_results"][0]["evidence"] == "Water boils at sea level"
    assert r["factual_accuracy_sub_scores"]["numerical_accuracy"] == 0.0


def plain_words(text):
    return sorted(set(re.findall(r"\w+", (text or "").lower())))


@pytest.mark.parametrize("floor", [0.65, 0.3, 1.0])
@pytest.mark.parametrize("most_frequent", [0, 3, 10_000])
def test_knowledge_join_equals_every_pair(spark, floor, most_frequent):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["common"] * 15 + ["often"] * 9
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    facts = [(i * 7, text(draw.randint(1, 9))) for i in range(300)] + [(5000, None), (5001, ""), (3, "W1 w2 w1")]
    given = [". ".join(text(draw.randint(3, 9)).capitalize() for _ in range(draw.randint(0, 4))) for _ in range(40)]
    given += [None, "", "Short.", facts[5][1] + " and no more"]
    df = spark.createDataFrame(
        [(i, g, facts[i % 300][1], "x") for i, g in enumerate(given)],
        "sample_id long, generated string, source string, words string",
    )
    got = match_with_knowledge(
        df, spark.createDataFrame(facts, "fact_id long, fact string"), floor=floor, most_frequent=most_frequent
    )
    assert got.columns == [*df.columns, "claim_matches"]
    own = match_with_knowledge(df, spark.createDataFrame([], "fact_id long, fact string"))
    sentences = df.select("sample_id", split_sentences(F.col("generated")).alias("s"))
    known = [(i, plain_words(f)) for i, f in facts if plain_words(f)]
    mine = {r.sample_id: r.claim_matches for r in own.collect()}
    found = {r.sample_id: r.claim_matches for r in got.collect()}
    for r in sentences.collect():
        for i, sentence in enumerate(r.s or []):
            x = plain_words(sentence)
            sims = [(len({*x} & {*y}) / math.sqrt(len(x) * len(y)), -j) for j, y in known] if x else []
            best = max(sims, default=(0, 0))
            want = mine[r.sample_id][i]
            if best[0] >= floor and best[0] > want["similarity"]:
                assert tuple(found[r.sample_id][i]) == (best[0], None, -best[1])
            else:
                assert found[r.sample_id][i] == want
    assert any(m["fact_id"] is not None for ms in found.values() for m in ms or []) or floor == 1.0


def test_facts_support_claims(spark):
    facts = spark.createDataFrame([(4, "Copper melts late"), (9, "late melts copper")], "fact_id long, fact string")
    df = rows(spark, [("Copper melts late.", "Something else entirely.", "", CALM), ("", "nothing", "", CALM)])
    matched = match_with_knowledge(df, facts)
    assert matched.orderBy("sample_id").first()["claim_matches"][0]["fact_id"] == 4
    r = evaluate(matched, Slot(claim_matches="claim_matches"), names=["factual_accuracy"])
    assert r.orderBy("sample_id").first()["factual_accuracy_sub_scores"]["textual_accuracy"] == 1.0
    with pytest.raises(ValueError):
        match_with_knowledge(df, facts, floor=0.0)


def test_indexed_words_are_few_and_rare(spark):
    sets = spark.createDataFrame([(["a", "b", "c", "d", "e"],), (["d"],)], "words array<string>")
    got = [r.prefix for r in indexed(sets, ["b", "a"], 0.8).collect()]
    # 5 - ceil(0.64 * 5) + 1 words; frequent ones come last
    assert got == [["c", "d"], ["d"]]


# --- registry and records


def test_registry(spark):
    assert available_evaluators()[:4] == list(BUILT_IN)
    with pytest.raises(KeyError):
        get_evaluator("nonexistent")
    off = Settings(hallucination=HallucinationSettings(enabled=False), custom={"mine": {"enabled": False}})

    @register("mine")
    def mine(df, slot, settings):
        return df.withColumn(slot.out("mine_score"), F.lit(0.95))

    try:
        assert enabled_evaluators(off) == ["factual_accuracy", "content_safety", "quality"]
        assert enabled_evaluators(Settings())[-1] == "mine"
        r = evaluate(rows(spark, [("t", "s", "p", CALM)]), names=["mine"]).first()
        assert r["mine_score"] == 0.95
    finally:
        unregister("mine")


def test_result_rows_and_records(spark):
    df = evaluate(rows(spark, [("Reach a@b.com now please.", "Reach", "p", CALM)]))
    long = result_rows(df, list(BUILT_IN), ["sample_id"]).orderBy("evaluator_order").collect()
    assert [r["evaluator"] for r in long] == list(BUILT_IN)
    assert '"pii_count":1' in long[2]["details"]
    assert df.select(passed_from_flags(F.col("content_safety_flags"))).first()[0] is False
    record = df.select(result_json(df, "content_safety")).first()[0]
    assert '"passed":false' in record and '"span":null' in record


def test_passed_looks_only_at_critical(spark):
    df = spark.range(1).select(
        passed_from_flags(F.array(flag("a", "m", WARNING))).alias("w"),
        passed_from_flags(F.array(flag("a", "m", WARNING), flag("b", "m", CRITICAL))).alias("c"))
    assert tuple(df.first()) == (True, False)


def test_scores_do_not_depend_on_partitions(spark):
    from assayline.catalog import fixtures

    samples = fixtures.samples(spark, "/root/testdata/sf0.001")
    names = [f"{n}_score" for n in BUILT_IN]

    def scored(n):
        out = evaluate(samples.repartition(n), parts=("score",)).select("sample_id", *names)
        return sorted(map(tuple, out.collect()))

    assert scored(1) == scored(16)


def test_scoring_is_one_narrow_stage(spark):
    df = rows(spark, [("t", "s", "p", CALM)]).repartition(2)
    out = evaluate(df, parts=("score",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition of the input itself
    assert "Join" not in plan


# --- plans


@pytest.mark.parametrize(
    ("array", "name"), [("factual_accuracy_details.claim_results", "c"), ("factual_accuracy_flags", "f")],
)
def test_extractions_run_once_below_a_generator(spark, array, name):
    df = rows(spark, [("Sold 5 of them. Then 7 more came in.", "Sold 5.", "", CALM), ("", "x", "", CALM)])
    scored = evaluate(df, names=["factual_accuracy"])
    each = elements(scored, ["sample_id"], array, name, "pos")
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    # the numbers of the sentences and those of the source
    assert plan.count("regexp_extract_all") == 2
    plain = scored.select("sample_id", F.posexplode(array).alias("pos", name))
    assert sorted(map(str, each.collect())) == sorted(map(str, plain.collect()))
    assert elements(scored, ["sample_id"], array, name).columns == ["sample_id", name]


def test_blocks_of_evidence_are_bounded_in_cells():
    from assayline.functions.lexical import _BLOCK_CELLS, _BLOCK_WORDS, _blocks

    for sizes in ([1] * 20_000, [40_000, 1, 1], [100] * 500, [0] * 9):
        ranges = list(_blocks(sizes))
        assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[-1][1] == len(sizes)
        for a, b in ranges:
            words = sum(sizes[a:b])
            assert b - a == 1 or (words <= _BLOCK_WORDS and words * (b - a) <= _BLOCK_CELLS)
