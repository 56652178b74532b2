"""The registered queries: one per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brand, text
from ..functions.expr import elements
from ..functions.numbers import extract_claims, extract_numbers
from ..functions.pii import detect_pii, pii_matches
from ..functions.rounding import round_exact
from ..operators import quality
from ..operators.hallucination import nli_label
from ..operators.registry import evaluate
from ..operators.results import result_json, result_rows
from ..operators.shared import source_sentences
from ..plans import ab, gate, report
from ..settings import (
    BUILT_IN,
    QualitySettings,
    SafetySettings,
    Settings,
    Slot,
)
from ..sources import ab_json, config
from ..sources import requests as gate_requests
from ..sources import runs as history
from . import fixtures as given

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CORPUS_SAFETY = SafetySettings(
    forbidden_terms=given.CORPUS_TERMS,
    forbidden_topics=given.CORPUS_TOPICS,
    competitor_names=given.CORPUS_COMPETITORS,
)
CORPUS = Settings(content_safety=CORPUS_SAFETY)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _long(c: Column) -> Column:
    return c.cast("long")


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


# --- text -----------------------------------------------------------------------------


@query
def split_sentences(spark, sf):
    docs = given.documents(spark, sf).select(
        "doc_id", text.split_sentences(F.col("text")).alias("s")
    )
    return docs.select(
        "doc_id",
        _long(F.size("s")).alias("n_sentences"),
        F.md5(_joined(F.col("s"))).alias("sentences_md5"),
    )


@query
def explode_sentences(spark, sf):
    docs = given.documents(spark, sf)
    return docs.select(
        "doc_id",
        F.posexplode_outer(text.split_sentences(F.col("text"))).alias("pos", "sentence"),
    ).select("doc_id", _long(F.col("pos")).alias("pos"), "sentence")


@query
def extract_numbers_query(spark, sf):
    docs = given.documents(spark, sf)
    return elements(docs, ["doc_id"], extract_numbers(F.col("text")), "n", "pos").select(
        "doc_id", _long(F.col("pos")).alias("pos"), "n.value", "n.unit", "n.match", "n.negative"
    )


QUERIES["extract_numbers"] = QUERIES.pop("extract_numbers_query")


@query
def extract_claims_query(spark, sf):
    docs = given.documents(spark, sf)
    claims = docs.select(
        "doc_id", F.posexplode_outer(extract_claims(F.col("text"))).alias("position", "c")
    )
    return claims.select(
        "doc_id", _long(F.col("position")).alias("position"), F.col("c.type").alias("claim_type"),
        F.md5("c.text").alias("text_md5"), F.col("c.value").alias("value"), F.col("c.unit").alias("unit"),
    )


QUERIES["extract_claims"] = QUERIES.pop("extract_claims_query")


@query
def detect_pii_query(spark, sf):
    docs = given.documents(spark, sf)
    return elements(docs, ["doc_id"], pii_matches(F.col("text")), "p").select(
        "doc_id", F.col("p.type").alias("pii_type"), F.col("p.match").alias("found")
    )


QUERIES["detect_pii"] = QUERIES.pop("detect_pii_query")


@query
def match_spans(spark, sf):
    docs = given.documents(spark, sf)
    return elements(docs, ["doc_id", "text"], detect_pii(F.col("text")), "p").select(
        "doc_id",
        F.col("p.type").alias("pii_type"),
        _long(F.col("p.start")).alias("span_start"),
        _long(F.col("p.end")).alias("span_end"),
        F.expr("substring(text, p.start + 1, p.end - p.start)").alias("cut"),
    )


def _rule_hits(spark, sf, kind, values, hits):
    docs = given.documents(spark, sf)
    return docs.select("doc_id", _long(hits(F.col("text"), kind, values)).alias("hits"))


@query
def forbidden_terms(spark, sf):
    return _rule_hits(spark, sf, brand.TERM, given.CORPUS_TERMS, brand.count_word_rules)


@query
def forbidden_topics(spark, sf):
    return _rule_hits(spark, sf, brand.TOPIC, given.CORPUS_TOPICS, brand.count_word_rules)


@query
def competitor_mentions(spark, sf):
    docs = given.documents(spark, sf)
    names = given.CORPUS_COMPETITORS
    return docs.select(
        "doc_id", _long(brand.count_competitors(F.col("text"), names)).alias("hits")
    )


@query
def brand_score(spark, sf):
    docs = given.documents(spark, sf)
    hits = docs.select(
        "doc_id",
        (
            brand.count_word_rules(F.col("text"), brand.TERM, given.CORPUS_TERMS)
            + brand.count_word_rules(F.col("text"), brand.TOPIC, given.CORPUS_TOPICS)
            + brand.count_competitors(F.col("text"), given.CORPUS_COMPETITORS)
        ).alias("violations"),
    )
    return hits.select(
        "doc_id",
        _long(F.col("violations")).alias("violations"),
        round_exact(brand.brand_score(F.col("violations")), 4).alias("brand_score"),
    )


@query
def pii_score(spark, sf):
    docs = given.documents(spark, sf)
    found = docs.select("doc_id", F.size(pii_matches(F.col("text"))).alias("n"))
    return found.select(
        "doc_id",
        _long(F.col("n")).alias("pii_count"),
        round_exact(brand.pii_score(F.col("n")), 4).alias("pii_score"),
    )


@query
def content_rating(spark, sf):
    """Ratings of the candidates of the pairs, with the default brand rules."""
    scored = evaluate(
        given.eval_pairs(spark, sf), Slot(text="candidate"), names=["content_safety"]
    )
    rating = F.col("content_safety_details.content_rating")
    return scored.groupBy("suite_id", rating.alias("rating")).agg(F.count("*").alias("n"))


@query
def fluency(spark, sf):
    docs = given.documents(spark, sf).select(
        "doc_id", quality.words_per_sentence(F.col("text")).alias("m")
    )
    return docs.select(
        "doc_id",
        round_exact("m", 4).alias("words_per_sentence"),
        _long(quality.fluency(F.col("m"))).alias("fluency"),
    )


@query
def coherence(spark, sf):
    docs = given.documents(spark, sf).select(
        "doc_id", quality.transition_count(F.col("text")).alias("t")
    )
    return docs.select(
        "doc_id",
        _long(F.col("t")).alias("transitions"),
        _long(quality.coherence(F.col("t"))).alias("coherence"),
    )


def _conversation_answers(spark, sf):
    """Assistant turns with the user turn before them as prompt."""
    turns = given.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("generated")
    )
    return answers.join(asked, ["conv_id", "turn"])


@query
def relevance(spark, sf):
    answers = _conversation_answers(spark, sf)
    return answers.select(
        "conv_id",
        "turn",
        round_exact(quality.prompt_overlap(F.col("generated"), F.col("prompt")), 4).alias(
            "overlap"
        ),
        _long(quality.relevance(F.col("generated"), F.col("prompt"))).alias("relevance"),
    )


@query
def quality_score(spark, sf):
    answers = _conversation_answers(spark, sf)
    scored = evaluate(answers, names=["quality"])
    return scored.select(
        "conv_id",
        "turn",
        "quality_score",
        _joined(F.col("quality_categories")).alias("categories"),
        *[F.col("quality_sub_scores")[d].alias(d) for d in quality.DIMENSIONS],
    )


@query
def flag_messages(spark, sf):
    scored = evaluate(given.samples(spark, sf), names=["factual_accuracy"])
    flags = elements(scored, ["sample_id"], "factual_accuracy_flags", "f", "pos")
    return flags.select(
        "sample_id", _long(F.col("pos")).alias("pos"), "f.message", "f.evidence", "f.severity"
    )


@query
def result_record(spark, sf):
    scored = evaluate(given.samples(spark, sf), names=["content_safety"], settings=CORPUS)
    record = scored.select("sample_id", result_json(scored, "content_safety").alias("record"))

    def at(path):
        return F.get_json_object("record", path)

    return record.select(
        "sample_id",
        at("$.evaluator").alias("evaluator"),
        at("$.score").cast("double").alias("score"),
        at("$.passed").cast("boolean").alias("passed"),
        at("$.sub_scores.brand_alignment").cast("double").alias("brand_alignment"),
        _long(at("$.details.pii_count")).alias("pii_count"),
        at("$.flags[0].category").alias("first_flag"),
    )


# --- safety -----------------------------------------------------------------------------


def _toxicity_map(spark, sf):
    """Two toxicity categories per document, the second by whole-number rule."""
    return given.samples(spark, sf).select(
        "sample_id",
        F.map_concat(
            "toxicity",
            F.create_map(F.lit("insult"), (F.col("sample_id") % 16) / F.lit(16.0)),
        ).alias("toxicity"),
    )


@query
def toxicity_flags(spark, sf):
    from ..operators.safety import high_toxicity

    rows = _toxicity_map(spark, sf).select(
        "sample_id", F.posexplode(high_toxicity(F.col("toxicity"), 0.5)).alias("pos", "t")
    )
    return rows.select(
        "sample_id",
        _long(F.col("pos")).alias("pos"),
        F.concat(F.lit("toxicity:"), F.col("t.key")).alias("category"),
        F.col("t.value").alias("score"),
    )


@query
def safety_score(spark, sf):
    scored = evaluate(given.samples(spark, sf), names=["content_safety"], settings=CORPUS)
    return scored.select(
        "sample_id",
        "content_safety_score",
        *[
            F.col("content_safety_sub_scores")[k].alias(k)
            for k in ("toxicity", "brand_alignment", "pii_safety")
        ],
    )


@query
def passed(spark, sf):
    scored = evaluate(given.samples(spark, sf), names=["content_safety"], settings=CORPUS)
    return scored.groupBy("suite_id").agg(
        F.count_if("content_safety_passed").alias("n_passed"),
        F.count_if(~F.col("content_safety_passed")).alias("n_failed"),
        F.bool_and("content_safety_passed").alias("all_passed"),
    )


@query
def policy_only(spark, sf):
    """Policy rules without any model score: brand rules and personal data only."""
    docs = given.documents(spark, sf)
    terms = brand.count_word_rules(F.col("text"), brand.TERM, given.CORPUS_TERMS)
    pii = F.size(pii_matches(F.col("text")))
    found = docs.select(F.col("source").alias("suite_id"), _long(terms).alias("t"), _long(pii).alias("p"))
    return found.groupBy("suite_id").agg(
        F.sum("t").alias("term_hits"), F.sum("p").alias("pii_hits"), F.count_if(F.expr("t = 0 and p = 0")).alias("clean")
    )


@query
def redact_pii(spark, sf):
    from ..functions.pii import redact_pii as redact

    docs = given.documents(spark, sf)
    return docs.select("doc_id", F.md5(redact(F.col("text"))).alias("redacted_md5"))


# --- hallucination ------------------------------------------------------------------------


def _with_model_scores(spark, sf):
    return (
        given.samples(spark, sf)
        .withColumn("sentences", text.split_sentences(F.col("generated")))
        .withColumns(
            {
                "nli": given.nli(F.col("sentences")),
                "similarity": given.sentence_similarity(F.col("sentences")),
            }
        )
    )


MODEL_SLOT = Slot(nli="nli", similarity="similarity")


@query
def nli_label_query(spark, sf):
    scores = _with_model_scores(spark, sf).select(
        "sample_id", F.posexplode("nli").alias("pos", "p")
    )
    label = nli_label(F.col("p.contradiction"), F.col("p.entailment"), F.col("p.neutral"))
    return scores.select("sample_id", _long(F.col("pos")).alias("pos"), label.alias("label"))


QUERIES["nli_label"] = QUERIES.pop("nli_label_query")


@query
def hallucination_score(spark, sf):
    scored = evaluate(_with_model_scores(spark, sf), MODEL_SLOT, names=["hallucination"])
    return scored.select(
        "sample_id",
        "hallucination_score",
        F.col("hallucination_sub_scores")["entailment"].alias("entailment"),
        F.col("hallucination_sub_scores")["semantic_similarity"].alias("semantic_similarity"),
    )


@query
def hallucination_flags(spark, sf):
    scored = evaluate(_with_model_scores(spark, sf), MODEL_SLOT, names=["hallucination"])
    flags = elements(scored, ["sample_id"], "hallucination_flags", "f", "pos")
    return flags.select(
        "sample_id", _long(F.col("pos")).alias("pos"), "f.category", "f.severity", "f.message"
    )


@query
def hallucination_counts(spark, sf):
    scored = evaluate(_with_model_scores(spark, sf), MODEL_SLOT, names=["hallucination"])
    return scored.select(
        "sample_id",
        *[
            _long(F.col("hallucination_details")[c]).alias(c)
            for c in ("num_sentences", "num_contradictions", "num_unsupported")
        ],
    )


@query
def sentence_source_cosine(spark, sf):
    """Each sentence against its whole source, by the lexical stand-in."""
    scored = evaluate(given.samples(spark, sf), names=["hallucination"])
    rows = elements(scored, ["sample_id"], "hallucination_details.sentence_results", "r", "pos")
    return rows.select(
        "sample_id",
        _long(F.col("pos")).alias("pos"),
        F.col("r.similarity").alias("similarity"),
        F.col("r.entailment_prob").alias("entailment"),
    )


@query
def no_content_guard(spark, sf):
    """Samples without a kept sentence score 1 and raise no flag."""
    scored = evaluate(
        given.samples(spark, sf), names=["hallucination", "factual_accuracy"]
    )
    empty = F.size(text.split_sentences(F.col("generated"))) == 0
    return scored.select(
        "sample_id",
        empty.alias("no_content"),
        (empty & (F.col("hallucination_score") == 1.0) & (F.size("hallucination_flags") == 0))
        .alias("hallucination_clear"),
        (empty & (F.col("factual_accuracy_score") == 1.0)
         & (F.size("factual_accuracy_flags") == 0)).alias("factual_clear"),
    )


@query
def no_source_guard(spark, sf):
    """The samples without an own source (every third one) score 0 with one warning."""
    source = F.when(F.col("sample_id") % 3 != 0, F.col("source")).otherwise("")
    samples = given.samples(spark, sf).withColumn("source", source)
    scored = evaluate(samples, names=["hallucination", "factual_accuracy"])
    guarded = scored.filter(F.col("source") == "")
    flags = F.concat("hallucination_flags", "factual_accuracy_flags")
    return guarded.select(
        "sample_id",
        "hallucination_score",
        "factual_accuracy_score",
        _joined(F.transform(flags, lambda f: f["message"])).alias("messages"),
        _joined(F.transform(flags, lambda f: f["severity"])).alias("severities"),
    )


# --- factual ------------------------------------------------------------------------------


def _claim_results(spark, sf, settings=Settings()):
    scored = evaluate(given.samples(spark, sf), names=["factual_accuracy"], settings=settings)
    return elements(scored, ["sample_id"], "factual_accuracy_details.claim_results", "c", "pos")


@query
def verify_textual(spark, sf):
    claims = _claim_results(spark, sf).filter("c.type = 'textual'")
    return claims.select(
        "sample_id", _long(F.col("pos")).alias("pos"), "c.similarity", "c.verified", "c.evidence"
    )


@query
def verify_numerical(spark, sf):
    scored = evaluate(given.numeric_claims(spark, sf).withColumn("prompt", F.lit("")),
                      names=["factual_accuracy"])
    claims = elements(scored, ["sample_id"], "factual_accuracy_details.claim_results", "c").filter("c.type = 'numerical'")
    return claims.select(
        "sample_id",
        F.col("c.value").alias("value"),
        F.col("c.source_value").alias("source_value"),
        F.col("c.verified").alias("verified"),
        F.col("c.evidence").alias("evidence"),
    )


@query
def source_fallback(spark, sf):
    docs = given.samples(spark, sf)
    evidence = source_sentences(F.col("source"))
    return docs.select(
        "sample_id",
        _long(F.size(evidence)).alias("n_evidence"),
        F.md5(_joined(evidence)).alias("evidence_md5"),
    )


@query
def knowledge_base_union(spark, sf):
    """Claims against their source and the facts of the benchmark table together."""
    from ..operators.knowledge import match_with_knowledge

    facts = given.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("fact_id"), F.col("text").alias("fact")
    )
    matched = match_with_knowledge(given.samples(spark, sf), facts)
    slot = Slot(claim_matches="claim_matches")
    scored = evaluate(matched, slot, names=["factual_accuracy"])
    return scored.select(
        "sample_id",
        "factual_accuracy_score",
        _long(F.col("factual_accuracy_details.verified_claims")).alias("verified"),
        _long(F.col("factual_accuracy_details.total_claims")).alias("total"),
    )


@query
def corpus_as_knowledge(spark, sf):
    """Every sentence of every turn against the sentences of all documents as facts."""
    from ..operators.knowledge import match_with_knowledge

    facts = elements(
        given.documents(spark, sf), ["doc_id"], text.split_sentences(F.col("text")), "fact", "pos"
    ).select((F.col("doc_id") * 100_000 + F.col("pos")).alias("fact_id"), "fact")
    turns = given.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("sample_id"), F.col("text").alias("generated"),
        F.lit("").alias("source"), "conv_id", "turn",
    )
    matched = match_with_knowledge(turns, facts)
    found = F.filter("claim_matches", lambda m: m["fact_id"].isNotNull())
    return matched.select(
        "conv_id", "turn", _long(F.size("claim_matches")).alias("sentences"), _long(F.size(found)).alias("known"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, m: a + m["fact_id"]).alias("fact_ids"),
        F.array_max(F.transform(found, lambda m: m["similarity"])).alias("best"),
    )


@query
def factual_score(spark, sf):
    scored = evaluate(given.samples(spark, sf), names=["factual_accuracy"])
    return scored.select(
        "sample_id",
        "factual_accuracy_score",
        F.col("factual_accuracy_sub_scores")["textual_accuracy"].alias("textual_accuracy"),
        F.col("factual_accuracy_sub_scores")["numerical_accuracy"].alias("numerical_accuracy"),
        _long(F.size("factual_accuracy_flags")).alias("n_flags"),
    )


# --- gate ---------------------------------------------------------------------------------


def _decided(spark, sf, settings=CORPUS):
    return gate.decide(given.requests(spark, sf), settings)


@query
def enabled_evaluators(spark, sf):
    """Result rows of the enabled evaluators only, filtered through the settings table."""
    settings = config.settings_from_config(
        {"evaluators": {"hallucination": {"enabled": False}, "quality": {"use_heuristic": True}}}
    )
    from ..operators.registry import enabled_evaluators as enabled

    names = enabled(settings)
    rows = result_rows(
        evaluate(given.samples(spark, sf), settings=settings, parts=("score", "passed")),
        names, ["sample_id", "suite_id"], parts=("score", "passed"),
    )
    in_force = config.settings_table(spark, settings).filter("enabled")
    return rows.join(in_force, "evaluator", "left_semi").groupBy("suite_id", "evaluator").agg(
        F.count("*").alias("n"),
        F.sum(_long(F.round(F.col("score") * 10000))).alias("score_units"),
    )


@query
def error_row(spark, sf):
    """A missing text or missing toxicity scores give score 0, no flag, and an error."""
    n = F.col("sample_id")
    broken = given.samples(spark, sf).withColumns(
        {
            "generated": F.when(n % 10 != 3, F.col("generated")),
            "toxicity": F.when(n % 10 != 7, F.col("toxicity")),
        }
    )
    scored = evaluate(broken, names=["content_safety", "quality"], settings=CORPUS)
    return scored.select(
        "sample_id",
        "content_safety_error",
        "quality_error",
        "content_safety_passed",
        (F.col("content_safety_score") == 0.0).alias("safety_zero"),
        F.when(F.col("content_safety_error").isNotNull(), F.size("content_safety_flags"))
        .cast("long").alias("safety_flags"),
        F.when(F.col("quality_error").isNotNull(), F.col("quality_score")).alias("quality_on_error"),
    )


@query
def failing_evaluators(spark, sf):
    """An evaluator that raises, an embedder that raises and one with ragged vectors: rows, not jobs, fail."""
    from ..operators.models import with_embedding_scores
    from ..operators.registry import from_function, registered

    samples = with_embedding_scores(given.samples(spark, sf), given.fragile_model)
    samples = samples.withColumn("nli", given.nli(text.split_sentences(F.col("generated"))))
    slot = Slot(nli="nli", similarity="similarity", claim_matches="claim_matches", model_error="embedding_error")
    with registered("strict", from_function("strict", given.strict_scorer)):
        scored = evaluate(samples, slot, names=["hallucination", "factual_accuracy", "strict"])
    return scored.select(
        "sample_id", "hallucination_error", "factual_accuracy_error",
        F.when(F.col("hallucination_error").isNotNull(), F.col("hallucination_score")).alias("score_on_error"),
        F.when(F.col("hallucination_error").isNotNull(), F.size("hallucination_flags")).cast("long").alias("flags_on_error"),
        "strict_error", "strict_score", "strict_passed", _long(F.size("strict_flags")).alias("strict_flags"),
    )


@query
def judge_or_heuristic(spark, sf):
    scored = evaluate(
        given.judge(given.samples(spark, sf)), Slot(judge="judge"), names=["quality"]
    )
    return scored.select(
        "sample_id",
        "quality_score",
        F.col("quality_method").alias("method"),
        _long(F.col("quality_details.fluency")).alias("fluency"),
    )


@query
def evaluator_method(spark, sf):
    settings = Settings(quality=QualitySettings(model="judge-1"))
    scored = evaluate(
        given.judge(given.samples(spark, sf)), Slot(judge="judge"), settings, ["quality"],
        ("method",),
    )
    method = gate.evaluator_method(scored, Slot(), settings, ["quality"])
    return scored.groupBy(method.alias("evaluator_method")).agg(F.count("*").alias("n"))


@query
def aggregate_score(spark, sf):
    return _decided(spark, sf).select(
        "sample_id",
        *[
            F.col("subscores")[n].alias(n) for n in BUILT_IN
        ],
        round_exact("aggregate_score", 6).alias("aggregate_score"),
    )


@query
def collect_flags(spark, sf):
    scored = evaluate(
        given.eval_pairs(spark, sf), Slot(text="candidate"), CORPUS, parts=("categories",)
    )
    flags = gate.collect_flags(Slot(), BUILT_IN)
    return scored.select(
        "sample_id",
        _long(F.size(flags)).alias("n_flags"),
        F.md5(_joined(flags)).alias("flags_md5"),
    )


@query
def inject_hallucination_flag(spark, sf):
    return _decided(spark, sf).select(
        "sample_id",
        F.array_contains("flags", F.lit("hallucination")).alias("injected"),
        F.get("flags", F.size("flags") - 1).alias("last_flag"),
    )


@query
def candidate_vs_baseline(spark, sf):
    return _decided(spark, sf).select(
        "sample_id",
        round_exact("aggregate_score", 6).alias("candidate_score"),
        round_exact("baseline_aggregate_score", 6).alias("baseline_score"),
    )


@query
def blocker_match(spark, sf):
    return _decided(spark, sf).select("sample_id", "blocker")


@query
def promotion_decision(spark, sf):
    return _decided(spark, sf).select("sample_id", "decision", "reason_code", "reason")


@query
def decisions_by_suite(spark, sf):
    """The flagship: every pair scored by all evaluators, decided, counted per suite."""
    return _decided(spark, sf).groupBy("suite_id", "decision", "reason_code").agg(
        F.count("*").alias("n")
    )


@query
def redact_payload(spark, sf):
    kept = gate.redacted(given.requests(spark, sf))
    return kept.select(
        "sample_id",
        F.md5("input.prompt").alias("prompt_md5"),
        _long(F.length("candidate_output")).alias("candidate_chars"),
        _long(F.length("baseline_output")).alias("baseline_chars"),
        "input_redacted",
        "output_redacted",
    )


@query
def gate_request_source(spark, sf):
    """Requests written as JSON, some of them faulty, and read back."""
    n = F.col("sample_id")
    full = F.struct(
        F.when(n % 5 != 0, F.col("suite_id")).alias("suite_id"),
        F.struct("prompt", F.when(n % 3 != 0, F.col("source")).alias("source")).alias("input"),
        F.struct(
            F.when(n % 2 == 0, F.lit("model-x")).alias("id"),
            F.when(n % 11 != 0, F.col("candidate")).alias("output"),
        ).alias("candidate"),
        F.when(
            n % 4 != 1,
            F.struct(F.when(n % 9 != 0, F.col("baseline")).alias("output")),
        ).alias("baseline"),
        F.when(
            n % 3 == 1,
            F.struct(
                F.lit(0.5).alias("min_score"),
                F.array(F.lit("hallucination")).alias("block_on_flags"),
            ),
        ).alias("thresholds"),
        F.when(n % 7 == 0, F.lit(True)).alias("store_full_payloads"),
    )
    line = F.when(n % 13 == 0, F.lit('{"input": ')).otherwise(F.to_json(full))
    pairs = given.eval_pairs(spark, sf)
    parsed = gate_requests.parse_requests(pairs.select("sample_id", line.alias("value")))
    return parsed.select(
        "sample_id",
        _joined(F.col("errors")).alias("errors"),
        "suite_id",
        _long(F.length("source")).alias("source_chars"),
        "candidate_id",
        F.md5("candidate").alias("candidate_md5"),
        "baseline_id",
        "min_score",
        _joined(F.col("block_on_flags")).alias("block_on_flags"),
        "store_full_payloads",
    )


@query
def rules_from_config(spark, sf):
    """The rules of a configuration, with their hits over all documents."""
    settings = config.settings_from_config(
        {
            "evaluators": {
                "content_safety": {
                    "forbidden_terms": list(given.CORPUS_TERMS),
                    "forbidden_topics": [],
                    "competitor_names": list(given.CORPUS_COMPETITORS),
                }
            }
        }
    )
    safety = settings.content_safety
    lists = (
        (brand.TERM, brand.terms_or_default(safety.forbidden_terms)),
        (brand.TOPIC, brand.topics_or_default(safety.forbidden_topics)),
        (brand.COMPETITOR, safety.competitor_names),
    )

    def hits_of(kind, values):
        return F.transform(
            brand.violations_by_rule(F.col("text"), kind, values),
            lambda v: F.struct(
                F.lit(kind).alias("kind"), v["value"].alias("value"), v["hits"].alias("hits")
            ),
        )

    hits = F.concat(*[hits_of(kind, values) for kind, values in lists])
    counted = given.documents(spark, sf).select(F.inline(hits)).groupBy("kind", "value").agg(
        F.sum("hits").alias("hits"), F.count("*").alias("documents")
    )
    rules = config.rules_table(spark, settings)
    return rules.join(counted, ["kind", "value"], "left").select(
        _long(F.col("rule_id")).alias("rule_id"),
        "kind",
        "value",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )


# --- A/B ----------------------------------------------------------------------------------


A, B = Slot(text="candidate", prefix="a_"), Slot(text="baseline", prefix="b_")


def _pairs(spark, sf):
    return given.eval_pairs(spark, sf).filter(F.col("baseline").isNotNull())


def _paired_scores(spark, sf, names=BUILT_IN):
    scored = evaluate(_pairs(spark, sf), (A, B), CORPUS, names, ("score",))
    return ab.paired_scores(scored, names, ["sample_id", "suite_id", "lang"], A, B)


BY_SUITE = ["suite_id", "evaluator_order", "evaluator"]
BY_SUITE_LANG = ["suite_id", "lang", "evaluator_order", "evaluator"]


@query
def pair_ab(spark, sf):
    docs = given.documents(spark, sf).select(
        F.expr("doc_id div 100").alias("suite_id"),
        F.expr("(doc_id % 100) div 2").alias("sample_index"),
        F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("slot"),
        F.col("text").alias("generated"),
    )
    return ab.pair_outputs(docs).select(
        "suite_id",
        "sample_index",
        "paired",
        F.md5("generated_a").alias("a_md5"),
        F.md5("generated_b").alias("b_md5"),
    )


def _ab_documents(spark, sf):
    """One A/B document per text: its sentences are the outputs, in all accepted forms."""
    sentences = text.split_sentences(F.col("text"))
    docs = given.documents(spark, sf).select(
        "doc_id", "source", "lang", sentences.alias("s")
    )

    def quoted(s):
        return F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)

    def output(s, i):
        return (
            F.when(i % 3 == 0, quoted(s))
            .when(i % 3 == 1, F.to_json(F.struct(s.alias("text"), i.alias("rank"))))
            .otherwise(F.to_json(F.struct(s.alias("generated"))))
        )

    def listed(items):
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))

    n = F.size("s")
    prompts = F.transform(
        F.slice("s", 1, F.greatest(n - 1, F.lit(0))), lambda s, i: quoted(F.concat(F.lit("p"), i.cast("string")))
    )
    sources = F.transform(F.slice("s", 1, (n / 2).cast("int")), lambda s: quoted(s))
    outputs = listed(F.transform("s", output))
    return docs.select(
        "doc_id",
        F.concat(
            F.lit('{"prompts":'), listed(prompts), F.lit(',"sources":'), listed(sources),
            F.lit(',"model_a":{"outputs":'), outputs, F.lit('},"model_b":{"id":'),
            quoted(F.col("lang")), F.lit(',"outputs":'), outputs, F.lit("}}"),
        ).alias("value"),
    )


@query
def ab_json_source(spark, sf):
    rows = ab_json.parse_ab(_ab_documents(spark, sf))
    return rows.groupBy("doc_id", "slot", "model_id").agg(
        F.count("*").alias("outputs"),
        F.sum(_long(F.length("generated"))).alias("text_chars"),
        F.sum(_long(F.length("source"))).alias("source_chars"),
        F.count_if(F.col("prompt") == F.concat(F.lit("p"), F.col("sample_index").cast("string")))
        .alias("prompts"),
        F.sum(_long(F.size("metadata"))).alias("metadata_keys"),
    )


@query
def ab_quarantine(spark, sf):
    """A/B documents, half of them damaged: what is wrong with each, and what the others hold."""
    n = F.col("doc_id") % 14
    value = F.col("value")
    outputs = r'(?s)("model_b":\{"id":.*?"outputs":)\[.*\]'
    damaged = (
        F.when(n == 1, F.substring(value, 1, F.length(value) - 1))
        .when(n == 2, F.concat(F.lit("["), value, F.lit("]")))
        .when(n == 3, F.replace(value, F.lit('"model_a"'), F.lit('"model_x"')))
        .when(n == 4, F.regexp_replace(value, outputs, '$1"none"'))
        .when(n == 5, F.regexp_replace(value, outputs, '$1["one"]'))
        .when(n == 6, F.regexp_replace(value, outputs, '$1[7,null,"x"]'))
        .when(n == 7, F.replace(value, F.lit('{"prompts":['), F.lit('{"prompts":{},"was":[')))
        .when(n != 8, value)
    )
    docs = _ab_documents(spark, sf).select("doc_id", damaged.alias("value"))
    bad = ab_json.quarantined_ab(docs).select("doc_id", "reason", F.lit(None).cast("long").alias("outputs"))
    good = ab_json.parse_ab(docs, comparable=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("outputs"))
    return bad.unionByName(good.select("doc_id", F.lit(None).cast("string").alias("reason"), "outputs"))


@query
def attach_prompt_source(spark, sf):
    """The long form: outputs meet their prompt and source on (document, position)."""
    docs = given.documents(spark, sf).select(
        F.col("doc_id").alias("suite_id"), text.split_sentences(F.col("text")).alias("s")
    )
    rows = elements(docs, ["suite_id"], "s", "t", "sample_index")
    outputs = rows.select(
        "suite_id",
        F.lit("a").alias("slot"),
        "sample_index",
        F.lit(None).cast("string").alias("model_id"),
        F.parse_json(F.to_json(F.struct(F.col("t").alias("text")))).alias("output"),
    )
    inputs = rows.filter("sample_index % 2 = 0").select(
        "suite_id",
        "sample_index",
        F.concat(F.lit("p"), F.col("sample_index").cast("string")).alias("prompt"),
        F.lit(None).cast("string").alias("source"),
    )
    return ab_json.read_ab_lines(outputs, inputs).select(
        "suite_id", _long(F.col("sample_index")).alias("sample_index"), "model_id",
        F.md5("generated").alias("generated_md5"), "prompt", "source",
    )


@query
def ab_summary(spark, sf):
    return ab.compare(_paired_scores(spark, sf), BY_SUITE).select(
        "suite_id", "evaluator", "num_samples", "mean_a", "std_a", "mean_b", "std_b"
    )


@query
def paired_effect(spark, sf):
    return ab.compare(_paired_scores(spark, sf), BY_SUITE_LANG).select(
        "suite_id", "lang", "evaluator", "mean_diff", "effect_size"
    )


@query
def paired_ttest(spark, sf):
    result = ab.compare(_paired_scores(spark, sf), BY_SUITE)
    return result.filter("test = 0").select(
        "suite_id", "evaluator",
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("t_statistic", "p_value")],
    )


@query
def wilcoxon_signed_rank(spark, sf):
    result = ab.compare(_paired_scores(spark, sf), BY_SUITE_LANG)
    return result.filter("test = 1").select(
        "suite_id", "lang", "evaluator", "method", "w_statistic", "p_value"
    )


@query
def raw_score_ranks(spark, sf):
    """Paired statistics of scores that are not rounded: a function of the lengths of both texts."""
    pairs = given.eval_pairs(spark, sf).where("baseline is not null")
    raw = lambda c: F.lit(1.0) / (F.length(c) % 97 + F.lit(3))
    scores = pairs.select("suite_id", "lang", raw("candidate").alias("score_a"), raw("baseline").alias("score_b"))
    stats = ab.raw_statistics(scores, ["suite_id", "lang"])
    return stats.select(
        "suite_id", "lang", "n", "n_nonzero", "rank_plus", "rank_minus", "tie_term",
        *[F.round(c, 9).alias(c) for c in ("mean_a", "std_a", "std_b", "mean_diff", "std_diff")],
    )


@query
def ab_winner(spark, sf):
    return ab.compare(_paired_scores(spark, sf), BY_SUITE).select(
        "suite_id", "evaluator", "winner"
    )


@query
def overall_winner(spark, sf):
    result = ab.compare(_paired_scores(spark, sf), BY_SUITE)
    return ab.overall_winner(result, ["suite_id"], F.lit("model-x"), F.lit("model-y"))


@query
def ci_verdict(spark, sf):
    result = ab.compare(_paired_scores(spark, sf), BY_SUITE)
    return report.ci_verdict(result, ["suite_id"])


@query
def json_report(spark, sf):
    """The JSON document of each suite, read back field by field."""
    result = ab.compare(_paired_scores(spark, sf), BY_SUITE)
    a, b = F.lit("model-x"), F.lit("model-y")
    overall = ab.overall_winner(result, ["suite_id"], a, b).select("suite_id", "overall_winner")
    documents = report.json_reports(
        result, overall, "suite_id", a, b, F.lit("2024-01-01T00:00:00Z")
    )

    def at(path):
        return F.get_json_object("report", path)

    return documents.select(
        "suite_id",
        at("$.schema_version").alias("schema_version"),
        at("$.num_samples").cast("long").alias("num_samples"),
        at("$.overall_winner").alias("overall_winner"),
        at("$.summary.quality.mean_a").cast("double").alias("quality_mean_a"),
        at("$.summary.content_safety.winner").alias("safety_winner"),
        at("$.ci.passed").cast("boolean").alias("ci_passed"),
        at("$.ci.evaluator_status.hallucination.model_b_pass").cast("boolean").alias("b_grounded"),
    )


# --- run history --------------------------------------------------------------------------


@query
def save_run(spark, sf):
    """Every save of every run, reduced to the last save of each."""
    return history.latest_runs(given.runs(spark, sf)).select(
        "run_id", "ingest_seq", "created_at", "suite_id", "aggregate_score", "decision"
    )


@query
def compacted_history(spark, sf):
    """Runs saved in five appends, compacted after three and again after five, read latest-wins."""
    from ..session import shared_folder

    path = shared_folder(spark, "history")
    saves = given.runs(spark, sf)
    for batch in range(5):
        own = history.latest_by(saves.where(F.col("ingest_seq") % 5 == batch), "run_id", "ingest_seq")
        history.save_runs(own.drop("ingest_seq", "saved_at"), path, batch)
        if batch in (2, 4):
            history.compact_runs(spark, path, target_bytes=64 << 10)
    return history.latest_runs(history.read_runs(spark, path)).select(
        "run_id", "ingest_seq", "suite_id", "decision", "aggregate_score"
    )


@query
def recent_runs(spark, sf):
    return history.recent_runs(given.runs(spark, sf)).select(
        "run_id", "created_at", "suite_id", "decision"
    )


@query
def get_run(spark, sf):
    return history.get_run(given.runs(spark, sf), "run-00007").select(
        "run_id", "ingest_seq", "created_at", "suite_id", "aggregate_score"
    )


# --- extension surface --------------------------------------------------------------------


@query
def custom_evaluator(spark, sf):
    """A user's evaluator, registered by name and scored beside the built-in ones."""
    from ..operators.registry import registered
    from ..operators.results import add_result

    def brevity(df, slot, settings):
        length = F.length(slot.text).cast("double")
        limit = float(settings.get("limit", 2000))
        too_long = length > F.lit(limit)
        return add_result(
            df, slot, "brevity",
            score=F.least(F.lit(1.0), F.lit(limit) / F.greatest(length, F.lit(1.0))),
            error=F.when(F.col(slot.text).isNull(), F.lit("generated text is missing")),
            sub_scores=lambda: {"length": length},
            passed=lambda: F.lit(True),
            categories=lambda: F.when(too_long, F.array(F.lit("brevity:long"))).otherwise(
                F.array().cast("array<string>")
            ),
            flags=lambda: F.array().cast(
                "array<struct<category:string,message:string,severity:string,"
                "span:struct<start:int,end:int>,evidence:string>>"
            ),
            details=lambda: F.struct(length.alias("length")),
            method=lambda: F.lit("rules"),
        )

    settings = Settings(content_safety=CORPUS_SAFETY, custom={"brevity": {"limit": 1500}})
    names = ["content_safety", "brevity"]
    parts = ("score", "categories")
    with registered("brevity", brevity):
        scored = evaluate(given.samples(spark, sf), Slot(), settings, names, parts)
    rows = result_rows(scored, names, ["sample_id"], parts=parts)
    return rows.select("sample_id", "evaluator", "score", _long(F.size("categories")).alias("n_flags"))


def _embedded(spark, sf):
    from ..operators.models import with_embedding_scores

    samples = with_embedding_scores(given.samples(spark, sf), given.letter_model)
    return samples.withColumn("nli", given.nli(text.split_sentences(F.col("generated"))))


@query
def model_scorer(spark, sf):
    """Embedding scores from a model that is loaded in the tasks."""
    scores = _embedded(spark, sf).select(
        "sample_id",
        F.posexplode(F.arrays_zip("similarity", "claim_matches")).alias("pos", "m"),
    )
    return scores.select(
        "sample_id",
        _long(F.col("pos")).alias("pos"),
        round_exact(F.col("m.similarity"), 6).alias("similarity"),
        round_exact(F.col("m.claim_matches.similarity"), 6).alias("best_similarity"),
        _long(F.col("m.claim_matches.position")).alias("best_position"),
    )


@query
def model_scored_evaluators(spark, sf):
    """Hallucination and factual scores on model columns instead of the stand-ins."""
    slot = Slot(nli="nli", similarity="similarity", claim_matches="claim_matches")
    names = ["hallucination", "factual_accuracy"]
    scored = evaluate(_embedded(spark, sf), slot, names=names, parts=("score", "method"))
    return scored.select(
        "sample_id", "hallucination_score", "hallucination_method", "factual_accuracy_score",
        "factual_accuracy_method",
    )


@query
def nli_scored(spark, sf):
    """Hallucination scores on entailment probabilities from a pair model that is loaded in the tasks."""
    from ..operators.models import with_nli_scores

    samples = with_nli_scores(given.samples(spark, sf), given.pair_model, most_pairs=64)
    slot = Slot(nli="nli", model_error="nli_error")
    scored = evaluate(samples, slot, names=["hallucination"], parts=("score", "details", "method", "error"))
    failed = F.col("hallucination_error").isNotNull()
    return scored.select(
        "sample_id", "hallucination_score", "hallucination_method", "hallucination_error",
        F.when(~failed, _long(F.col("hallucination_details.num_sentences"))).alias("sentences"),
        F.when(~failed, _long(F.col("hallucination_details.num_contradictions"))).alias("contradictions"),
    )


@query
def toxicity_scored(spark, sf):
    """Safety scores on toxicity from a model that is loaded in the tasks."""
    from ..operators.models import toxicity_scorer

    samples = given.samples(spark, sf).drop("toxicity")
    tox = toxicity_scorer(given.toxicity_model)(F.col("generated"))
    samples = samples.withColumn("scored", tox).withColumn("toxicity", F.col("scored.scores"))
    scored = evaluate(samples, settings=CORPUS, names=["content_safety"], parts=("passed", "error"))
    return scored.select(
        "sample_id", F.col("scored.error").alias("model_error"),
        brand.max_toxicity(F.col("toxicity")).alias("max_toxicity"), "content_safety_error", "content_safety_passed",
    )


# --- configured or documented, not part of a decision ---------------------------------------


@query
def weighted_score(spark, sf):
    from ..plans.monitoring import weighted_score as weighted

    scored = evaluate(given.samples(spark, sf), settings=CORPUS, parts=("score",))
    scores = {n: F.col(f"{n}_score") for n in BUILT_IN}
    return scored.select("sample_id", round_exact(weighted(scores), 6).alias("weighted_score"))


@query
def rating_by_table(spark, sf):
    from ..plans.monitoring import rating_by_tiers

    generated = F.col("generated")
    found = given.samples(spark, sf).select(
        "suite_id",
        brand.max_toxicity(F.col("toxicity")).alias("tox"),
        (
            F.size(pii_matches(generated))
            + brand.count_word_rules(generated, brand.TERM, given.CORPUS_TERMS)
            + brand.count_word_rules(generated, brand.TOPIC, given.CORPUS_TOPICS)
            + brand.count_competitors(generated, given.CORPUS_COMPETITORS)
        ).alias("issues"),
    )
    tiers = (("G", 0.1, 0), ("PG", 0.25, 0), ("PG-13", 0.6, 2), ("R", 1.0, 999))
    rating = rating_by_tiers(F.col("tox"), F.col("issues"), tiers)
    return found.groupBy("suite_id", rating.alias("rating")).agg(F.count("*").alias("n"))


@query
def rubric_check(spark, sf):
    """The gold overlap and the boolean rules of a rubric, which count it as one of them."""
    from ..plans.monitoring import gold_overlap
    from ..plans.monitoring import rubric_check as check

    candidate, gold = F.col("candidate"), F.col("baseline")
    rules = {"brief": F.length(candidate) < 2000, "no_bars": ~F.contains(candidate, F.lit("|"))}
    found = check(candidate, gold, rules)
    return given.eval_pairs(spark, sf).select(
        "sample_id",
        round_exact(gold_overlap(candidate, gold), 4).alias("gold_overlap"),
        F.array_join(F.transform(F.filter(found, lambda r: r["passed"]), lambda r: r["rule"]), "|").alias("passed"),
        F.array_join(F.transform(F.filter(found, lambda r: ~r["passed"]), lambda r: r["rule"]), "|").alias("failed"),
    )


@query
def run_metrics(spark, sf):
    from ..plans.monitoring import run_metrics as metrics

    return metrics(given.runs(spark, sf)).withColumn("pass_ratio", round_exact("pass_ratio", 6))


@query
def metrics_by_evaluator(spark, sf):
    """Error rate and regressions by suite and metric, from partials of every language merged."""
    from ..plans.monitoring import metric_partials, metric_report

    pairs = _pairs(spark, sf).withColumn("toxicity", F.when(F.col("sample_id") % 10 != 7, F.col("toxicity")))
    scored = evaluate(pairs, (A, B), CORPUS, BUILT_IN, ("score", "error"))
    rows = ab.paired_scores(scored, BUILT_IN, ["suite_id", "lang"], A, B, errors=True)
    results = rows.select(
        F.concat_ws("/", "suite_id", "lang").alias("suite_id"), "evaluator", F.col("score_a").alias("score"),
        F.when(F.col("error_b").isNull(), F.col("score_b")).alias("baseline"), F.col("error_a").alias("error"),
    )
    partials = metric_partials(results).withColumn("suite_id", F.substring_index("suite_id", "/", 1))
    return metric_report(partials).select(
        "level", "suite_id", "evaluator", "results", "errors", "scored", "regressions", "sketched",
        round_exact("error_rate", 6).alias("error_rate"), round_exact("mean_score", 6).alias("mean_score"),
    )


@query
def regression_trend(spark, sf):
    from ..plans.monitoring import regression_trend as trend

    result = trend(given.runs(spark, sf))
    return result.select(
        "suite_id", "suite_version", "runs",
        *[round_exact(c, 6).alias(c) for c in ("mean_score", "change", "rolling_mean")],
    )


@query
def golden_set_latest(spark, sf):
    cases = given.table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("version"), "event_type", "props"
    )
    return history.latest_by(cases, "case_id", "version")


@query
def enforcement_level(spark, sf):
    from ..plans.monitoring import critical_flags
    from ..plans.monitoring import enforcement_level as level

    decided = _decided(spark, sf)
    critical = F.size(critical_flags(F.col("flags"), CORPUS)) > 0
    return decided.select("sample_id", level(F.col("reason_code"), critical).alias("level"))


@query
def no_regression_on_blockers(spark, sf):
    from ..plans.monitoring import regressed_dimensions

    scored = evaluate(_pairs(spark, sf), (A, B), CORPUS, parts=("score",))
    down = regressed_dimensions(
        {n: F.col(A.out(f"{n}_score")) for n in BUILT_IN},
        {n: F.col(B.out(f"{n}_score")) for n in BUILT_IN},
    )
    return scored.select("sample_id", _joined(down).alias("regressed"))


def _streamed(spark, parts, **how):
    """Run a spot check over ``parts`` of rows that arrive one after the other; its folder."""
    from ..session import shared_folder
    from ..streaming.spot_check import start_spot_check

    incoming, out = shared_folder(spark, "spot-check-in"), shared_folder(spark, "spot-check")
    checkpoint = shared_folder(spark, "spot-check-state")
    for part in parts:
        part.write.mode("append").parquet(incoming)
        # every part is a run of its own, so all but the first are restarts from the checkpoint
        stream = spark.readStream.schema(part.schema).parquet(incoming)
        start_spot_check(stream, path=out, checkpoint=checkpoint, available_now=True, **how).awaitTermination()
    return out


def _day(c):
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd")


@query
def spot_check_stream(spark, sf):
    """The events as a stream of decided runs, counted per day."""
    from ..streaming.spot_check import current_windows

    runs = given.runs_of(given.table(spark, sf, "events"))
    out = _streamed(spark, [runs], decide=lambda df: df, key="run_id", time="saved_at", window="1 day")
    return current_windows(spark, out).select(_day("window_start").alias("day"), "suite_id", "decision", "n")


@query
def spot_check_gate(spark, sf):
    """Gate requests in three arrivals: half of the keys decided in the stream, late ones apart.

    Requests are an hour apart; every tenth comes thirty days after its time.
    """
    from ..streaming.spot_check import current_windows, read_table

    requests = given.requests(spark, sf)
    last = given.table(spark, sf, "documents").agg(F.max("doc_id")).first()[0] or 0
    hours = F.col("sample_id") - F.when(F.col("sample_id") % 10 == 0, 720).otherwise(0)
    timed = requests.withColumn("asked_at", F.timestamp_seconds(F.lit(1704067200) + hours * 3600))
    part = F.floor(F.col("sample_id") * 3 / (last + 1))
    out = _streamed(
        spark, [timed.where(part == i) for i in range(3)], decide=lambda df: gate.decide(df, CORPUS),
        key="sample_id", time="asked_at", rate=0.5, window="1 day",
    )
    late = read_table(spark, out, "late").groupBy("window_start", "window_end", "suite_id", "decision").agg(
        F.count(F.lit(1)).alias("n")
    )
    both = current_windows(spark, out).withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select(_day("window_start").alias("day"), "suite_id", "decision", "n", "late")
