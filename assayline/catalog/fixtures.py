"""Views over the given tables that play the part of evaluation inputs.

Every document is used whole, and so are its source and prompt. As a stand-in for a
grounding source, documents with an even id are given their own text, which grounds every
sentence, and others the text of the document after them, which grounds some at best. The
prompt is the text after, too; the last document has its own text for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inputs(df: DataFrame, text: str, key: str, following: DataFrame) -> DataFrame:
    """Add source and prompt; ``following`` has each document's id and the text after it."""
    joined = df.join(following.withColumnRenamed("doc_id", key), key, "left")
    after = F.coalesce(F.col("following"), F.col(text))
    return joined.withColumns(
        {"source": F.when(F.col(key) % 2 == 0, F.col(text)).otherwise(after), "prompt": after}
    ).drop("following")


def _following(docs: DataFrame) -> DataFrame:
    return docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("following"))


def _toxicity() -> Column:
    level = F.when(F.col("toxic") == 1, 0.9).when(F.col("toxic") == 0, 0.05).otherwise(0.2)
    return F.create_map(F.lit("toxicity"), level)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per document."""
    whole = documents(spark, sf_dir)
    docs = whole.select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("suite_id"),
        "lang",
        F.col("text").alias("generated"),
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), "quality", "toxic"
    )
    joined = docs.join(labels, "sample_id", "left")
    inputs = _inputs(joined, "generated", "sample_id", _following(whole))
    return inputs.withColumn("toxicity", _toxicity())


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a candidate; its baseline is the document after it, if it has another text."""
    return samples(spark, sf_dir).withColumnRenamed("generated", "candidate").withColumn(
        "baseline", F.when(F.col("prompt") != F.col("candidate"), F.col("prompt"))
    ).select(
        "sample_id", "suite_id", "lang", "candidate", "baseline", "source", "prompt", "toxicity"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate requests: the pairs with thresholds that reach every rule of the cascade."""
    n = F.col("sample_id")
    return eval_pairs(spark, sf_dir).select(
        "*",
        F.col("toxicity").alias("candidate_toxicity"),
        F.create_map(F.lit("toxicity"), F.lit(0.05)).alias("baseline_toxicity"),
        (F.lit(0.25) + F.lit(0.125) * (n % 5)).alias("min_score"),
        F.when(n % 4 == 0, F.array(F.lit("toxicity:toxicity"), F.lit("pii:email")))
        .when(n % 4 == 1, F.array(F.lit("hallucination")))
        .otherwise(F.array().cast("array<string>"))
        .alias("block_on_flags"),
        (n % 3 == 0).alias("store_full_payloads"),
    )


def nli(sentences: Column) -> Column:
    """Entailment probabilities by whole-number rule, in 1/128 so that sums are exact.

    A fixture, not a model: contradiction and entailment tie for some sentences.
    """
    n = F.col("sample_id")

    def probabilities(_, position):
        con = (n * 7 + position * 13) % 64
        ent = (n * 11 + position * 29) % 64
        return F.struct(
            (con / F.lit(128.0)).alias("contradiction"),
            (ent / F.lit(128.0)).alias("entailment"),
            ((F.lit(128) - con - ent) / F.lit(128.0)).alias("neutral"),
        )

    return F.transform(sentences, probabilities)


def sentence_similarity(sentences: Column) -> Column:
    """Similarity per sentence by the same kind of rule, in 1/64."""
    n = F.col("sample_id")
    return F.transform(
        sentences, lambda _, position: ((n * 5 + position * 17) % 65) / F.lit(64.0)
    )


def judge(samples_df: DataFrame) -> DataFrame:
    """Judge scores from the quality labels; unlabelled documents have none."""
    level = F.when(F.col("quality") == 1, 4).otherwise(2)
    answer = F.struct(
        level.alias("coherence"), (level + 1).alias("fluency"), level.alias("relevance")
    )
    return samples_df.withColumn("judge", F.when(F.col("quality").isNotNull(), answer))


def numeric_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated amount per order, checked against the true one."""
    total, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    money = lambda x: x.cast("decimal(18,2)").cast("string")
    amount = (
        F.when(k == 0, money(total * F.lit(1.02)))
        .when(k == 1, money(total * F.lit(1.2)))
        .when(k == 2, money(total))
        .otherwise(F.concat(money(total / F.lit(1000.0)), F.lit(" thousand")))
    )
    return spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("sample_id"),
        F.concat(F.lit("The order total was $"), money(total), F.lit(".")).alias("source"),
        F.concat(F.lit("The order came to $"), amount, F.lit(".")).alias("generated"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved runs: every event is one save, and the user id says which run it saves."""
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    code = F.col("event_id") % 10
    return events.select(
        F.format_string("run-%05d", F.col("user_id")).alias("run_id"),
        F.col("event_id").alias("ingest_seq"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
        # The event times carry no zone; they are taken as UTC, whatever the session zone.
        F.expr(
            "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, "
            "TIMESTAMP_NTZ '1970-01-01 00:00:00', ts), TIMESTAMP '1970-01-01 00:00:00Z')"
        ).alias("saved_at"),
        F.col("event_type").alias("suite_id"),
        F.concat(F.lit("v"), F.floor(F.col("event_id") / 1000).cast("string")).alias(
            "suite_version"
        ),
        (F.col("event_id") * 37 % 10001 / F.lit(10000.0)).alias("aggregate_score"),
        F.when(code < 6, "pass").when(code < 9, "fail").otherwise("human_review").alias("decision"),
        F.when(code < 6, "5b").when(code < 8, "3a").when(code == 8, "2").otherwise("3b").alias(
            "reason_code"
        ),
    )


# Settings whose words do occur in the documents (the default ones never do).
CORPUS_TERMS = ("the", "are", "von")
CORPUS_TOPICS = ("mit", "une")
CORPUS_COMPETITORS = ("tion", "SCH")


def pair_model():
    """A stand-in for an entailment model, by the lengths of source and sentence.

    It refuses sentences with a percent sign, as a model may fail on odd input.
    """

    def probabilities(pairs):
        out = []
        for source, sentence in pairs:
            if "%" in sentence:
                raise ValueError("the model refused a sentence")
            con = (len(sentence) * 7 + len(source)) % 64
            ent = (len(sentence) * 11 + len(source) * 3) % 64
            out.append([con / 128, ent / 128, (128 - con - ent) / 128])
        return out

    return probabilities


def fragile_model():
    """The letter counts, but texts with an at sign raise, and such with a percent sign get short vectors."""
    embed = letter_model()

    def vectors(texts):
        if any("@" in t for t in texts):
            raise ValueError("the model refused a text")
        return [v[:5] if "%" in t else v for t, v in zip(texts, embed(texts), strict=True)]

    return vectors


def toxicity_model():
    """A stand-in for a toxicity model, by the length of the text; it refuses texts with an at sign."""

    def score(texts):
        if any("@" in t for t in texts):
            raise ValueError("the model refused a text")
        return [{"toxicity": len(t) % 64 / 64, "insult": len(t) % 16 / 16} for t in texts]

    return score


def strict_scorer():
    """A user's evaluator over batches: half the score for a text with a bar, an error for one with an at sign."""

    def score(rows):
        out = []
        for row in rows:
            if "@" in row["text"]:
                raise RuntimeError("no addresses, please")
            barred = "|" in row["text"]
            out.append({"score": 0.5 if barred else 1.0, "passed": not barred, "categories": ["strict:bar"] if barred else []})
        return out

    return score


def letter_model():
    """A deterministic stand-in for an embedding model: the counts of the letters a to z."""
    import numpy as np

    def embed(texts):
        out = np.zeros((len(texts), 26), dtype=np.float32)
        for i, text in enumerate(texts):
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) - 97
            out[i] = np.bincount(codes[(codes >= 0) & (codes < 26)], minlength=26)
        return out

    return embed
