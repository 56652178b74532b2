"""The classifier on held-out labels, and the pipeline as a whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayline.llm import mixing, quality_classifier
from tests.llm.conftest import DOCUMENTS, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def judged(spark):
    """Documents and labels: every fifth is bad, by rude words, symbols or repetition."""
    draw = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        words = prose(draw, 30, 120).split()
        kind = i % 15
        if kind == 0:
            words[3::9] = ["fool"] * len(words[3::9])
        elif kind == 5:
            words = [w + "***" for w in words]
        elif kind == 10:
            words = [w for w in words[:9] for _ in range(7)]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", len(" ".join(words))))
        if i % 2:
            labels.append((i, int(kind not in (5, 10)), int(kind == 0)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_are_told_apart(judged):
    docs, labels = judged
    model = quality_classifier.fit(docs, labels)
    got = quality_classifier.score(docs, model).where("doc_id % 2 = 0").collect()
    wrong = [r.doc_id for r in got if r.rejected != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 4
    again = quality_classifier.score(docs.repartition(5), quality_classifier.fit(docs.repartition(3), labels))
    # blocks of other sizes add in another order
    scores = {r.doc_id: r.score for r in again.collect()}
    assert all(r.score == pytest.approx(scores[r.doc_id], rel=1e-9) for r in got)


def test_rounds_teach_what_no_label_shows(spark):
    """Shouted texts are bad, but no labelled one is shouted: the source tells, and the text view learns it."""
    draw = random.Random(21)
    rows, labels = [], []

    def add(kind, source, label=None):
        words = prose(draw, 30, 80).split()
        if kind == "rude":
            words[3::9] = ["fool"] * len(words[3::9])
        if kind == "shouted":
            words = [w.upper() for w in words]
        i = len(rows)
        rows.append((i, " ".join(words), "en", source, 300))
        if label is not None:
            labels.append((i, label, 0))
        return i

    for _ in range(120):
        add("rude", "dump", 0)
        add("good", "press", 1)
    for _ in range(150):
        add("rude", "dump"), add("shouted", "dump"), add("good", "press")
    unseen = [(add("shouted", "elsewhere"), add("good", "elsewhere")) for _ in range(60)]
    docs, known = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS)
    found = {}
    for rounds in (0, 3):
        model = quality_classifier.fit(docs, known, rounds=rounds, trust=0.9)
        text = {r.doc_id: r.text_score for r in quality_classifier.score(docs, model).collect()}
        found[rounds] = [sum(text[pair[k]] >= 0.5 for pair in unseen) for k in (0, 1)]
    assert found[0][0] <= 6 and found[3][0] >= 45
    assert found[0][1] <= 3 and found[3][1] <= 3


def test_sums_do_not_depend_on_partitions(spark, judged):
    docs, labels = judged
    models = [quality_classifier.fit(docs.repartition(n), labels) for n in (1, 7)]
    for a, b in zip(models[0].weights, models[1].weights, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (x == y).all()


def test_classifier_edge_cases(spark, docs, empty, judged):
    _, labels = judged
    scored = quality_classifier.score(docs, quality_classifier.fit(*judged))
    assert scored.columns == [*docs.columns, "text_score", "meta_score", "score", "rejected"]
    assert scored.count() == docs.count() and scored.where("score is null").count() == 0
    for known in (labels.limit(0), labels.where("toxic = 0 and quality = 1")):
        assert quality_classifier.classify(judged[0], known).where("rejected").count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 1, 1)], LABELS).union(labels)
    assert quality_classifier.classify(judged[0], odd).count() == 900


def test_stages_keep_columns_with_clashing_names(spark, tmp_path, judged):
    docs, labels = judged
    names = ["rejected", "score", "n_lines_removed", "a.b", "key", "row", "bad", "fold", "d", "h"]
    wide = docs.limit(60).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such passage anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple(range(len(names)))}, name
    mixed = corpus_pipeline.STAGES[-1][1](spark, wide.withColumn("copy", F.lit(9)), str(tmp_path))
    assert mixed.columns == [*wide.columns, "copy"] and mixed.where("copy > 5").count() == 0


def test_pipeline(spark, tmp_path, judged):
    docs, labels = judged
    near = docs.where("doc_id between 1 and 4").select(
        (F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit("\nmore")).alias("text"), "lang", "source", "n_chars"
    )
    # the same words in other lines
    again = docs.where("doc_id between 1 and 4").select(
        (F.col("doc_id") + 3000).alias("doc_id"), F.regexp_replace("text", r"((?:\S+ ){5}\S+) ", "$1\n").alias("text"),
        "lang", "source", "n_chars",
    )
    leak = "the one passage that a benchmark has and no document should ever contain at all"
    spoilt = docs.where("doc_id between 6 and 9").select(
        (F.col("doc_id") + 2000).alias("doc_id"),
        F.concat(F.lit(leak + " "), F.reverse("text")).alias("text"), "lang", "source", "n_chars",
    )
    table = docs.union(near).union(spoilt).union(again)
    for name, frame in (("documents", table), ("labels", labels), ("benchmark", spark.createDataFrame([(1, leak)], "item_id long, text string"))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = before
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name != names[-1]:
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/out-{names.index(name)}")
        out = spark.read.parquet(f"{tmp_path}/out-{names.index(name)}")
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(str, ran.collect())) == Counter(map(str, out.collect()))
    mixed = spark.read.parquet(f"{tmp_path}/out-3")
    ids = {r.doc_id for r in mixed.select("doc_id").collect()}
    clean = {i for i in range(900) if i % 5}
    assert len(clean - ids) <= 4 and not ids & {2006, 2007, 2008, 2009}
    assert not ids & {3001, 3002, 3003, 3004}
    # lines that repeat are gone from all but their first document
    left = [r.text for r in mixed.where("doc_id between 1001 and 1004").collect()]
    assert set(left) <= {"", "more"} and left.count("more") <= 1
    assert len([i for i in ids if i < 900 and i % 5 == 0]) <= 4
    assert out.count() == sum(r.copies for r in mixing.mix(mixed).collect())


def test_stages_take_empty_tables(spark, tmp_path, empty):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
