"""Model hooks: bounded calls, the same rows whatever the chunks, failures kept to their rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.catalog import fixtures
from assayline.functions.batches import bounded, halved
from assayline.operators.models import toxicity_scorer, with_embedding_scores, with_nli_scores
from assayline.operators.registry import evaluate, from_function, registered
from assayline.settings import Slot

TEXTS = [
    ("The first sentence is here. The second one follows it.", "The first sentence is here. Others too."),
    ("One more sentence for 50% of it all.", "A source of its own, quite short."),
    ("", "nothing to say"), (None, "a source"), ("Some long enough sentence.", None), ("Short.", "x"),
    ("Ends with an address a@b.cc, see there.", "A plain source text."),
] * 5


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(
        [(i, t, s, "p") for i, (t, s) in enumerate(TEXTS)],
        "sample_id long, generated string, source string, prompt string",
    )


def test_halving_keeps_failures_apart():
    calls = []

    def score(items):
        calls.append(len(items))
        if any(i in (3, 700) for i in items):
            raise ValueError(f"bad {items[0]}")
        return [i * 2 for i in items]

    got = halved(score, list(range(1000)))
    assert [r for r, _ in got] == [None if i in (3, 700) else 2 * i for i in range(1000)]
    assert [i for i, (_, e) in enumerate(got) if e] == [3, 700] and got[3][1] == "bad 3"
    assert len(calls) <= 2 * 2 * (math.ceil(math.log2(1000)) + 1)
    assert halved(score, []) == []
    # a wrong number of results is a failure, too
    assert all(e == "0 results for 1 items" for _, e in halved(lambda items: [], [1, 2]))


def test_ranges_are_bounded():
    sizes = [3, 3, 3, 50, 1, 1, 1, 1]
    assert bounded(sizes, 7, 3) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    assert bounded([], 7, 3) == []


@pytest.mark.parametrize(("most_pairs", "most_chars"), [(1, 1 << 20), (3, 1 << 20), (1000, 90), (1000, 1 << 20)])
def test_pair_model_sees_bounded_chunks_and_rows_stay_the_same(spark, samples, tmp_path, most_pairs, most_chars):
    seen = str(tmp_path / "seen")

    def load():
        model = fixtures.pair_model()

        def watched(pairs):
            with open(seen, "a") as f:
                f.write(f"{len(pairs)} {sum(len(a) + len(b) for a, b in pairs)}\n")
            return model(pairs)

        return watched

    got = with_nli_scores(samples, load, most_pairs=most_pairs, most_chars=most_chars).orderBy("sample_id").collect()
    plain = with_nli_scores(samples, fixtures.pair_model).orderBy("sample_id").collect()
    assert [(r.nli, r.nli_error) for r in got] == [(r.nli, r.nli_error) for r in plain]
    for line in open(seen):
        n, chars = map(int, line.split())
        assert n <= most_pairs and (chars <= most_chars or n == 1)
    first, second, empty, missing, no_source = got[:5]
    assert len(first.nli) == 2 and first.nli_error is None
    assert second.nli is None and second.nli_error == "the model refused a sentence"
    assert empty.nli == [] and missing.nli is None and missing.nli_error is None and len(no_source.nli) == 1


def test_failed_pairs_are_error_rows(spark, samples):
    scored = with_nli_scores(samples, fixtures.pair_model)
    rows = evaluate(scored, Slot(nli="nli", model_error="nli_error"), names=["hallucination"]).orderBy("sample_id").collect()
    assert rows[1]["hallucination_error"] == "the model refused a sentence"
    assert rows[1]["hallucination_score"] == 0.0 and rows[1]["hallucination_flags"] == []
    assert rows[0]["hallucination_error"] is None and rows[0]["hallucination_method"] == "model"


@pytest.mark.parametrize("most_texts", [1, 4, 4096])
def test_embedder_failures_and_ragged_vectors_are_error_rows(spark, samples, most_texts):
    got = with_embedding_scores(samples, fixtures.fragile_model, most_texts=most_texts).orderBy("sample_id").collect()
    good = with_embedding_scores(samples, fixtures.letter_model).orderBy("sample_id").collect()
    for i, (r, g) in enumerate(zip(got, good, strict=True)):
        if i % 7 == 1:
            assert (r.embedding_error, r.similarity) == ("vectors of different sizes", None)
        elif i % 7 == 6:
            assert (r.embedding_error, r.claim_matches) == ("the model refused a text", None)
        else:
            assert (r.embedding_error, r.similarity, r.claim_matches) == (None, g.similarity, g.claim_matches)
    assert good[0].claim_matches[0].position == 0 and good[0].claim_matches[0].similarity == pytest.approx(1)


def test_a_model_that_always_fails_fails_rows_only(spark, samples):
    def load():
        def broken(texts):
            raise MemoryError
        return broken

    errors = {r.embedding_error for r in with_embedding_scores(samples, load).collect()}
    assert errors == {None, "MemoryError"}


def test_toxicity_failures_stay_in_their_rows(spark, samples):
    rows = samples.select("generated", toxicity_scorer(fixtures.toxicity_model, 2)(F.col("generated")).alias("t")).collect()
    for r in rows:
        if r.generated is None:
            assert r.t.scores is None and r.t.error is None
        elif "@" in r.generated:
            assert r.t.scores is None and r.t.error == "the model refused a text"
        else:
            assert r.t.scores["toxicity"] == len(r.generated) % 64 / 64 and r.t.error is None


def test_function_evaluator(spark, samples):
    def load():
        def score(rows):
            return [{"score": 2.0 if "50%" in r["text"] else len(r["text"]) / 100, "categories": ["odd:x"]} for r in rows]
        return score

    with registered("mine", from_function("mine", load, most_rows=2)):
        rows = evaluate(samples, names=["mine"]).orderBy("sample_id").collect()
    assert rows[0]["mine_score"] == len(TEXTS[0][0]) / 100 and rows[0]["mine_passed"]
    assert [f["category"] for f in rows[0]["mine_flags"]] == ["odd:x"]
    assert rows[1]["mine_error"] == "a score has to be from 0 to 1, not 2.0" and rows[1]["mine_score"] == 0.0
    assert rows[1]["mine_flags"] == [] and rows[1]["mine_passed"]
    assert rows[3]["mine_error"] == "generated text is missing"
    # columns the function may read need not be there
    with registered("mine", from_function("mine", load)):
        assert evaluate(samples.select("generated"), names=["mine"]).count() == len(TEXTS)


def test_vectors_of_a_chunk_are_checked():
    from assayline.functions.vectors import stacked

    assert stacked([[[1, 2]], np.ones((2, 2))], 3).shape == (3, 2)
    for bad in ([[[1, 2], [1]]], [np.ones((1, 2)), np.ones((1, 3))], [np.ones(3)]):
        with pytest.raises(ValueError):
            stacked(bad, sum(len(b) for b in bad))
