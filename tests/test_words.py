"""Words cut for many texts at once: the same as those of the JVM, and no others in the plan of the evaluators."""

import pyarrow as pa
from pyspark.sql import functions as F

from assayline.functions import lexical, words
from assayline.functions.rules import RuleIndex, fold, folded
from assayline.functions.text import kept_sentences, raw_sentences, split_sentences, strip
from assayline.operators import quality
from assayline.operators.registry import evaluate
from assayline.settings import BUILT_IN, Slot

TEXTS = [
    "The sky is blue. Water is wet, the water_level ÉTÉ is 3½ m.",
    "", " \n\t", "...", "a", "İSTANBUL ΣΑΣ ΣΑΣ. Straße STRASSE ǅ ſ K",
    "x\ny\n\nx  Y　z z", "日本語 テキスト 12３ ٣ ①", "😀word😀 𝔘𝔫𝔦 𐐀𐐨 naïve naïve", "A. B! C? d.  E.\x1c F",
    "However, in additionally moreover HOWEVER as a result.", None,
]


def test_word_sets_are_those_of_the_jvm(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    expected = [set(r.w) if r.w is not None else set() for r in df.select("id", lexical.token_set(F.col("t")).alias("w")).orderBy("id").collect()]
    cut = words.words_of([t.lower() if t else "" for t in TEXTS])
    found = [set() for _ in TEXTS]
    for owner, start, end, code in zip(cut.owner, cut.start, cut.end, cut.codes, strict=True):
        word = cut.different[int(code)].as_py()
        assert TEXTS[owner].lower()[start:end] == word
        found[owner].add(word)
    assert found == expected
    (sets,) = words.word_sets(pa.array(TEXTS))
    assert [len(s) for s in sets.to_pylist()] == [len(e) for e in expected]


def test_word_sets_share_their_numbers_and_keep_rows():
    nested = pa.array([["a B", "b b"], None, [], ["c", ""]])
    sentences, texts = words.word_sets(nested, pa.array(["B", None, "", "C a"]))
    s, t = sentences.to_pylist(), texts.to_pylist()
    assert s[1] is None and s[2] == [] and s[3][1] == [] and t[1] == t[2] == []
    assert s[0][1] == t[0] and len(s[0][0]) == 2 and set(t[3]) == set(s[0][0]) - set(t[0]) | set(s[3][0])
    assert [x.to_pylist() for x in words.word_sets(nested.slice(2), pa.array([], pa.string()))] == [[[], [[0], []]], []]
    bad = pa.StringArray.from_buffers(1, pa.py_buffer(b"\0\0\0\0\3\0\0\0"), pa.py_buffer(b"a\xffb"))
    assert len(words.word_sets(bad)[0][0]) == 2


def test_matches_over_texts_are_those_over_sets(spark):
    sentences = [t for t in TEXTS if t]
    df = spark.createDataFrame([(sentences, TEXTS[0]), ([], ""), (None, "x y"), (sentences * 3, "The sky")], "s array<string>, t string")
    sets, facts = F.transform("s", lexical.token_set), ["water is wet", "", "ΣΑΣ"]
    row = df.select(
        lexical.text_matches(F.col("s"), F.col("s"), facts).alias("a"),
        lexical.best_matches(sets, sets, facts).alias("b"),
        lexical.text_grounding(F.col("s"), F.col("t")).alias("c"),
        lexical.sentence_grounding(sets, lexical.token_set(F.col("t"))).alias("d"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in row) and row[0].a


def test_rules_of_many_texts_are_those_of_each():
    for values in (["the", "water is", "été", "-x", ". f", "straße", "K"], ["", "is"], ["b b"], ["\n"]):
        index = RuleIndex(values)
        assert index.matches_of(TEXTS) == [index.matches(t) if t else [] for t in TEXTS]
    assert folded([t or "" for t in TEXTS]) == [fold(t or "") for t in TEXTS]
    assert RuleIndex(["a"]).matches_of([]) == []


def test_counts_of_quality_are_those_of_the_columns(spark):
    rows = [(t, p) for t in TEXTS for p in (TEXTS[0], "", None, "x Y q")]
    df = spark.createDataFrame(rows, "t string, p string")
    t, p = F.col("t"), F.coalesce("p", F.lit(""))
    counts = quality.word_counts(t, F.col("p"))
    words_of = F.size(quality.words(t))
    for r in df.select(
        counts.alias("c"), words_of.alias("w"), quality.transition_count(t).alias("n"), quality.prompt_overlap(t, p).alias("o")
    ).collect():
        assert (r.c.words, r.c.transitions, r.c.overlap) == (r.w, r.n, r.o)


def test_pieces_of_a_text_are_stripped_already(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    pieces = raw_sentences(F.col("t"))
    for r in df.select(pieces.alias("p"), F.transform(pieces, strip).alias("s"), split_sentences(F.col("t")).alias("k"),
                       kept_sentences(pieces).alias("q")).collect():
        assert r.p == r.s and r.k == r.q


def test_evaluators_cut_no_words_in_the_jvm(spark):
    rows = spark.createDataFrame([("a", "b", "c", "d", {"t": 0.1})], "candidate string, baseline string, source string, prompt string, toxicity map<string,double>")
    slots = (Slot(text="candidate", prefix="a_"), Slot(text="baseline", prefix="b_"))
    plan = evaluate(rows, slots, names=BUILT_IN, parts=("score",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_intersect" not in plan and r"\p{L}\p{N}_]+" not in plan


def test_slots_share_the_numbers_of_their_source(spark):
    rows = spark.createDataFrame([("It is 5 km.", "It was 6 km long.", "It is 5 km.")], "candidate string, baseline string, source string")
    slots = (Slot(text="candidate", prefix="a_"), Slot(text="baseline", prefix="b_"))
    plan = evaluate(rows, slots, names=["factual_accuracy"], parts=("score",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _source__numbers") == 1
