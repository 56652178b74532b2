"""Suffix arrays, token counts, fingerprints and mixing against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assayline.llm import fingerprints, mixing, suffix_dedup, token_counts
from tests.llm.conftest import DOCUMENTS, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def without_repeats(texts, size=200):
    """Removed bytes, runs and the rest of each text, by a table of all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(r) else 0
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats():
    draw = random.Random(8)
    passages = [prose(draw, 60, 90) for _ in range(6)]
    texts = []
    for i in range(50):
        parts = [prose(draw, 5, 80)]
        for _ in range(i % 4):
            p = draw.choice(passages)
            start = draw.randrange(40)
            parts += [p[start : start + draw.randint(150, 260)], prose(draw, 1, 30)]
        texts.append(" ".join(parts))
    common = "é" * 60
    texts += [x + common + y for x, y in ((prose(draw, 20, 20), prose(draw, 20, 20)) for _ in range(30))]
    texts += [texts[0], "ab" * 500, "ab" * 100 + "c", "z" * 199, "z" * 200, "z" * 201, "", None, "Of " * 300, texts[3][:199]]
    return texts


def test_repeats_match_a_table_of_all_strings(spark):
    texts = repeats()
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    rows.append((7, prose(random.Random(2), 50, 50)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = without_repeats([t for _, t in rows])
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(
        ((i, *w) for (i, _), w in zip(rows, want)), key=str
    )
    assert 0 < sum(w[1] for w in want)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


def test_levels_mark_across_runs_and_stay_geometric():
    index = suffix_dedup.SuffixLevels()
    draw = np.random.default_rng(1)
    heads = draw.integers(0, 400, 600).astype(np.uint64)
    wholes = draw.integers(0, 3, 600).astype(np.uint64)
    for i in range(0, 600, 25):
        s = slice(i, i + 25)
        index.add(heads[s], wholes[s], np.zeros(25, bool), np.arange(i, i + 25))
        sizes = [len(x["head"]) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    level = index.finished()
    pairs = Counter(zip(heads.tolist(), wholes.tolist()))
    kinds = Counter(h for h, _ in pairs)
    for row, same, other in zip(level["row"], level["same"], level["other"]):
        assert same == (pairs[heads[row], wholes[row]] > 1) and other == (kinds[heads[row]] > 1)


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_token_counts_are_those_of_the_library(docs, corpus):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in corpus), key=str)
    got = token_counts.count_tokens(docs, MODEL, limit=100).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


@pytest.mark.parametrize("size", [3, 20, 300])
def test_pieces_add_up(size):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encode, split = token_counts.load(MODEL)
    texts = [*repeats(), " a", "a ", "a  b   c " * 40, "▁a ▁ b" * 30, "<s> x </s> " * 20, "\n \n a\tb" * 30, " " * 90]
    texts = [t or "" for t in texts]
    assert token_counts.counts(texts, encode, split, size, 200) == [len(x) for x in model.encode(texts)]


def test_token_counts_of_a_json_file(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "some text <|endoftext|>"), (2, None)], "doc_id long, text string")
    want = len(Tokenizer.from_file(path).encode("some text <|endoftext|>", add_special_tokens=False).ids)
    assert [r.n_tokens for r in token_counts.count_tokens(docs, path).orderBy("doc_id").collect()] == [want, 0]
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_fingerprints_add_and_do_not_depend_on_order():
    a, b = b"first paragraph here", b"second one\nand a third, longer paragraph"
    both, turned = fingerprints.sums([a + b"\n" + b, b + b"\n" + a])
    x, y = fingerprints.sums([a, b])
    assert (both == turned).all() and (fingerprints.add(x, y) == both).all()
    assert (fingerprints.remove(both, x) == y).all()
    assert not (fingerprints.sums([a + b"\n" + a])[0] == x).all()
    # a batch gives the same as each text alone
    texts = [(t or "").encode() for t in repeats()]
    alone = np.concatenate([fingerprints.sums([t]) for t in texts])
    assert (fingerprints.sums(texts) == alone).all()


def test_likeness_follows_the_share_of_common_text():
    draw = random.Random(4)
    a, b = (prose(draw, 400, 400).encode() for _ in range(2))
    near = [fingerprints.likeness(*fingerprints.sums([a, a[:k] + b[k : len(a)]])[:, None])[0] for k in (0, 1000, len(a))]
    assert near[0] < 0.25 and 0.3 < near[1] < 0.95 and near[2] == 1


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_edits_match_a_plain_loop(docs, corpus, ranges):
    got = fingerprints.fingerprints_of_edits(docs, ranges).collect()
    ids = [r.doc_id for r in got]
    assert len(got) == len(corpus)
    single = [r for r in corpus if r[0] is not None and r[0] != 7]
    order = sorted((r[0] for r in single), reverse=True)
    text = {r[0]: r[1] or "" for r in single}
    print_of = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        if r.doc_id in (None, 7, 8, 0):  # neighbours of repeated and null ids: below
            continue
        following = text[order[(order.index(r.doc_id) + 1) % len(order)]]
        new = fingerprints.edited(text[r.doc_id], following)
        assert r.n_chars == len(text[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.edited_fingerprint == fingerprints.encoded(fingerprints.sums([new.encode()]))[0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert ids.count(7) == 3 and ids.count(None) == 1
    last = next(r for r in got if r.doc_id is None)  # after the last comes the first
    new = fingerprints.edited(corpus[3][1], text[order[0]])
    assert last.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    assert print_of[40] == print_of[41] == print_of[42]


def test_one_document_is_its_own_neighbour(spark, empty):
    docs = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    row = fingerprints.fingerprints_of_edits(docs).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1
    assert fingerprints.fingerprints_of_edits(empty).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame(
        [("a", 10), ("b", 1000), ("c", 5), (None, 100), ("é", 0)], "source string, source_size long"
    )
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert sum(got.values()) == pytest.approx(1115) and got["a"] == 30 and got["c"] == 15 and got["é"] == 0
    # b and the null source share the rest by 2 : 2, but the latter is full at 300
    assert got[None] == 300 and got["b"] == pytest.approx(770)


def test_mixture(spark, docs, corpus, empty):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(corpus)
    assert sorted(mixed, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)
    assert all(0 <= r.taken <= 3 * r.size for r in mixed)
    out = mixing.repeat(docs)
    assert out.columns == [*docs.columns, "copy"]
    assert out.count() == sum(r.copies for r in mixed)
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0


def test_taken_words_are_near_the_target(spark):
    draw = random.Random(6)
    rows = [(i, "w " * draw.choice([1, 5, 20, 300]), "en", f"s{i % 5 if i % 3 else 0}", 0) for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCUMENTS)).collect()
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.03)
