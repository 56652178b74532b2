"""Near-duplicate operators and the decontamination against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import decontamination, line_dedup, linking, minhash_dedup
from tests.llm.conftest import prose


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def closed(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def expected_groups(rows, size):
    sets = [shingle_set(r[1], size) for r in rows]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    return sets, closed(len(rows), links)


def test_near_duplicates_match_brute_force(docs, corpus):
    for size in (2, 5):
        sets, roots = expected_groups(corpus, size)
        lowest = {}
        for row, root in zip(corpus, roots):
            if row[0] is not None:
                lowest[root] = min(lowest.get(root, row[0]), row[0])
        want = sorted(
            ((r[0], len(s), lowest.get(root) if s else r[0]) for r, s, root in zip(corpus, sets, roots)), key=str
        )
        got = minhash_dedup.near_duplicates(docs, size).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_representatives_keep_one_row_of_each_group(docs, corpus):
    sets, roots = expected_groups(corpus, 5)
    out = minhash_dedup.representatives(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    groups = {root for root, s in zip(roots, sets) if s}
    assert len(texts) == len(groups) + sum(not s for s in sets)


def test_empty_tables_stay_empty(spark, empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0
    assert minhash_dedup.representatives(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.clean(empty, items.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.node: r.component for r in linking.components(links).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[501] == 500


def test_components_of_several_partitions(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(3000), draw.randrange(3000)) for _ in range(1500)] + [(i + 1, i) for i in range(5000, 5400)]
    roots = closed(6000, pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in linking.components(links, part_links=100).collect()}
    assert got == {i: roots[i] for a, b in pairs if a != b for i in (a, b)}


@pytest.mark.parametrize("items", [10**6, 60])
def test_every_link_of_a_group_is_found(spark, items):
    # a chain of near sets in one key, a stranger, and a second chain that shares its middle
    sets = {i: np.arange(i, i + 20) for i in range(1, 40)} | {0: np.arange(900, 920)}
    sets |= {100 + i: np.concatenate([np.arange(500 + i, 515 + i), np.arange(5)]) for i in range(0, 12, 2)}
    entries = spark.createDataFrame([(9, i) for i in sets], "key long, node long")
    payloads = spark.createDataFrame(
        [(i, x.astype(np.uint64).tobytes(), len(x)) for i, x in sets.items()], "node long, payload binary, size long"
    )
    labels = linking.link(
        entries, lambda nodes: payloads.join(nodes, "node"), lambda x: np.frombuffer(x, np.uint64), 80, items
    )
    names = sorted(sets)
    roots = closed(len(names), [
        (i, j) for i, j in combinations(range(len(names)), 2)
        if 100 * len(x := {*sets[names[i]]} & {*sets[names[j]]}) >= 80 * (len({*sets[names[i]]} | {*sets[names[j]]}))
    ])
    assert {r.node: r.component for r in labels.collect()} == {n: names[r] for n, r in zip(names, roots)}


def test_links_of_random_groups_equal_brute_force():
    draw = np.random.default_rng(4)
    for n in (2, 30, 300):
        base = draw.integers(0, 10**6, 60)
        sets = []
        for _ in range(n):
            x = base.copy()
            some = draw.random(60) < draw.choice([0.02, 0.1, 0.2])
            x[some] = draw.integers(0, 40, some.sum())
            sets.append(np.unique(np.concatenate([x, draw.integers(0, 10**6, draw.integers(0, 9))])).astype(np.uint64))
        whole = [{*x.tolist()} for x in sets]
        links = [
            (i, j) for i, j in combinations(range(n), 2)
            if 100 * len(whole[i] & whole[j]) >= 80 * len(whole[i] | whole[j])
        ]
        found = linking.alike_in_group(sets, 80)
        assert set(found) <= set(links) and closed(n, found) == closed(n, links)


def jaccard_lines(a, b):
    x, y = ({s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in (a, b))
    return 100 * len(x & y) >= 80 * len(x | y)


def test_line_dedup_matches_brute_force(docs, corpus):
    # wholly repeated rows are one document
    lines = []
    for row in {(r[0], r[1]) for r in corpus}:
        for i, x in line_dedup.eligible((row[1] or "").encode()):
            lines.append((row[0], row[1], i, x))
    roots = closed(len(lines), [
        (i, j) for i, j in combinations(range(len(lines)), 2) if jaccard_lines(lines[i][3], lines[j][3])
    ])
    groups = {}
    for line, root in zip(lines, roots):
        groups.setdefault(root, []).append(line)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_removed"]
    got = out.collect()
    assert len(got) == len(corpus)
    assert sum({(r.doc_id, r.n_lines_removed, r.text): r.n_lines_removed for r in got}.values()) == sum(
        len(g) - 1 for g in groups.values()
    )
    before = {}
    for r in corpus:
        before.setdefault(r[0], []).append(r[1])
    for r in got:
        # a text of which nothing is left is empty, like a text of one empty line
        assert any(
            (r.text is None) == (t is None) and (t is None or _removed(t, r.text, r.n_lines_removed))
            for t in before[r.doc_id]
        )
    rest = [x for r in got if r.doc_id is not None for _, x in line_dedup.eligible((r.text or "").encode())]
    twice = [x for x in set(rest) if rest.count(x) > 1]
    assert all(x in {y for _, y in line_dedup.eligible(corpus[7][1].encode())} for x in twice)


def _removed(text, left, n):
    before, kept = text.split("\n"), left.split("\n")
    if len(before) == n:
        return left == ""
    rest = iter(before)
    return len(before) - len(kept) == n and all(x in rest for x in kept)


def test_masks_meet_every_window_with_two_substitutions():
    for size, odd in ((13, 2), (12, 2), (11, 2), (10, 2), (9, 1), (8, 1)):
        for gaps in combinations(range(size), odd):
            assert any(
                all(not (bit == "1" and s + i in gaps) for i, bit in enumerate(mask))
                for mask in decontamination.MASKS for s in range(size - len(mask) + 1)
            )


def test_decontamination_matches_brute_force(spark):
    draw = random.Random(1)
    items = [(i, prose(draw, 8 + i, 20 + i)) for i in range(6)] + [(7, "too short"), (8, None), (9, "")]
    items.append(items[0])
    texts = []
    for i in range(40):
        words = prose(draw, 30, 60).split()
        passage = items[i % 6][1].split()
        for _ in range(i % 8):
            passage[draw.randrange(len(passage))] = "other"
        words[10:10] = passage if i % 3 else []
        texts.append("  ".join(words).upper() if i % 5 == 0 else ", ".join(words))
    rows = [*enumerate(texts), (40, None), (41, ""), (None, texts[1]), (1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def cut(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]

    def hit(text):
        words = cut(text)
        for _, item in items:
            item = cut(item)
            size = min(13, len(item))
            if len(item) < 8:
                continue
            for i in range(len(words) - size + 1):
                for j in range(len(item) - size + 1):
                    if 100 * sum(a == b for a, b in zip(words[i : i + size], item[j : j + size])) >= 80 * size:
                        return True
        return False

    want = sorted(((i, hit(t)) for i, t in rows), key=str)
    got = decontamination.contaminated(docs, bench)
    assert sorted(((r.doc_id, r.contaminated) for r in got.collect()), key=str) == want
    assert 5 < sum(x for _, x in want) < 40
    kept = decontamination.clean(docs.withColumn("seed", F.lit(1)), bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, x in want if not x), key=str)
    several = decontamination.overlaps(docs, bench, block=50).select("d", "h", "item_id", "matched")
    assert sorted(several.collect()) == sorted(decontamination.overlaps(docs, bench).collect())


def test_hits_take_along_few_words_and_shared_pieces_are_compared_once(spark):
    draw = random.Random(4)
    passage = prose(draw, 20, 20)
    docs = spark.createDataFrame([(0, " ".join([passage] * 200)), (1, prose(draw, 30, 30))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, passage) for i in range(50)], "item_id long, text string")
    known = decontamination.pieces(bench)
    assert known.count() == 50 and known.select("piece").distinct().count() == 1
    corpus = docs.select(F.col("doc_id").alias("d"), F.lit(0).alias("h"), decontamination.word_hashes("text").alias("words"))
    placed = corpus.select("d", "h", "words", F.posexplode("words").alias("i", "word")).select(
        "d", "h", "words", "i", F.explode(decontamination.seeds(F.col("words"), F.col("i"), decontamination.MASKS)).alias("seed")
    )
    hits = decontamination._hits(placed, known.select("piece", "item").distinct(), decontamination.MASKS)
    assert "words" not in hits.columns and hits.count() <= 200 * 20 * len(decontamination.MASKS)
    most = hits.agg(F.max(F.greatest(F.size("near.mine"), F.size("near.theirs")))).first()[0]
    assert most <= 2 * decontamination.WINDOW - 1
    assert [tuple(r) for r in decontamination.contaminated(docs, bench).sort("doc_id").collect()] == [
        (0, True, 50, 100.0), (1, False, 0, None)
    ]
