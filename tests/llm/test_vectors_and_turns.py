"""Top-k search, clustering and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import centroid_clustering, conversation_repair, topk_search

VECTORS = "vec_id long, embedding array<float>, `row` string, shard int, `a.b` int"


def whole(vector):
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    return [int(np.floor(256 * float(np.float32(x)))) for x in vector]


@pytest.fixture(scope="module")
def rows():
    """Vectors in clumps, many of them equal, with nulls, non-finite ones, other sizes and repeated ids."""
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = [(i, [x + draw.gauss(0, 0.2) for x in centres[i % 6]]) for i in range(600)]
    out += [(1000 + i, centres[0]) for i in range(300)]
    out += [(50, centres[1]), (50, centres[1]), (2000, None), (2050, [1.0, None] + [0.0] * 6)]
    out += [(2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [0.5, 1.0]), (2201, [1.0, 1.0])]
    out += [(None, centres[2]), (2250, []), (2251, []), (2300, [0.0] * 8)]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 1) for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("shard_rows", [100_000, 97])
def test_topk_is_that_of_a_full_scan(vectors, rows, shard_rows):
    kept = [(i, whole(v)) for i, v in rows]
    kept = [(n, i, v) for n, (i, v) in enumerate(kept) if v is not None]
    want = []
    for n, i, q in kept:
        if i is None or i % 50:
            continue
        scores = sorted(
            (-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for m, j, v in kept if m != n and len(v) == len(q)
        )
        want += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(scores[:5])]
    got = topk_search.search(vectors, F.col("vec_id") % 50 == 0, shard_rows=shard_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_topk_of_few_rows(spark, vectors):
    assert topk_search.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [3.0])], "vec_id long, embedding array<float>")
    got = topk_search.search(few, F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)}


def test_large_components_stay_exact(spark):
    big = spark.createDataFrame(
        [(0, [3e5 + i / 256 for i in range(4)]), (1, [3e5] * 4), (2, [1e30] * 4)], "vec_id long, embedding array<double>"
    )
    got = {r.vec_id: r.score for r in topk_search.search(big, F.col("vec_id") == 0).collect()}
    base = int(3e5 * 256)
    assert got == {1: sum((base + i) * base for i in range(4)), 2: sum((base + i) * 2**27 for i in range(4))}


def test_search_opens_few_nodes_where_bounds_allow():
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 4000, (20, 16))
    points = np.floor(np.repeat(centres, 500, axis=0) + draw.normal(0, 20, (10_000, 16))).astype(np.int64)
    tree = topk_search.BallTree(points, np.arange(10_000), np.arange(10_000))
    scored = []
    whole_scores = tree.scores
    tree.scores = lambda q, own: scored.append(len(own)) or whole_scores(q, own)
    tree.search(points[:1], np.arange(1), np.full(1, topk_search.LOWEST), 5)
    assert sum(scored) < 2_000
    scored.clear()
    tree.search(points[:1], np.arange(1), np.full(1, 2**62), 5)  # a shared kth score closes the rest
    assert not scored


def plain_clusters(kept, k, rounds):
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))
    centroids = [list(v) for _, v in order[:k]]

    def assign(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(assign(v)[1], []).append(v)
        for i, own in members.items():
            centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, assign(v)[1], assign(v)[0]) for i, v in kept], centroids


def packed(v):
    return np.array(v, np.int64).tobytes()


@pytest.mark.parametrize("lead", [1, 5, 8])
def test_clusters_are_those_of_plain_rounds(vectors, rows, lead):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == 8 and whole(v) is not None]
    want, centroids = plain_clusters(kept, 7, 3)
    got, final = centroid_clustering.cluster(vectors, centroids=7, rounds=3, size=8, lead=lead)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert final.tolist() == centroids


def test_clusters_of_few_vectors(spark, vectors):
    assert centroid_clustering.clustered(vectors).count() == 0  # none has 64 components
    few = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    got = centroid_clustering.clustered(few).collect()
    assert {(r.vec_id, r.distance, r.inertia) for r in got} == {(i, 0, 0) for i in range(3)}
    by_id = {r.vec_id: r.centroid_sha256 for r in got}
    assert by_id[2] == hashlib.sha256(",".join(["512"] * 64).encode()).hexdigest()


def test_bounds_never_exceed_distances():
    draw = np.random.default_rng(3)
    points = draw.integers(-200, 200, (300, 12))
    centroids = points[:20].copy()
    centroids[7] = centroids[3]
    basis = centroid_clustering.rotation(points.astype(float), 4)
    lead, rest = centroid_clustering.rotated(points, basis)
    found, distance = centroid_clustering.nearest(points, lead, rest, centroids, basis)
    full = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (found == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        if not last:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def plain_repair(rows, faults):
    """The least (cost, audit) over all edit sequences, by a table filled forwards."""
    def brief(text):
        # what may still follow depends on the last initial only, and on whether there is none
        return {"a": "ua", "u": "u"}.get(text[-1:], text)

    # a layer: weights by initials, checked against the regular expression
    layer = {"": (0, "", [])}

    def offer(table, text, weight):
        key = brief(text)
        if re.fullmatch(r"s?(ua)*u?", text) and (key not in table or weight[:2] < table[key][:2]):
            table[key] = weight
            return True
        return False

    def inserted(table):
        waiting = list(table)
        while waiting:
            key = waiting.pop()
            cost, audit, out = table[key]
            for role in ("user", "assistant"):
                new = (cost + 3, audit + "I", [*out, (role, "")])
                text = key + role[0]
                if offer(table, text, new):
                    waiting.append(brief(text))
        return table

    layer = inserted(layer)
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for key, (cost, audit, out) in layer.items():
            offer(after, key, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 3 * (fault == "truncated")
            if role[:1] in "sua" and role[:1]:
                offer(after, key + role[0], (more, audit + "K", [*out, (role, text)]))
            for new in ("user", "assistant"):
                offer(after, key + new[0], (more + 3, audit + "R", [*out, (new, text)]))
        layer = inserted(after)
    best = min((w for key, w in layer.items() if key == "" or key[-1] == "a"), key=lambda w: w[:2])
    return best


def plain_report(rows):
    faults = plain_faults(rows)
    turns = {t for _, t, *_ in rows if t is not None}
    cost, audit, out = plain_repair(rows, faults)
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(8)
    texts = ["Yes.", "Yes.", "no", "What is it? ", "", " \n", None, "Long text. And more", "é!", " "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    out = []
    for conv in range(150):
        n = draw.randint(1, 8)
        turns = sorted(draw.sample(range(12), n))
        out += [
            (conv, t, ["user", "assistant"][i % 2] if draw.random() < 0.6 else draw.choice(roles), draw.choice(texts))
            for i, t in enumerate(turns)
        ]
    out += [(500, None, "user", "Hi."), (500, 3, "assistant", "Ho."), (None, 1, "user", "Who?"), (None, None, "system", "S.")]
    out += [(501, t, ["user", "assistant"][t % 2] if t % 9 else "user", f"Turn {t}.") for t in range(700)]
    return out


@pytest.fixture(scope="module")
def turns(spark, conversations):
    data = [(*r, "x", 1) for r in conversations]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, dropped string, nth int").repartition(4)


def test_repairs_are_the_lightest(turns, conversations):
    want = {}
    for conv in {r[0] for r in conversations}:
        own = [r for r in conversations if r[0] == conv]
        own = sorted(plain_damage(own), key=lambda r: (r[1] is not None, r[1] or 0))
        want[conv] = plain_report(own)
    damaged = conversation_repair.damaged(turns)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.reports(damaged, dropped="dropped").collect()}
    assert got == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert any(w == nothing for w in want.values()) and any("R" in w[6] for w in want.values())


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_segments_change_nothing(monkeypatch, conversations, segment):
    own = sorted(plain_damage([r for r in conversations if r[0] == 501]), key=lambda r: r[1])
    for rows in [own, *([r for r in conversations if r[0] == c] for c in range(150))]:
        rows = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
        faults = plain_faults(rows)
        monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
        repair = conversation_repair.Repair()
        out = []
        for (_, turn, role, text), fault in zip(rows, faults):
            out += repair.add(turn, role, text, fault)
        out += repair.finish()
        assert tuple(repair.report().values()) == plain_report(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, *_ in out))


def test_lightest_over_all_edit_sequences():
    """Every sequence of edits of a few rows, written out."""
    pattern = re.compile("(s?(ua)+)?")
    for initials in product("suax", repeat=3):
        for bad in range(4):
            rows = [(c, bad == i + 1, i == 2) for i, c in enumerate(initials)]
            best = None
            gaps = ["", "u", "a", "ua", "au"]
            choices = [["D"] if delete else ["D", "K", "Ru", "Ra"] for _, delete, _ in rows]
            for inserts in product(gaps, repeat=4):
                for edits in product(*choices):
                    text, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * len(inserts[0])
                    for (c, _, truncated), edit, more in zip(rows, edits, inserts[1:]):
                        kept = {"D": "", "K": c}.get(edit, edit[-1])
                        cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + 3 * (truncated and edit != "D") + 3 * len(more)
                        text += kept + more
                        audit += edit[0] + "I" * len(more)
                    if pattern.fullmatch(text) and (best is None or (cost, audit) < best):
                        best = cost, audit
            found = conversation_repair.lightest(rows, {0: (0, "")}, True)
            assert list(found.values()) == [best]


def test_repaired_turns_and_empty_tables(spark, turns):
    out = conversation_repair.repaired_turns(turns)
    assert out.columns == ["conv_id", "position", "role", "text", "edit"]
    rows = out.where("conv_id = 501").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    joined = "\n".join(f"{r.role}:{r.text}" for r in rows)
    report = conversation_repair.reports(turns).where("conv_id = 501").first()
    assert report.repaired_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert conversation_repair.reports(turns.limit(0)).count() == 0
    assert conversation_repair.repaired_turns(turns.limit(0)).count() == 0
    assert conversation_repair.reports(conversation_repair.damaged(turns.limit(0)), dropped="dropped").count() == 0
