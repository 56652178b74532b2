"""Claims against a knowledge base that is a table: a set-cosine join over an inverted index.

A fact is evidence for a sentence when the cosine of their word sets is at least ``floor``, below
which no claim is supported. Both sides are reduced to distinct word sets. With cosine c, two sets
of n and m words share at least c * sqrt(n * m) of them, c**2 * n or more. So, in one order of the words
for all sets, their first common word is one of the first p = n - ceil(c**2 * n) + 1 of either,
and a second one of the first p + 1. The order puts the ``FREQUENT`` most frequent words of the facts
last, by frequency. A set is indexed by each rare word of its first p, and by each pair of
frequent ones among its first p + 1: single frequent words would let nearly all sets meet. Single ones
serve where pairs cannot: sets so short that one common word is enough, and sets of more than ``LONG``
words, which have too many pairs, with all that are long enough to be like them.

Sets meet as hashes of what they are indexed by, with two bounds of what they can share: the words
from there on, and the bits that 64-bit signatures of the sets do not share. Pairs that pass
are compared word by word, so no result depends on a hash. There is one path for few and for many
facts; only the bounded list of frequent words is sent to the tasks, and the keys of the facts if there are
at most ``MOST_KEYS``: they tell where a sentence lies whether it can meet a fact at all, so that others
are not moved.

What is shuffled is small: the words of a set go as one text, those of facts and of sentences once, dealt
out by the hash that pairs look them up by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.batches import bounded, in_runs
from ..functions.expr import elements
from ..functions.lexical import best_matches, token_set
from ..settings import FactualSettings, Slot
from .shared import source_column, with_shared, without_shared

FREQUENT = 10_000
LONG = 96  # sets of more words are indexed by single words only
# keeps a product that is a whole number from being rounded up by its last bit
_SLACK = 1e-9
MOST_KEYS = 1 << 21  # most keys of facts that are sent to the tasks, 24 bytes each
MOST_WORDS = 1 << 22  # facts of more words have more keys; theirs are not counted
_PAIRS = 1 << 20  # pairs of keys that are looked at together
_KEYS = "struct<signature:long,keys:array<struct<hash:long,reach:int>>>"


def indexed_words(words: Column, frequent: list[str], floor: float) -> Column:
    """The words of a sorted set of which it shares one with every like set, in the order of all sets."""
    known = pa.array(frequent, pa.string())

    def prefixes(sets: pa.Array) -> pa.Array:
        sizes = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = sets.flatten()
        rank = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((rank, row))  # stable: unranked words keep the order of the set
        length = np.where(sizes > 0, sizes - np.ceil(floor * floor * sizes - _SLACK).astype(np.int64) + 1, 0)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = order[place < length[row]]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(kept)).cast(pa.string()))

    return F.arrow_udf(lambda sets: in_runs(prefixes, sets), "array<string>").asNondeterministic()(words)


def indexed(sets: DataFrame, frequent: list[str], floor: float) -> DataFrame:
    """``words`` sets with their size ``n`` and ``prefix``, words of which like sets share one."""
    return sets.where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn(
        "prefix", indexed_words(F.col("words"), frequent, floor)
    )


def _frequent_and_total(facts: DataFrame, most: int) -> tuple[list[int], int]:
    counts = facts.select(F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("hash")).groupBy("hash").count()
    seen = Observation()
    top = counts.observe(seen, F.sum("count").alias("words")).where("count > 1").orderBy(F.desc("count"), "hash")
    frequent = [r["hash"] for r in reversed(top.limit(most).select("hash").collect())] if most else []
    total = seen.get["words"] if most else counts.agg(F.sum("count")).first()[0]
    return frequent, total or 0


def frequent_words(facts: DataFrame, most: int = FREQUENT) -> list[int]:
    """Hashes of the most frequent words of ``words`` sets, most frequent last."""
    return _frequent_and_total(facts, most)[0]


def _mixed(first: np.ndarray, second: np.ndarray | int) -> np.ndarray:
    """One hash of two, which are in order."""
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (first.astype(np.uint64) >> np.uint64(29))
    return ((mixed + np.asarray(second).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)


def set_keys(sets: pa.Array, frequent: np.ndarray, floor: float) -> pa.Array:
    """Signature of every set of word hashes, and the keys by which it has to be found.

    ``reach`` is what two sets can share at most if they share the words of the key and none before.
    """
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    by_hash = np.argsort(frequent, kind="stable")
    rank = np.full(len(words), -1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent[by_hash], words), len(frequent) - 1)
        rank = np.where(frequent[by_hash][at] == words, by_hash[at], -1)
    order = np.lexsort((words, rank, row))
    words, rank = words[order], rank[order]
    place = np.arange(len(words)) - np.repeat(starts, sizes)
    needed = np.maximum(np.ceil(floor * floor * sizes - _SLACK).astype(np.int64), 1)
    first = sizes - needed + 1
    rare = np.bincount(row[rank < 0], minlength=len(sizes))

    def single(chosen: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = np.flatnonzero(chosen & (place < first[row]))
        return row[chosen], _mixed(words[chosen], kind), sizes[row[chosen]] - place[chosen]

    short, long = needed <= 1, sizes >= floor * floor * LONG - _SLACK
    found = [single(rank < 0, 0), single((rank >= 0) & short[row], 1), single((rank >= 0) & long[row], 2)]
    paired = np.where(sizes <= LONG, np.minimum(first + 1, sizes) - rare, 0)
    for k in np.unique(paired[paired > 1]):
        own = np.flatnonzero(paired == k)
        i, j = np.triu_indices(k, 1)
        taken = words[(starts[own] + rare[own])[:, None] + np.arange(k)]
        found.append((
            np.repeat(own, len(i)), _mixed(_mixed(taken[:, i], 3), taken[:, j]).ravel(),
            (sizes[own, None] - (rare[own, None] + j) + 1).ravel(),
        ))
    rows, hashes, reach = (np.concatenate(part) for part in zip(*found, strict=True))
    by_row = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))]).astype(np.int32)
    bits = np.left_shift(np.uint64(1), words.astype(np.uint64) & np.uint64(63))
    signature = np.bitwise_or.reduceat(bits, starts) if len(words) else np.zeros(0, np.uint64)
    keys = pa.StructArray.from_arrays(
        [pa.array(hashes[by_row]), pa.array(reach[by_row].astype(np.int32))], ["hash", "reach"]
    )
    return pa.StructArray.from_arrays(
        [pa.array(signature.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), keys)], ["signature", "keys"]
    )


def keyed(sets: DataFrame, frequent: list[int], floor: float) -> DataFrame:
    """``hash, id, n, signature, reach``: the keys of sets that have ``id, words``."""
    return _keys_of(sets.where(F.size("words") > 0), frequent, floor)


def _keys_of(sets: DataFrame, frequent: list[int], floor: float) -> DataFrame:
    known = np.array(frequent, np.int64)
    keys = F.arrow_udf(lambda s: in_runs(lambda run: set_keys(run, known, floor), s), _KEYS).asNondeterministic()
    found = sets.select(
        "id", F.size("words").alias("n"), keys(F.transform("words", lambda w: F.xxhash64(w))).alias("k")
    )
    return found.select("id", "n", "k.signature", F.explode("k.keys").alias("key")).select(
        "key.hash", "id", "n", "signature", "key.reach"
    )


def can_meet(words: Column, index: pa.Table, frequent: list[int], floor: float) -> Column:
    """Whether a set that is not empty meets one of the ``index`` within the bounds."""
    known = np.array(frequent, np.int64)
    hashes, n, signature, reach = (index[c].to_numpy() for c in ("hash", "n", "signature", "reach"))
    order = np.argsort(hashes, kind="stable")
    hashes, n, signature, reach = hashes[order], n[order], signature[order].view(np.uint64), reach[order]

    def met(sets: pa.Array) -> pa.Array:
        found = set_keys(sets, known, floor)
        keys, sizes = found.field("keys"), sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        mine = found.field("signature").to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.repeat(np.arange(len(sets)), keys.value_lengths().to_numpy(zero_copy_only=False))
        flat = keys.flatten()
        wanted, own_reach = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("hash", "reach"))
        left = np.searchsorted(hashes, wanted, "left")
        hits = np.searchsorted(hashes, wanted, "right") - left
        out = np.zeros(len(sets), bool)
        hit = np.flatnonzero(hits)
        for a, b in bounded(hits[hit].tolist(), _PAIRS, len(hit)):
            some = hit[a:b]
            some = some[~out[row[some]]]
            times = hits[some]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            fact, own = np.repeat(left[some], times) + within, np.repeat(some, times)
            of = row[own]
            shared = np.minimum(np.minimum(own_reach[own], reach[fact]), np.minimum(
                sizes[of] - np.bitwise_count(mine[of] & ~signature[fact]), n[fact] - np.bitwise_count(signature[fact] & ~mine[of])
            ))
            out[of[shared >= floor * np.sqrt((sizes[of] * n[fact]).astype(np.float64)) - _SLACK]] = True
        return pa.array(out)

    meets = F.arrow_udf(lambda sets: in_runs(met, sets), "boolean").asNondeterministic()
    return meets(F.transform(words, lambda w: F.xxhash64(w)))


def _lines(sets: DataFrame) -> DataFrame:
    """``id, line`` and the other columns: the words as one text (none holds a space), and its hash."""
    given = [c for c in sets.columns if c != "words"]
    lines = sets.where(F.size("words") > 0).select(*given, F.array_join("words", " ").alias("line"))
    return lines.select(*given, F.xxhash64("line").alias("id"), "line")


def _likely(sentences: DataFrame, facts: DataFrame, floor: float, most: int) -> tuple[DataFrame, list[int]]:
    """The ``words`` sets that can meet a fact, if the facts are few enough to tell, and the frequent words."""
    frequent, total = _frequent_and_total(facts, most)
    sentences = sentences.where(F.size("words") > 0)
    if total <= MOST_WORDS:
        known = facts.select("words").distinct().withColumn("id", F.lit(0).cast("long"))
        index = keyed(known, frequent, floor).select("hash", F.col("n").cast("long"), "signature", "reach")
        if index.count() <= MOST_KEYS:
            sentences = sentences.where(can_meet(F.col("words"), index.toArrow(), frequent, floor))
    return sentences, frequent


def similar_sets(sentences: DataFrame, facts: DataFrame, floor: float, most: int = FREQUENT) -> DataFrame:
    """``words, similarity, fact_id``: the best fact of every ``words`` set that has one.

    ``facts`` has ``fact_id, words``; equal similarities go to the smaller id.
    """
    likely, frequent = _likely(sentences.select("words"), facts, floor, most)
    best = _best_facts(_dealt(likely), facts, frequent, floor)
    return best.select(F.split("line", " ").alias("words"), "similarity", "fact_id")


def _dealt(sets: DataFrame) -> DataFrame:
    return _lines(sets).repartition("id")


def _best_facts(asked: DataFrame, facts: DataFrame, frequent: list[int], floor: float) -> DataFrame:
    """``id, line, similarity, fact_id`` of the ``id, line`` that have a fact among the ``fact_id, words``."""
    asked = asked.select("id", "line").distinct()
    known = _dealt(facts.select("fact_id", "words")).groupBy("id", "line").agg(F.min("fact_id").alias("fact_id"), F.count(F.lit(1)).alias("times"))
    # always true, but both uses of the facts read the same columns for it and share their shuffle
    known = known.where("fact_id is not null or times > 0")
    words = F.split("line", " ").alias("words")
    probes = _keys_of(asked.select("id", words), frequent, floor)
    index = _keys_of(known.select("id", words), frequent, floor)
    index = index.select("hash", *[F.col(c).alias(f"f_{c}") for c in ("id", "n", "signature", "reach")])
    mine, theirs = F.col("signature"), F.col("f_signature")
    most_shared = F.least(
        "reach", "f_reach",
        F.col("n") - F.bit_count(mine.bitwiseAND(F.bitwise_not(theirs))),
        F.col("f_n") - F.bit_count(theirs.bitwiseAND(F.bitwise_not(mine))),
    )
    least_shared = F.lit(floor) * F.sqrt((F.col("n") * F.col("f_n")).cast("double")) - F.lit(_SLACK)
    met = probes.join(index, "hash").where(most_shared >= least_shared).select("id", "f_id")
    met = met.repartition("f_id").distinct()
    facts_met = known.select(F.col("id").alias("f_id"), F.col("line").alias("f_line"), "fact_id")
    compared = met.join(facts_met, "f_id").join(asked, "id").select(
        "id", "line", "fact_id", F.split("line", " ").alias("words"), F.split("f_line", " ").alias("f_words")
    )
    shared = F.size(F.array_intersect("words", "f_words"))
    similarity = shared / F.sqrt((F.size("words") * F.size("f_words")).cast("double"))
    return (
        compared.select("id", "line", "fact_id", similarity.alias("similarity")).where(F.col("similarity") >= floor)
        .groupBy("id", "line").agg(F.max(F.struct("similarity", (-F.col("fact_id")).alias("back"))).alias("m"))
        .select("id", "line", "m.similarity", (-F.col("m.back")).alias("fact_id"))
    )


def match_with_knowledge(
    samples: DataFrame,
    facts: DataFrame,
    slot: Slot = Slot(),
    key: str = "sample_id",
    out: str = "claim_matches",
    floor: float = FactualSettings().textual_threshold,
    most_frequent: int = FREQUENT,
) -> DataFrame:
    """Add the best evidence per kept sentence: array<struct<similarity, position, fact_id>>.

    ``facts`` has fact_id, a unique long, and fact; ``key`` is unique. The row's own source comes
    first; a fact wins where it is more similar and reaches ``floor``, the smallest id among
    equal ones. ``position`` is null when the evidence is a fact. Facts without words, null ones
    included, are never evidence.
    """
    if not 0 < floor <= 1:
        raise ValueError("the floor has to be above 0 and at most 1")
    sets = facts.select(F.col("fact_id").cast("long"), F.array_sort(token_set(F.col("fact"))).alias("words"))
    asked = elements(with_shared(samples, slot), [F.col(f"`{key}`").alias("key")], slot.temp("sentence_tokens"), "tokens", "sentence")
    asked, frequent = _likely(asked.select("key", "sentence", F.array_sort("tokens").alias("words")), sets, floor, most_frequent)
    # always true as well; one without a random number would go below the shuffle, and its columns with it
    asked = _dealt(asked).where("if(rand(0) < 2, key is not null or sentence >= 0, false)")
    best = _best_facts(asked, sets, frequent, floor).groupBy("id").agg(
        F.collect_list(F.struct("line", "similarity", "fact_id")).alias("facts")
    )
    # by the hash alone, by which both sides lie already
    found = asked.join(best, "id").withColumn(
        "fact", F.get(F.filter("facts", lambda f: f["line"] == F.col("line")), F.lit(0))
    ).where("fact is not null")
    per_row = (
        found.groupBy("key")
        .agg(F.map_from_entries(F.collect_list(
            F.struct("sentence", F.struct("fact.similarity", "fact.fact_id"))
        )).alias("_from_facts"))
        .withColumnRenamed("key", "_key")
    )

    def better(mine: Column, i: Column) -> Column:
        fact = F.try_element_at("_from_facts", i)
        wins = F.coalesce(fact["similarity"] > mine["similarity"], F.lit(False))
        return F.struct(
            F.when(wins, fact["similarity"]).otherwise(mine["similarity"]).alias("similarity"),
            F.when(~wins, mine["position"]).cast("int").alias("position"),
            F.when(wins, fact["fact_id"]).cast("long").alias("fact_id"),
        )

    # the rows are joined as they are: behind a Python function Spark would deal them out anew
    joined = with_shared(samples.join(per_row, F.col(f"`{key}`") == F.col("_key"), "left"), slot)
    own = best_matches(
        F.col(slot.temp("sentence_tokens")), F.col(source_column(slot, "sentence_tokens"))
    )
    matched = joined.withColumn("_own", own).withColumn(out, F.transform("_own", better))
    return without_shared(matched, [*samples.columns, out])
