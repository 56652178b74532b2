"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are runs of characters other than ASCII space, punctuation and control characters,
lower-cased and hashed. A seed is a fixed mask over word positions: the words at its ones
are hashed together, the others are ignored. Test and training seeds of equal hash are
joined; along the diagonal of each hit the windows of ``WINDOW`` words around it are compared
word by word, and a window with at least 80 % equal words makes the document contaminated.
Every window with up to two substituted words is met by a seed of ``MASKS`` (tested).

The benchmark is cut into pieces of bounded length and taken in blocks of a bounded number
of seeds, one after the other; only a block is broadcast, so its size has a bound for any
benchmark. A piece that several items share is compared once. The corpus is not shuffled: seeds
are made, probed and verified in one stage, and only verified hits are grouped. A hit takes along
the few words that its windows can hold, for Spark keeps all hits of a document until the last is found.

Items shorter than the window are compared whole. An item of fewer than ``EXACT_WORDS`` words has
no room for substitutions: it is met by a mask of all of its words, where they follow each
other exactly, so an item of one word meets every document with that word. Null and empty texts
are never contaminated. Repeated items and documents give the same result each. Columns
other than ids and texts are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.shared import cut, row_key

# One is a word that is compared, zero a word that is ignored.
MASKS = ("1001111", "11001101", "11100011")
WINDOW = 13
PERCENT = 80
EXACT_WORDS = 8
PIECE_WORDS = 4096
BLOCK_SEEDS = 1_000_000
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """Array with the hash of every mask that starts at word ``at`` (null: beyond the end)."""
    return F.array(*(
        F.when(
            at + len(mask) <= F.size(words),
            F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1")),
        )
        for mask in masks
    ))


def short_masks(known: DataFrame) -> tuple[str, ...]:
    """A mask of ones for each length that a short item has: fewer than ``EXACT_WORDS``."""
    lengths = known.where(F.size("item") < EXACT_WORDS).select(F.size("item").alias("n")).distinct().collect()
    return tuple("1" * n for n in sorted(r["n"] for r in lengths))


def item_seeds(masks: tuple[str, ...]) -> Column:
    """The seeds of an item at word ``j``: masks with gaps, or the whole item if it is short."""
    item, at = F.col("item"), F.col("j")
    short = [m for m in masks if "0" not in m]
    whole = F.filter(
        F.array(*(F.when((F.size(item) == len(m)) & (at == 0), F.get(seeds(item, at, (m,)), F.lit(0))) for m in short)),
        lambda x: x.isNotNull(),
    ) if short else F.array().cast("array<long>")
    return F.when(F.size(item) < EXACT_WORDS, whole).otherwise(seeds(item, at, tuple(m for m in masks if "0" in m)))


def pieces(benchmark: DataFrame) -> DataFrame:
    """``item_id, piece, item``: hashed words in overlapping pieces of bounded length, and a hash of them."""
    hashed = benchmark.select("item_id", word_hashes("text").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(PIECE_WORDS))
    return hashed.select("item_id", "words", F.explode(starts).alias("start")).select(
        "item_id", F.slice("words", F.col("start") + 1, F.lit(PIECE_WORDS + WINDOW - 1)).alias("item"),
    ).distinct().withColumn("piece", F.xxhash64("item"))


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, block: int = BLOCK_SEEDS) -> DataFrame:
    """``d, h, item_id, matched``: verified overlaps; ``matched`` is the best share of equal words."""
    owned = pieces(benchmark)
    known = owned.select("piece", "item").distinct()
    total = known.agg(F.sum(F.size("item"))).first()[0] or 0
    blocks = max(1, -(-total * len(masks) // block))
    masks = (*masks, *short_masks(known))
    d, h = row_key()
    corpus = docs.select(d.alias("d"), h.alias("h"), word_hashes("text").alias("words"))
    placed = corpus.select("d", "h", "words", F.posexplode("words").alias("i", "word")).select(
        "d", "h", "words", "i", F.explode(seeds(F.col("words"), F.col("i"), masks)).alias("seed")
    )
    found = [
        _verified(_hits(placed, known.where(F.pmod("piece", F.lit(blocks)) == b), masks))
        .groupBy("d", "h", "piece").agg(F.max("matched").alias("matched"))
        for b in range(blocks)
    ]
    # in one plan all blocks would be broadcast before the first is probed
    found = reduce(DataFrame.union, (cut(part) for part in found) if blocks > 1 else found)
    owners = owned.select("piece", "item_id")
    owners = F.broadcast(owners) if owners.count() <= block else owners
    return found.join(owners, "piece").groupBy("d", "h", "item_id").agg(F.max("matched").alias("matched"))


def _hits(placed: DataFrame, known: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``d, h, piece, near``: the windows around every hit.

    ``near`` has the words of the item (``theirs``) and of the document (``mine``) in all ``windows`` of ``window``
    words; the first ``missing`` words lie before the document.
    """
    tests = known.select("piece", "item", F.posexplode("item").alias("j", "word")).select(
        "piece", "j", F.explode(item_seeds(masks)).alias("seed")
    ).where("seed is not null").distinct()
    # both sides that are broadcast hold one block, which is bounded
    hits = placed.where("seed is not null").join(F.broadcast(tests), "seed").join(F.broadcast(known), "piece")
    window = F.least(F.size("item"), F.lit(WINDOW))
    low = F.greatest(F.lit(0), F.col("j") - window + 1)
    high = F.least(F.col("j"), F.size("item") - window)
    length, begin = high - low + window, F.col("i") - F.col("j") + low
    missing = F.greatest(F.lit(0), -begin)
    near = F.struct(
        window.alias("window"), (high - low + 1).alias("windows"), missing.alias("missing"),
        F.slice("item", low + 1, length).alias("theirs"),
        F.slice("words", begin + missing + 1, length - missing).alias("mine"),
    )
    # a generator, which no projection or filter above is merged with: only its rows leave the stage of the joins
    return hits.select("d", "h", "piece", F.explode(F.array(near)).alias("near"))


def _verified(hits: DataFrame) -> DataFrame:
    """``d, h, piece, matched``: the hits with a window of enough equal words."""
    equal = F.transform(
        "near.theirs", lambda word, t: (word == F.get("near.mine", t - F.col("near.missing"))).cast("int")
    )
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.col("near.windows")),
        lambda s: F.aggregate(F.slice("equal", s, F.col("near.window")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))),
    ))
    return (
        hits.withColumn("equal", equal)
        .select("d", "h", "piece", (100 * best / F.col("near.window")).alias("matched"))
        .where(F.col("matched") >= PERCENT)
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, matched`` of every row."""
    found = overlaps(docs, benchmark).groupBy("d", "h").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("matched").alias("matched")
    )
    d, h = row_key()
    return docs.select("doc_id", d.alias("d"), h.alias("h")).join(found, ["d", "h"], "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "matched",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with their columns."""
    found = overlaps(docs, benchmark).select("d", "h").distinct()
    d, h = row_key()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), d.alias("d"), h.alias("h"))
    return keyed.join(found, ["d", "h"], "left_anti").select("row.*")
