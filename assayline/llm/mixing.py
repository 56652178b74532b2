"""Mixing sources to target weights with DataFrame functions only.

Sizes are summed per source, targets are found from the sums, and a document of a source
with rate ``target / size`` is taken ``floor(rate)`` times plus once more by a Bernoulli draw
whose probability is the fraction. The draw is a hash of a seed, the id and the text, so a rerun
takes the same. Where few long documents hold most of a source's words, independent draws
miss the target by 10 % and more, so every source uses that one of ``SEEDS`` seeds whose
documents come nearest to its target: all sums are found in one aggregation.

Sources in code point order, null last, get the given weights in turn. A source stops at
``most`` times its size; what is above goes to the others by weight until none is above.
That is the level ``x`` with sum(min(most * size, weight * x)) = sum(size), found from
running sums over the table of sources (one row per source; the documents are only summed,
with partial sums, and joined). Texts are read once for the plan, which is then worked out on
a narrow checkpoint of ids, sources, sizes and hashes.

Null texts have size 0. A source of size 0 has target 0 and its documents are taken 0 times.
Repeated rows are decided alike and each count. ``repeat`` keeps the columns of the input; a
column ``copy`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.shared import cut

WEIGHTS = (5, 2, 1)
MOST = 3
SEEDS = 32
FEW = 100_000  # sources that may be broadcast, of some 50 bytes each
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From ``source, source_size`` to ``source, source_size, target``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    table = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long")
    ).withColumn("cap", F.col("source_size") * most)
    # sources with the smallest cap for their weight are full first
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    table = table.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    full = F.col("cap") / F.col("weight") < F.col("level")
    # the level rises up to the first source that isn't full, and falls after it
    table = table.withColumn("rest", F.max("level").over(every))
    return table.select(
        "source",
        "source_size",
        F.when(full, F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("rest")))
        .alias("target"),
    )


def named(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The name of a document in its draws: its id and a hash of its text."""
    return F.md5(F.concat_ws(
        ":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))
    ))


def draws(name: Column, seed: str, count: int = SEEDS) -> list[Column]:
    """Numbers in [0, 1) for each of ``count`` seeds: 32 bits each of salted hashes of a name."""
    salted = [F.md5(F.concat(F.lit(f"{seed}:{i}:"), name)) for i in range(-(-count // 4))]
    return [
        F.conv(F.substring(salted[i // 4], 8 * (i % 4) + 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
        for i in range(count)
    ]


def plan(narrow: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """``s, source_size, target, rate, use``: for each source its rate and the seed it uses."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = targets(sizes, weights, most).withColumn("rate", rate).withColumnRenamed("source", "s")
    rows = narrow.join(_sized(goals), F.col("source").eqNullSafe(F.col("s")))
    fraction = F.col("rate") - F.floor("rate")
    more = [F.sum(F.when(draw < fraction, F.col("size")).otherwise(F.lit(0))) for draw in draws(F.col("name"), seed)]
    near = rows.groupBy("s", "source_size", "target", "rate").agg(F.array(*more).alias("more"))
    miss = F.transform(
        "more", lambda x: F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")),
    )
    return near.withColumn("miss", miss).select(
        "s", "source_size", "target", "rate",
        (F.array_position("miss", F.array_min("miss")) - 1).cast("int").alias("use"),
    )


def _sized(goals: DataFrame) -> DataFrame:
    """The table of sources, broadcast if it has at most ``FEW`` rows, else joined by sorting."""
    goals = cut(goals)
    return F.broadcast(goals) if goals.count() <= FEW else goals


def _taken(rows: DataFrame, goals: DataFrame, seed: str) -> DataFrame:
    """Rows with ``source, name`` and what their source's plan gives them: ``copies``."""
    draw = F.get(F.array(*draws(F.col("name"), seed)), F.col("use"))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    return rows.join(_sized(goals), F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies.cast("long"))


def _narrow(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", words().alias("size"), named().alias("name")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row."""
    narrow = _narrow(docs)
    return _taken(narrow, plan(narrow, weights, most, seed), seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, ``copy`` from 0."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*kept).alias("row"), "source", named().alias("name"))
    taken = _taken(rows, plan(_narrow(docs), weights, most, seed), seed).where("copies > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
