"""Per-row intermediates that several evaluators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.lexical import token_set
from ..functions.text import kept_sentences, raw_sentences, split_sentences
from ..settings import Slot


def source_sentences(source: Column) -> Column:
    """Kept sentences of a source; the whole source when none is kept."""
    return let(
        split_sentences(source), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(source))
    )


def source_column(slot: Slot, name: str) -> str:
    return f"_{slot.source}__{name}"


def with_shared(df: DataFrame, slot: Slot) -> DataFrame:
    """Sentences and word sets, computed once per row and dropped by :func:`without_shared`.

    Unused ones are pruned. Slots that read the same source share its columns.
    """
    present = set(df.columns)
    if source_column(slot, "text") not in present:
        df = df.withColumn(source_column(slot, "text"), F.coalesce(F.col(slot.source), F.lit("")))
        text = F.col(source_column(slot, "text"))
        df = df.withColumns(
            {
                source_column(slot, "tokens"): token_set(text),
                source_column(slot, "sentences"): source_sentences(text),
            }
        )
        df = df.withColumn(
            source_column(slot, "sentence_tokens"),
            F.transform(source_column(slot, "sentences"), token_set),
        )
    if slot.temp("sentences") not in present:
        df = df.withColumn(slot.temp("pieces"), raw_sentences(F.col(slot.text)))
        df = df.withColumns(
            {
                slot.temp("sentences"): kept_sentences(F.col(slot.temp("pieces"))),
                slot.temp("n_pieces"): F.size(slot.temp("pieces")),
            }
        )
        df = df.withColumn(
            slot.temp("sentence_tokens"), F.transform(slot.temp("sentences"), token_set)
        )
    return df


def without_shared(df: DataFrame, given: list[str]) -> DataFrame:
    """Drop what scoring added for its own use; the caller's ``given`` columns stay."""
    own = set(given)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in own or not c.startswith("_")])


def missing_text(slot: Slot) -> Column:
    """The error of an evaluator that was given no text at all."""
    return F.when(F.col(slot.text).isNull(), F.lit("generated text is missing"))


def model_error(slot: Slot) -> Column:
    """Why a row has no model scores, if it should have some."""
    return F.col(slot.model_error) if slot.model_error else F.lit(None).cast("string")
