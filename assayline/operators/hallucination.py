"""Grounding of each generated sentence in the source.

Every sentence carries three entailment probabilities and a cosine similarity with the
whole source. Both come from model columns of the slot, or from the lexical stand-ins.

The texts of flags, notes and errors are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import array_mean, count_where, empty_array
from ..functions.lexical import text_grounding
from ..functions.rounding import round_sql
from ..functions.text import excerpt
from ..schema import CRITICAL, WARNING, flag, no_flags
from ..settings import HallucinationSettings, Slot
from .results import add_result
from .shared import missing_text, model_error, source_column, with_shared

NAME = "hallucination"


def nli_label(contradiction: Column, entailment: Column, neutral: Column) -> Column:
    """Label of the largest probability; on a tie the order is that of the arguments."""
    top = F.greatest(contradiction, entailment, neutral)
    return (
        F.when(contradiction == top, "contradiction")
        .when(entailment == top, "entailment")
        .otherwise("neutral")
    )


def _scored_sentences(slot: Slot) -> Column:
    sentences = F.col(slot.temp("sentences"))

    def entry(s: Column, con: Column, ent: Column, neu: Column, sim: Column) -> Column:
        return F.struct(
            s.alias("sentence"),
            nli_label(con, ent, neu).alias("nli_label"),
            ent.alias("entailment_prob"),
            con.alias("contradiction_prob"),
            sim.alias("similarity"),
        )

    grounding = F.col(slot.temp("lexical_grounding"))
    if slot.nli is None:
        return F.zip_with(
            sentences,
            grounding,
            lambda s, g: entry(
                s, F.lit(0.0), g["containment"], F.lit(1.0) - g["containment"], g["cosine"]
            ),
        )
    similarity = (
        F.col(slot.similarity)
        if slot.similarity is not None
        else F.transform(grounding, lambda g: g["cosine"])
    )
    return F.zip_with(
        sentences,
        F.arrays_zip(F.col(slot.nli).alias("nli"), similarity.alias("sim")),
        lambda s, m: entry(
            s, m["nli"]["contradiction"], m["nli"]["entailment"], m["nli"]["neutral"], m["sim"]
        ),
    )


def lexical_grounding(
    df: DataFrame, slot: Slot, settings: HallucinationSettings
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their sentences, and the columns that are computed in Python and not there yet."""
    df, name = with_shared(df, slot), slot.temp("lexical_grounding")
    if name in df.columns or not (slot.nli is None or slot.similarity is None):
        return df, {}
    return df, {
        name: text_grounding(F.col(slot.temp("sentences")), F.col(source_column(slot, "text")))
    }


def evaluate_hallucination(
    df: DataFrame, slot: Slot = Slot(), settings: HallucinationSettings = HallucinationSettings()
) -> DataFrame:
    df, grounding = lexical_grounding(df, slot, settings)
    df = df.withColumns(grounding) if grounding else df
    df = df.withColumn(slot.temp("grounding"), _scored_sentences(slot))
    scored = F.col(slot.temp("grounding"))
    df = df.withColumns(
        {
            slot.temp("entailment"): array_mean(F.transform(scored, lambda r: r["entailment_prob"])),
            slot.temp("similarity"): array_mean(F.transform(scored, lambda r: r["similarity"])),
        }
    )
    entailment, similarity = F.col(slot.temp("entailment")), F.col(slot.temp("similarity"))
    no_source = F.col(source_column(slot, "text")) == ""
    no_content = F.size(scored) == 0

    def contradicts(r: Column) -> Column:
        return r["nli_label"] == "contradiction"

    def unsupported(r: Column) -> Column:
        return (r["entailment_prob"] < F.lit(settings.entailment_floor)) & (
            r["similarity"] < F.lit(settings.similarity_floor)
        )

    def flagged() -> Column:
        return F.filter(scored, lambda r: contradicts(r) | unsupported(r))

    def category(r: Column) -> Column:
        return F.when(contradicts(r), "hallucination:contradiction").otherwise(
            "hallucination:unsupported"
        )

    def sentence_flag(r: Column) -> Column:
        opening = F.when(contradicts(r), "Sentence contradicts source").otherwise(
            "Sentence appears unsupported by source"
        )
        return flag(
            category(r),
            F.concat(opening, F.lit(': "'), excerpt(r["sentence"]), F.lit('"')),
            F.when(contradicts(r), CRITICAL).otherwise(WARNING),
            r["sentence"],
        )

    def source_flag() -> Column:
        return flag(
            "hallucination", "Cannot assess hallucination without source document.", WARNING
        )

    composite = (
        F.lit(settings.entailment_weight) * entailment
        + F.lit(settings.similarity_weight) * similarity
    )
    def sentence_results() -> Column:
        rounded = ", ".join(
            f"'{field}', {round_sql(f'r.{field}', 4)}"
            for field in ("entailment_prob", "contradiction_prob", "similarity")
        )
        return F.expr(
            f"transform(`{slot.temp('grounding')}`, r -> named_struct("
            f"'sentence', r.sentence, 'nli_label', r.nli_label, {rounded}))"
        )

    return add_result(
        df,
        slot,
        NAME,
        score=F.when(no_source, F.lit(0.0)).when(no_content, F.lit(1.0)).otherwise(composite),
        error=F.when(~no_source, F.coalesce(missing_text(slot), model_error(slot))),
        sub_scores=lambda: {"entailment": entailment, "semantic_similarity": similarity},
        has_sub_scores=~(no_source | no_content),
        passed=lambda: no_source | ~F.exists(scored, contradicts),
        categories=lambda: F.when(no_source, F.array(F.lit("hallucination")))
        .when(no_content, empty_array("string"))
        .otherwise(F.transform(flagged(), category)),
        flags=lambda: F.when(no_source, F.array(source_flag()))
        .when(no_content, no_flags())
        .otherwise(F.transform(flagged(), sentence_flag)),
        details=lambda: F.struct(
            F.when(no_source, "No source document provided for grounding.").alias("error"),
            F.when(~no_source & no_content, "No scoreable sentences in generated text.").alias("note"),
            F.size(scored).alias("num_sentences"),
            count_where(scored, contradicts).alias("num_contradictions"),
            count_where(scored, unsupported).alias("num_unsupported"),
            sentence_results().alias("sentence_results"),
        ),
        method=lambda: F.lit("model" if slot.nli else "lexical"),
    )
