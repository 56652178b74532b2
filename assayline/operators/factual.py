"""Claims of the generated text, verified against the source.

A textual claim is verified by its most similar source sentence (or knowledge-base fact),
a numerical claim by the first source number within tolerance. Both stay in the row: the
work is per sample and nothing is shuffled.

The texts of flags, notes and errors are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_where, empty_array, let
from ..functions.lexical import text_matches
from ..functions.numbers import claims_of, extract_numbers, first_close_number
from ..functions.rounding import round_sql
from ..functions.text import excerpt
from ..schema import WARNING, flag, no_flags
from ..settings import FactualSettings, Slot
from .results import add_result
from .shared import missing_text, model_error, source_column, with_shared

NAME = "factual_accuracy"


def evidence_sentences(slot: Slot, settings: FactualSettings) -> Column:
    """Source sentences followed by the knowledge base, as the positions count them."""
    own = F.col(source_column(slot, "sentences"))
    if not settings.knowledge_base:
        return own
    return F.concat(own, F.array(*[F.lit(f) for f in settings.knowledge_base]))


def lexical_matches(slot: Slot, settings: FactualSettings) -> Column:
    """array<struct<similarity, position>>: the best evidence of each kept sentence."""
    return text_matches(
        F.col(slot.temp("sentences")),
        F.col(source_column(slot, "sentences")),
        settings.knowledge_base,
    )


def lexical_claims(
    df: DataFrame, slot: Slot, settings: FactualSettings
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with their sentences, and the columns that are computed in Python and not there yet."""
    df, name = with_shared(df, slot), slot.temp("matches")
    if name in df.columns or slot.claim_matches:
        return df, {}
    return df, {name: lexical_matches(slot, settings)}


def with_verified_claims(df: DataFrame, slot: Slot, settings: FactualSettings) -> DataFrame:
    """Add the array of verified claims of a slot, in text order."""
    df, matches = lexical_claims(df, slot, settings)
    if slot.claim_matches:
        matches = {slot.temp("matches"): F.col(slot.claim_matches)}
    if source_column(slot, "numbers") not in df.columns:  # slots that read the same source share it
        numbers = extract_numbers(F.col(source_column(slot, "text")))
        df = df.withColumn(source_column(slot, "numbers"), numbers)
    df = df.withColumns({slot.temp("claims"): claims_of(F.col(slot.temp("sentences"))), **matches})

    def verify(claim: Column, matches: Column, numbers: Column, evidence: Column) -> Column:
        textual = claim["type"] == "textual"
        match = F.get(matches, claim["sentence"])
        number = first_close_number(
            claim["value"], numbers, settings.numerical_tolerance, settings.signed,
            claim["negative"],
        )

        def result(n: Column) -> Column:
            supported = textual & (match["similarity"] >= F.lit(settings.textual_threshold))
            return F.struct(
                claim["text"].alias("text"),
                claim["type"].alias("type"),
                claim["value"].alias("value"),
                claim["unit"].alias("unit"),
                F.when(textual, supported).otherwise(n.isNotNull()).alias("verified"),
                F.when(textual, match["similarity"]).alias("similarity"),
                n["value"].alias("source_value"),
                F.when(supported, F.get(evidence, match["position"]))
                .when(~textual, n["match"])
                .alias("evidence"),
            )

        return let(F.when(~textual, number), result)

    verified = let(
        F.struct(
            F.col(slot.temp("matches")).alias("matches"),
            F.col(source_column(slot, "numbers")).alias("numbers"),
            evidence_sentences(slot, settings).alias("evidence"),
        ),
        lambda given: F.transform(
            F.col(slot.temp("claims")),
            lambda c: verify(c, given["matches"], given["numbers"], given["evidence"]),
        ),
    )
    return df.withColumn(slot.temp("verified_claims"), verified)


def evaluate_factual(
    df: DataFrame, slot: Slot = Slot(), settings: FactualSettings = FactualSettings()
) -> DataFrame:
    df = with_verified_claims(df, slot, settings)
    claims = F.col(slot.temp("verified_claims"))
    no_source = F.col(source_column(slot, "text")) == ""
    no_content = F.size(claims) == 0

    def of_type(kind: str, verified_only: bool = False) -> Column:
        return count_where(
            claims,
            lambda c: (c["type"] == kind) & c["verified"] if verified_only else c["type"] == kind,
        ).cast("double")

    verified = count_where(claims, lambda c: c["verified"])
    total = F.size(claims)

    def accuracy(kind: str) -> Column:
        return of_type(kind, True) / F.greatest(of_type(kind), F.lit(1.0))

    def unverified() -> Column:
        return F.filter(claims, lambda c: ~c["verified"])

    def category(c: Column) -> Column:
        return F.concat(F.lit("factual:"), c["type"])

    def claim_flag(c: Column) -> Column:
        message = F.concat(
            F.lit("Unverified "), c["type"], F.lit(' claim: "'), excerpt(c["text"]), F.lit('"')
        )
        return flag(category(c), message, WARNING, c["text"])

    def source_flag() -> Column:
        return flag("factual", "Cannot verify facts without a source document.", WARNING)

    def claim_results() -> Column:
        rounded = round_sql("c.similarity", 4)
        return F.expr(
            f"transform(`{slot.temp('verified_claims')}`, c -> named_struct('text', c.text, "
            "'type', c.type, 'value', c.value, 'unit', c.unit, 'verified', c.verified, "
            f"'similarity', {rounded}, 'source_value', c.source_value, 'evidence', c.evidence))"
        )

    return add_result(
        df,
        slot,
        NAME,
        score=F.when(no_source, F.lit(0.0))
        .when(no_content, F.lit(1.0))
        .otherwise(verified.cast("double") / total.cast("double")),
        error=F.when(~no_source, F.coalesce(missing_text(slot), model_error(slot))),
        sub_scores=lambda: {
            "textual_accuracy": accuracy("textual"),
            "numerical_accuracy": accuracy("numerical"),
        },
        has_sub_scores=~(no_source | no_content),
        passed=lambda: F.lit(True),
        categories=lambda: F.when(no_source, F.array(F.lit("factual")))
        .when(no_content, empty_array("string"))
        .otherwise(F.transform(unverified(), category)),
        flags=lambda: F.when(no_source, F.array(source_flag()))
        .when(no_content, no_flags())
        .otherwise(F.transform(unverified(), claim_flag)),
        details=lambda: F.struct(
            F.when(no_source, "No source / knowledge base provided.").alias("error"),
            F.when(~no_source & no_content, "No verifiable claims found.").alias("note"),
            total.alias("total_claims"),
            verified.alias("verified_claims"),
            (total - verified).alias("unverified_claims"),
            claim_results().alias("claim_results"),
        ),
        method=lambda: F.lit("model" if slot.claim_matches else "lexical"),
    )
