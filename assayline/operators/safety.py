"""Toxicity, brand rules, personal data and the content rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brand
from ..functions.expr import count_where
from ..functions.pii import pii_matches
from ..functions.rounding import format_fixed, round_entries
from ..functions.rules import rule_matches
from ..functions.text import excerpt
from ..schema import CRITICAL, WARNING, flag
from ..settings import SafetySettings, Slot
from .results import add_result
from .shared import missing_text

NAME = "content_safety"


def high_toxicity(toxicity: Column, threshold: float) -> Column:
    """Entries at or above the threshold, in the order of the map."""
    return F.map_entries(F.map_filter(toxicity, lambda _, v: v >= F.lit(threshold)))


def _word_rules(settings: SafetySettings) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return brand.terms_or_default(settings.forbidden_terms), brand.topics_or_default(settings.forbidden_topics)


def brand_matches(df: DataFrame, slot: Slot, settings: SafetySettings) -> tuple[DataFrame, dict[str, Column]]:
    """The rows, and the columns that are computed in Python and not there yet."""
    name = slot.temp("rule_matches")
    if name in df.columns:
        return df, {}
    terms, topics = _word_rules(settings)
    return df, {name: rule_matches(F.col(slot.text), (*terms, *topics))}


def evaluate_safety(
    df: DataFrame, slot: Slot = Slot(), settings: SafetySettings = SafetySettings()
) -> DataFrame:
    text, toxicity = F.col(slot.text), F.col(slot.toxicity)
    terms, topics = _word_rules(settings)
    competitors = tuple(settings.competitor_names)

    df, in_python = brand_matches(df, slot, settings)
    df = df.withColumns(
        {
            slot.temp("pii"): pii_matches(text),
            **in_python,
            slot.temp("competitors"): brand.count_competitors(text, competitors),
            slot.temp("high_toxicity"): high_toxicity(toxicity, settings.toxicity_threshold),
            slot.temp("max_toxicity"): brand.max_toxicity(toxicity),
        }
    )
    pii, matches = F.col(slot.temp("pii")), F.col(slot.temp("rule_matches"))
    n_terms = count_where(matches, lambda m: m["rule"] < len(terms))
    per_kind = {
        brand.TERM: n_terms,
        brand.TOPIC: F.size(matches) - n_terms,
        brand.COMPETITOR: F.col(slot.temp("competitors")),
    }
    n_brand = sum(per_kind.values(), F.lit(0))
    n_pii = F.size(pii)
    high, max_tox = F.col(slot.temp("high_toxicity")), F.col(slot.temp("max_toxicity"))
    pii_severity = CRITICAL if settings.pii_is_critical else WARNING

    def violations() -> Column:
        return F.concat(
            brand.word_violations(matches, brand.TERM, terms),
            brand.word_violations(matches, brand.TOPIC, topics, len(terms)),
            brand.competitor_violations(text, competitors),
        )

    def categories() -> Column:
        return F.concat(
            F.transform(high, lambda t: F.concat(F.lit("toxicity:"), t["key"])),
            *[F.array_repeat(F.lit(f"brand:{kind}"), n) for kind, n in per_kind.items()],
            F.transform(pii, lambda p: F.concat(F.lit("pii:"), p["type"])),
        )

    def toxicity_flag(t: Column) -> Column:
        message = F.concat(
            F.lit("High "), t["key"], F.lit(" score: "), format_fixed(t["value"], 3)
        )
        return flag(F.concat(F.lit("toxicity:"), t["key"]), message, CRITICAL)

    def brand_flag(v: Column) -> Column:
        return flag(F.concat(F.lit("brand:"), v["type"]), v["message"], WARNING)

    def pii_flag(p: Column) -> Column:
        message = F.concat(
            F.lit("PII detected ("), p["type"], F.lit("): "), excerpt(p["match"], 20)
        )
        return flag(F.concat(F.lit("pii:"), p["type"]), message, pii_severity)

    def flags() -> Column:
        return F.concat(
            F.transform(high, toxicity_flag),
            F.transform(violations(), brand_flag),
            F.transform(pii, pii_flag),
        )

    def details() -> Column:
        return F.struct(
            brand.content_rating(max_tox, n_brand + n_pii).alias("content_rating"),
            round_entries(slot.toxicity, 4).alias("toxicity_scores"),
            F.transform(violations(), lambda v: v.dropFields("message")).alias("brand_violations"),
            pii.alias("pii_findings"),
            n_pii.alias("pii_count"),
        )

    brand_score, pii_score = brand.brand_score(n_brand), brand.pii_score(n_pii)
    clean_of_pii = n_pii == 0 if settings.pii_is_critical else F.lit(True)
    return add_result(
        df,
        slot,
        NAME,
        score=(F.lit(1.0) - max_tox + brand_score + pii_score) / F.lit(3.0),
        error=F.coalesce(
            missing_text(slot),
            F.when(toxicity.isNull(), F.lit("toxicity scores are missing")),
        ),
        sub_scores=lambda: {
            "toxicity": F.lit(1.0) - max_tox,
            "brand_alignment": brand_score,
            "pii_safety": pii_score,
        },
        passed=lambda: (F.size(high) == 0) & clean_of_pii,
        categories=categories,
        flags=flags,
        details=details,
        method=lambda: F.lit("rules"),
    )
