"""Brand rules: forbidden terms, forbidden topics, competitor names.

The rules are configuration, held as one array literal, so the plan stays the same size for ten
rules or ten thousand. Terms and topics are whole words: all of them are found in one pass
over a text (see ``functions.rules``). Competitor names are substrings.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import empty_array, let
from .rules import count_by_rule, rule_matches

# The rules used when a configured list is missing or empty.
DEFAULT_FORBIDDEN_TERMS = (
    "kill", "murder", "massacre", "slaughter",
    "porn", "xxx", "nude",
    "cocaine", "heroin", "meth",
)
DEFAULT_FORBIDDEN_TOPICS = ("politics", "religion", "gambling", "weapons")

TERM, TOPIC, COMPETITOR = "forbidden_term", "forbidden_topic", "competitor_mention"
_NAME_KEY = {TERM: "term", TOPIC: "topic", COMPETITOR: "name"}

_RULE_TYPE = "array<struct<value:string,needle:string,label:string>>"
VIOLATION_TYPE = "struct<type:string,value:string,start:int,end:int,message:string>"


def terms_or_default(terms: Sequence[str] | None) -> tuple[str, ...]:
    return tuple(terms or DEFAULT_FORBIDDEN_TERMS)


def topics_or_default(topics: Sequence[str] | None) -> tuple[str, ...]:
    return tuple(topics or DEFAULT_FORBIDDEN_TOPICS)


def _rule_array(kind: str, values: Sequence[str]) -> Column:
    rules = [
        {
            "value": v,
            "needle": v.lower(),
            "label": f"{{'type': '{kind}', '{_NAME_KEY[kind]}': {v!r}",
        }
        for v in values
    ]
    return F.from_json(F.lit(json.dumps(rules)), _RULE_TYPE)


def _named(text: Column, names: Sequence[str]) -> Column:
    """The competitors whose name occurs in a text."""
    return let(
        F.lower(text),
        lambda h: F.filter(_rule_array(COMPETITOR, names), lambda r: F.contains(h, r["needle"])),
    )


def count_word_rules(text: Column, kind: str, values: Sequence[str]) -> Column:
    """Whole-word occurrences of all rules together."""
    return F.size(rule_matches(text, values)) if values else F.lit(0)


def count_competitors(text: Column, names: Sequence[str]) -> Column:
    """Competitors named at least once, as a case-folded substring."""
    if not names:
        return F.lit(0)
    return F.size(_named(text, names))


def word_violations(matches: Column, kind: str, values: Sequence[str], first: int = 0) -> Column:
    """One entry per match of the rules ``values``, which count from ``first``, in rule order."""
    if not values:
        return empty_array(VIOLATION_TYPE)

    def violation(rules: Column, m: Column) -> Column:
        r = F.get(rules, m["rule"] - first)
        return F.struct(
            F.lit(kind).alias("type"),
            r["value"].alias("value"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.concat(
                F.lit("Brand violation: "), r["label"], F.lit(", 'span': ("),
                m["start"].cast("string"), F.lit(", "), m["end"].cast("string"), F.lit(")}"),
            ).alias("message"),
        )

    own = F.filter(matches, lambda m: m["rule"].between(first, first + len(values) - 1))
    return let(_rule_array(kind, values), lambda rules: F.transform(own, lambda m: violation(rules, m)))


def competitor_violations(text: Column, names: Sequence[str]) -> Column:
    if not names:
        return empty_array(VIOLATION_TYPE)
    return F.transform(
        _named(text, names),
        lambda r: F.struct(
            F.lit(COMPETITOR).alias("type"),
            r["value"].alias("value"),
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
            F.concat(F.lit("Brand violation: "), r["label"], F.lit("}")).alias("message"),
        ),
    )


def violations_by_rule(text: Column, kind: str, values: Sequence[str]) -> Column:
    """array<struct<value, hits>> for the rules that hit the text."""
    if kind == COMPETITOR:
        return F.transform(
            _named(text, values),
            lambda r: F.struct(r["value"].alias("value"), F.lit(1).cast("long").alias("hits")),
        )
    if not values:
        return empty_array("struct<value:string,hits:bigint>")
    rules = _rule_array(kind, values)
    return F.transform(
        count_by_rule(rule_matches(text, values)),
        lambda c: F.struct(F.get(rules, c["rule"])["value"].alias("value"), c["hits"].alias("hits")),
    )


def brand_score(violations: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.1) * violations)


def pii_score(findings: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.2) * findings)


def max_toxicity(toxicity: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(toxicity)), F.lit(0.0))


def content_rating(max_tox: Column, issues: Column) -> Column:
    return (
        F.when((max_tox < F.lit(0.1)) & (issues == 0), "G")
        .when((max_tox < F.lit(0.3)) & (issues <= 1), "PG")
        .when((max_tox < F.lit(0.6)) & (issues <= 3), "PG-13")
        .otherwise("R")
    )


__all__ = [
    "brand_score", "competitor_violations", "content_rating", "count_competitors",
    "count_word_rules", "max_toxicity", "pii_score",
    "terms_or_default", "topics_or_default", "violations_by_rule", "word_violations",
]
