"""Personal-data patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import empty_array
from .text import spans, unicode_pattern

# Pattern per kind, in reporting order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_us": r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date_of_birth": r"\b(?:DOB|date of birth|born on)[:\s]*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
}
_IGNORE_CASE = {"date_of_birth"}

PII_TYPE = "struct<type:string,match:string,start:int,end:int>"


def pii_regex(kind: str) -> str:
    return unicode_pattern(PII_PATTERNS[kind], ignore_case=kind in _IGNORE_CASE)


def _possible(text: Column, kind: str) -> Column:
    """Cheap necessary condition, so most texts skip the pattern itself."""
    return text.contains("@") if kind == "email" else text.rlike(r"\p{Nd}")


def pii_matches(text: Column) -> Column:
    """array<struct<type, match>> of every match of every pattern."""

    def found(kind: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pii_regex(kind)), F.lit(0)),
            lambda m: F.struct(F.lit(kind).alias("type"), m.alias("match")),
        )

    nothing = empty_array("struct<type:string,match:string>")
    return F.concat(
        *[F.when(_possible(text, k), found(k)).otherwise(nothing) for k in PII_PATTERNS]
    )


def detect_pii(text: Column) -> Column:
    """Findings with character offsets, as an array of :data:`PII_TYPE`."""

    def located(kind: str) -> Column:
        regex = pii_regex(kind)
        return F.zip_with(
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
            spans(text, regex),
            lambda m, s: F.struct(
                F.lit(kind).alias("type"), m.alias("match"),
                s["start"].alias("start"), s["end"].alias("end"),
            ),
        )

    nothing = empty_array(PII_TYPE)
    return F.concat(
        *[F.when(_possible(text, k), located(k)).otherwise(nothing) for k in PII_PATTERNS]
    )


def redact_pii(text: Column) -> Column:
    """Replace every match by its kind in brackets, kinds in reporting order."""
    out = text
    for kind in PII_PATTERNS:
        out = F.regexp_replace(out, pii_regex(kind), f"[{kind}]")
    return out
