"""Column types shared by the evaluators and the tables they feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFO, WARNING, CRITICAL = "info", "warning", "critical"

SPAN_TYPE = "struct<start:int,end:int>"
FLAG_TYPE = (
    "struct<category:string,message:string,severity:string,"
    f"span:{SPAN_TYPE},evidence:string>"
)
SUB_SCORES_TYPE = "map<string,double>"


def flag(category: Column | str, message: Column | str, severity: Column | str,
         evidence: Column | None = None) -> Column:
    def col(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        col(category).alias("category"),
        col(message).alias("message"),
        col(severity).alias("severity"),
        F.lit(None).cast(SPAN_TYPE).alias("span"),
        (evidence if evidence is not None else F.lit(None).cast("string")).alias("evidence"),
    ).cast(FLAG_TYPE)


def no_flags() -> Column:
    return F.array().cast(f"array<{FLAG_TYPE}>")


def sub_scores(**scores: Column) -> Column:
    parts = []
    for name, value in scores.items():
        parts += [F.lit(name), value]
    return F.create_map(*parts)


def no_sub_scores() -> Column:
    return F.create_map().cast(SUB_SCORES_TYPE)
