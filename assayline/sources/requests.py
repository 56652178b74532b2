"""Gate requests as JSON text: validation, defaults and quarantine.

The rows are checked as VARIANT values, so one bad field never hides the others and a row
that is not JSON at all is reported the same way as one that lacks a field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import empty_array
from ..plans.decision import DEFAULT_MIN_SCORE

# Defaults of optional request fields.
DEFAULT_SUITE = "default-quality-gate"
DEFAULT_TASK = "summary"
DEFAULT_MODEL_ID = "default"
VERSION_FIELDS = (
    "suite_version", "prompt_version", "agent_version", "model_version",
    "evaluator_version", "app_version", "commit_sha",
)

_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
_OBJECT = r"^OBJECT<"


class _Reader:
    """Typed access to one VARIANT column; collects the errors of what it reads."""

    def __init__(self, value: Column):
        self.value = value
        self.errors: list[Column] = []

    def _at(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(self._at(path))

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "string")

    def present(self, path: str) -> Column:
        return self._at(path).isNotNull()

    def given(self, path: str) -> Column:
        return self.present(path) & (self.kind(path) != "VOID")

    def check(self, failed: Column, path: str, problem: str) -> None:
        self.errors.append(F.when(failed, F.lit(f"{path}: {problem}")))

    def require(self, path: str, when: Column | None = None) -> None:
        absent = ~self.present(path)
        self.check(absent if when is None else when & absent, path, "field required")

    def be(self, path: str, pattern: str, problem: str, nullable: bool = False) -> None:
        wrong = self.present(path) & ~self.kind(path).rlike(pattern)
        if nullable:
            wrong = wrong & (self.kind(path) != "VOID")
        self.check(wrong, path, problem)

    def string(self, path: str, default: str | None = None, nullable: bool = False) -> Column:
        self.be(path, "^STRING$", "must be a string", nullable)
        return self.text(path) if default is None else F.coalesce(self.text(path), F.lit(default))

    def json(self, path: str) -> Column:
        return F.when(self.given(path), F.to_json(self._at(path)))

    def all_errors(self) -> Column:
        return F.filter(F.array(*self.errors), lambda e: e.isNotNull())


def parse_requests(df: DataFrame, json_column: str = "value") -> DataFrame:
    """Add the request fields, with defaults, and ``errors`` (empty for a valid request)."""
    parsed = df.withColumn("_request", F.try_parse_json(json_column))
    r = _Reader(F.col("_request"))
    r.check(F.col("_request").isNull(), "request", "not valid JSON")
    is_object = F.schema_of_variant("_request").rlike(_OBJECT)
    r.check(F.col("_request").isNotNull() & ~is_object, "request", "must be an object")
    for path in ("input", "candidate"):
        r.be(path, _OBJECT, "must be an object")
    for path in ("input.prompt", "candidate.output"):
        r.require(path)
    for path in ("baseline", "reference", "metadata", "version_metadata"):
        r.be(path, _OBJECT, "must be an object", nullable=True)
    r.be("thresholds", _OBJECT, "must be an object")
    has_baseline = r.given("baseline")
    r.require("baseline.output", when=has_baseline)

    numeric = r.kind("thresholds.min_score").rlike(_NUMERIC)
    min_score = F.try_variant_get(F.col("_request"), "$.thresholds.min_score", "double")
    min_score = F.coalesce(min_score, r.text("thresholds.min_score").try_cast("double"))
    r.check(
        r.present("thresholds.min_score")
        & ~(numeric | ((r.kind("thresholds.min_score") == "STRING") & min_score.isNotNull())),
        "thresholds.min_score",
        "must be a number",
    )
    r.be("thresholds.block_on_flags", r"^ARRAY<(STRING|VOID)>$", "must be a list of strings")
    keep = F.lower(r.text("store_full_payloads"))
    truthy, falsy = ("true", "1", "t", "yes", "y", "on"), ("false", "0", "f", "no", "n", "off")
    r.check(
        r.present("store_full_payloads") & ~F.coalesce(keep.isin(*truthy, *falsy), F.lit(False)),
        "store_full_payloads",
        "must be a boolean",
    )
    r.be("reference.rubric", _OBJECT, "must be an object", nullable=True)

    fields = {
        "suite_id": r.string("suite_id", DEFAULT_SUITE),
        "task_type": r.string("task_type", DEFAULT_TASK),
        "prompt": r.string("input.prompt"),
        "source": r.string("input.source", ""),
        "candidate_id": r.string("candidate.id", DEFAULT_MODEL_ID),
        "candidate": r.string("candidate.output"),
        "baseline_id": F.when(has_baseline, r.string("baseline.id", DEFAULT_MODEL_ID)),
        "baseline": F.when(has_baseline, r.string("baseline.output")),
        "gold_output": r.string("reference.gold_output", nullable=True),
        "rubric": r.json("reference.rubric"),
        "min_score": F.coalesce(min_score, F.lit(DEFAULT_MIN_SCORE)),
        "block_on_flags": F.coalesce(
            F.try_variant_get(
                F.col("_request"), "$.thresholds.block_on_flags", "array<string>"
            ),
            empty_array("string"),
        ),
        "metadata": F.when(r.present("metadata"), r.json("metadata")).otherwise(F.lit("{}")),
        "version_metadata": F.struct(
            *[r.string(f"version_metadata.{f}", nullable=True).alias(f) for f in VERSION_FIELDS]
        ),
        "store_full_payloads": F.coalesce(keep.isin(*truthy), F.lit(False)),
    }
    return parsed.withColumns({**fields, "errors": r.all_errors()}).drop("_request")


def valid_requests(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("errors") == 0).drop("errors")


def quarantined_requests(parsed: DataFrame, json_column: str = "value") -> DataFrame:
    """The rejected rows as they came, with every reason."""
    return parsed.filter(F.size("errors") > 0).select(json_column, "errors")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON lines."""
    return parse_requests(spark.read.text(path))


def with_run_id(df: DataFrame, batch: str, *keys: str) -> DataFrame:
    """A run id that a recomputed task produces again, unlike a random one."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(batch), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn("run_id", digest)
