"""Settings from a configuration mapping or file."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import brand
from ..settings import (
    BUILT_IN,
    FactualSettings,
    HallucinationSettings,
    QualitySettings,
    SafetySettings,
    Settings,
)

# Configuration keys whose name differs from the setting they fill.
_RENAMED = {
    "contradiction_threshold": "entailment_floor",
    "similarity_threshold": "similarity_floor",
}
_TYPES = {
    "hallucination": HallucinationSettings,
    "factual_accuracy": FactualSettings,
    "content_safety": SafetySettings,
    "quality": QualitySettings,
}


def settings_from_config(config: Mapping[str, Any] | None) -> Settings:
    """Settings of a parsed configuration; keys that no evaluator reads are ignored."""
    evaluators = dict((config or {}).get("evaluators") or {})
    built = {}
    for name, kind in _TYPES.items():
        given = {_RENAMED.get(k, k): v for k, v in (evaluators.pop(name, None) or {}).items()}
        known = {
            k: tuple(v or ()) if isinstance(kind.__dataclass_fields__[k].default, tuple) else v
            for k, v in given.items()
            if k in kind.__dataclass_fields__
        }
        built[name] = kind(**known)
    return Settings(**built, custom=evaluators)


def load_settings(path: str, missing_ok: bool = False) -> Settings:
    """Settings of a YAML or JSON file; with ``missing_ok`` a file that isn't there gives defaults.

    A file that is there but cannot be read or parsed is an error. Without a YAML library
    only JSON can be parsed.
    """
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except FileNotFoundError:
        if missing_ok:
            return Settings()
        raise
    try:
        import yaml
    except ImportError:
        return settings_from_config(json.loads(text))
    return settings_from_config(yaml.safe_load(text))


def settings_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(evaluator, enabled), one row per evaluator."""
    names = [*BUILT_IN, *settings.custom]
    return spark.createDataFrame(
        [(n, settings.is_enabled(n)) for n in names], "evaluator string, enabled boolean"
    )


def rules_of(settings: Settings) -> list[tuple[str, str]]:
    """(kind, value) of every brand rule in force, defaults filled in."""
    safety = settings.content_safety
    lists = {
        brand.TERM: brand.terms_or_default(safety.forbidden_terms),
        brand.TOPIC: brand.topics_or_default(safety.forbidden_topics),
        brand.COMPETITOR: safety.competitor_names,
    }
    return [(kind, value) for kind, values in lists.items() for value in values]


def rules_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(rule_id, kind, value) of every brand rule in force."""
    rows = [(i, kind, value) for i, (kind, value) in enumerate(rules_of(settings))]
    return spark.createDataFrame(rows, "rule_id int, kind string, value string")
