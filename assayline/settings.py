"""Settings of the evaluators and of the gate."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class HallucinationSettings:
    enabled: bool = True
    entailment_weight: float = 0.6
    similarity_weight: float = 0.4
    # Configured as "contradiction_threshold", but compared with the entailment probability.
    entailment_floor: float = 0.3
    similarity_floor: float = 0.5


@dataclass(frozen=True)
class FactualSettings:
    enabled: bool = True
    textual_threshold: float = 0.65
    numerical_tolerance: float = 0.05
    knowledge_base: tuple[str, ...] = ()
    signed: bool = False


@dataclass(frozen=True)
class SafetySettings:
    enabled: bool = True
    toxicity_threshold: float = 0.5
    forbidden_terms: tuple[str, ...] = ()
    forbidden_topics: tuple[str, ...] = ()
    competitor_names: tuple[str, ...] = ()
    pii_is_critical: bool = True


@dataclass(frozen=True)
class QualitySettings:
    enabled: bool = True
    use_heuristic: bool = False
    model: str | None = None


@dataclass(frozen=True)
class Settings:
    hallucination: HallucinationSettings = field(default_factory=HallucinationSettings)
    factual_accuracy: FactualSettings = field(default_factory=FactualSettings)
    content_safety: SafetySettings = field(default_factory=SafetySettings)
    quality: QualitySettings = field(default_factory=QualitySettings)
    # Custom evaluators: name -> its own settings mapping ("enabled" defaults to true).
    custom: dict[str, dict] = field(default_factory=dict)

    def of(self, name: str):
        return getattr(self, name) if name in BUILT_IN else self.custom.get(name, {})

    def is_enabled(self, name: str) -> bool:
        if name in BUILT_IN:
            return bool(getattr(self, name).enabled)
        return bool(self.custom.get(name, {}).get("enabled", True))


# Reporting order of the built-in evaluators.
BUILT_IN = ("hallucination", "factual_accuracy", "content_safety", "quality")


# What an evaluator can add to a row, see operators.results.
PARTS = ("score", "sub_scores", "passed", "categories", "flags", "details", "method", "error")


@dataclass(frozen=True)
class Slot:
    """Where an evaluator finds its inputs in a row, and the prefix of what it adds.

    ``nli`` is array<struct<contradiction, entailment, neutral>> and ``similarity`` is
    array<double>, both aligned with the kept sentences; ``claim_matches`` is
    array<struct<similarity, position>> aligned the same way. Without them the lexical
    stand-ins are used. ``model_error`` names a column that says why a row has no model scores.
    ``judge`` is struct<coherence, fluency, relevance, ...>. Only the listed ``parts`` of each result
    are built.
    """

    text: str = "generated"
    source: str = "source"
    prompt: str = "prompt"
    toxicity: str = "toxicity"
    nli: str | None = None
    similarity: str | None = None
    claim_matches: str | None = None
    model_error: str | None = None
    judge: str | None = None
    prefix: str = ""
    parts: tuple[str, ...] = PARTS

    def out(self, name: str) -> str:
        return f"{self.prefix}{name}"

    def temp(self, name: str) -> str:
        return f"_{self.prefix}{name}"
