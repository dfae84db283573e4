"""Search scores: lexical overlap, graph signals, weight profiles, linear models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lexical_tokens, query_tokens

WEIGHTS = ("weight_subsystem", "weight_relationship", "weight_support", "weight_coverage_penalty", "weight_criticality")
# Weights of each profile, in the order of WEIGHTS.
PROFILES = {
    "default": (0.28, 0.05, 0.09, 0.15, 0.12),
    "analysis": (0.38, 0.10, 0.08, 0.18, 0.18),
    "operations": (0.22, 0.08, 0.06, 0.28, 0.10),
    "docs-heavy": (0.26, 0.04, 0.22, 0.12, 0.08),
}
VECTOR_WEIGHT, LEXICAL_WEIGHT = 1.0, 0.25
# Score of each criticality.
CRITICALITY = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}


def resolve_weights(profile: str = "default", **over: float) -> tuple[str, dict[str, float]]:
    """Name and weights of a profile; overrides are clamped to [0, 1] and show in the name."""
    if profile not in PROFILES:
        raise ValueError(f"unknown weight profile: {profile}")
    if unknown := set(over) - set(WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    given = {k: min(1.0, max(0.0, float(v))) for k, v in over.items() if v is not None}
    return profile + "+overrides" * bool(given), dict(zip(WEIGHTS, PROFILES[profile], strict=True)) | given


def hybrid_weights(vector: float = VECTOR_WEIGHT, lexical: float = LEXICAL_WEIGHT) -> tuple[float, float]:
    vector, lexical = max(0.0, vector), max(0.0, lexical)
    return (vector, lexical) if vector + lexical > 0 else (1.0, lexical)


def lexical_score(query: Column, *texts: Column) -> Column:
    """Mean over distinct query terms: 1 for a token, 0.5 where one holds the other, else 0."""

    def share(both: Column) -> Column:
        terms, tokens = both["terms"], both["tokens"]
        part = lambda t: F.exists(tokens, lambda x: F.contains(x, t) | F.contains(t, x))
        total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when(F.array_contains(tokens, t), 1.0).when(part(t), 0.5).otherwise(0.0))
        return F.when((F.size(terms) == 0) | (F.size(tokens) == 0), 0.0).otherwise(F.least(F.lit(1.0), total / F.size(terms)))

    # The lambda binds both token lists once, where a plain expression would cut the text again for each term.
    both = F.struct(lexical_tokens(query).alias("terms"), lexical_tokens(F.concat_ws(" ", *texts)).alias("tokens"))
    return F.get(F.transform(F.array(both), share), F.lit(0))


def base_score(vector: Column, lexical: Column, vector_weight: float = VECTOR_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> Column:
    v, x = hybrid_weights(vector_weight, lexical_weight)
    return vector * v + lexical * x


def subsystem_affinity(subsystem: Column, query: Column) -> Column:
    name, tokens = F.lower(F.coalesce(subsystem, F.lit(""))), query_tokens(query)
    near = F.exists(tokens, lambda t: F.contains(t, name) | F.contains(name, t))
    return F.when(name == "", 0.0).when(F.array_contains(tokens, name), 1.0).when(near, 0.5).otherwise(0.0)


def supporting_bonus(related_ids: Column) -> Column:
    """0.2 for each of at most two documents, 0.1 for each of at most two tests."""
    count = lambda label: F.least(F.size(F.filter(related_ids, lambda i: i.startswith(label + ":"))), F.lit(2))
    return F.coalesce(count("DesignDoc") * 0.2 + count("TestCase") * 0.1, F.lit(0.0))


def coverage_ratio(ratio: Column, missing: Column) -> Column:
    number = F.trim(ratio.cast("string")).try_cast("double")
    # Spark's greatest skips nulls, which must stay null here.
    given = F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
    return F.coalesce(given, F.when(F.coalesce(missing.cast("double"), F.lit(0.0)) != 0, 0.0).otherwise(1.0))


def criticality_score(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in CRITICALITY.items():
        out = out.when(text == k, F.lit(v))
    return out.otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def adjusted_score(base: Column, affinity: Column, relationships: Column, bonus: Column, criticality: Column, ratio: Column, has_context: Column, weights: dict[str, float]) -> Column:
    """Heuristic score; without a graph context only the base counts."""
    w = weights
    boosted = (
        base
        + w["weight_subsystem"] * affinity
        + w["weight_relationship"] * F.least(relationships, F.lit(5))
        + w["weight_support"] * bonus
        + w["weight_criticality"] * criticality
        - w["weight_coverage_penalty"] * (1.0 - ratio)
    )
    return F.when(has_context, boosted).otherwise(base)


def linear_score(features: dict[str, Column], names: list[str], coefficients: list[float], intercept: float) -> Column:
    """Intercept and products of a linear model; the caller checks that the features exist."""
    out = F.lit(float(intercept))
    for name, c in zip(names, coefficients, strict=True):
        out = out + F.lit(float(c)) * features[name]
    return out
