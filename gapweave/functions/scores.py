"""Scoring rules as column expressions."""

from pyspark.sql import Column, functions as F

from gapweave.schemas import PENALTIES, PROVIDER_TIERS

SCORE_MODES = ("atlas_cosine", "cosine")
TERMS = ("skill", "rating", "duration", "quality")


def penalty_weight(evidence: Column, match_certificate: bool = False) -> Column:
    """Weight of an evidence column, read from its header.

    ``match_certificate`` also counts a header with "(Certificate)" as a
    certification; off by default, so those keep their full score.
    """
    header = F.lower(evidence)
    weight = None
    for kind, value in PENALTIES:
        test = header.contains(kind)
        if match_certificate and kind == "certification":
            test = test | header.contains("certificate")
        weight = F.when(test, F.lit(value)) if weight is None else weight.when(test, F.lit(value))
    return weight.otherwise(F.lit(1.0))


def provider_tier(provider: Column) -> Column:
    """Quality tier 0-4. The 64 names are one literal map, so no join is needed."""
    pairs = ", ".join(f"'{name}', {tier}" for tier, names in PROVIDER_TIERS.items() for name in names)
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), provider), F.lit(0))


def quality_score(provider: Column) -> Column:
    return provider_tier(provider) / F.lit(float(max(PROVIDER_TIERS)))


def weighted_score(
    score: Column,
    avg_rating: Column | None = None,
    duration_hrs: Column | None = None,
    quality: Column | None = None,
    terms=("skill",),
    skill_weight: float = 0.5,
    rating_weight: float = 0.3,
    duration_weight: float = 0.2,
    quality_weight: float = 0.2,
) -> Column:
    """Ranking score. Only the similarity counts unless more ``terms`` are asked for."""
    terms = TERMS if terms == "all" else terms
    parts = {
        "skill": lambda: F.lit(skill_weight) * score,
        "rating": lambda: F.lit(rating_weight) * avg_rating,
        "duration": lambda: F.lit(duration_weight) * (F.lit(1.0) / (duration_hrs + F.lit(1.0))),
        "quality": lambda: F.lit(quality_weight) * quality,
    }
    total = None
    for term in terms:
        value = parts[term]()
        total = value if total is None else total + value
    return total
