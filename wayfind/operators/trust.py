"""Reputation of attestations, trust and confidence of entities, verification tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 0.5
MESH_VERIFIED_AT = 3


def reputation(invocations: Column, successes: Column, avg_latency_ms: Column, avg_rating: Column) -> Column:
    """0.4 success rate + 0.3 rating of 5 + 0.3 latency sigmoid around a second; no invocations, no success."""
    success = F.when(invocations > 0, successes / invocations).otherwise(0.0)
    rating = F.least(avg_rating / 5.0, F.lit(1.0))
    latency = 1.0 / (1.0 + F.exp((avg_latency_ms - 1000.0) / 300.0))
    return 0.4 * success + 0.3 * rating + 0.3 * latency


def confidence(attestations: Column, invocations: Column) -> Column:
    return 0.5 * (1.0 - F.exp(-attestations / 3.0)) + 0.5 * (1.0 - F.exp(-invocations / 300.0))


def entity_trust(attestations: DataFrame, weights: DataFrame | None = None, entity: str = "entity_id", observer: str = "observer_registry") -> DataFrame:
    """(entity, trust, confidence, attestations, invocations): reputations weighted by observer; unknown observers weigh 0.5.

    weights: (observer, weight). attestations need invocations, successes, avg_latency_ms and avg_rating.
    """
    rep = reputation(F.col("invocations"), F.col("successes"), F.col("avg_latency_ms"), F.col("avg_rating"))
    rows = attestations.withColumn("__rep", rep)
    rows = rows.join(weights.select(observer, F.col("weight").alias("__w")), observer, "left") if weights is not None else rows.withColumn("__w", F.lit(None).cast("double"))
    w = F.coalesce("__w", F.lit(DEFAULT_WEIGHT))
    out = rows.groupBy(entity).agg((F.sum(w * F.col("__rep")) / F.sum(w)).alias("trust"), F.count(F.lit(1)).alias("attestations"), F.sum("invocations").alias("invocations"))
    return out.withColumn("confidence", confidence(F.col("attestations"), F.col("invocations")))


def verification_tiers(attestations: DataFrame, attester: str = "attester_id", subject: str = "subject_id", at: int = MESH_VERIFIED_AT) -> DataFrame:
    """Distinct attesters per subject, and the tier that enough of them give."""
    out = attestations.groupBy(subject).agg(F.countDistinct(attester).alias("n_attesters"))
    return out.withColumn("tier", F.when(F.col("n_attesters") >= at, "mesh-verified").otherwise("self-announced"))
