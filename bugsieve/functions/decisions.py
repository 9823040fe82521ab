"""Decision rules over similarity scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv

DECISIONS = ("duplicate", "possible_duplicate", "new_defect")


def decide(
    score: Column,
    duplicate: float = fv.DUPLICATE_THRESHOLD,
    possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD,
) -> Column:
    """Three-way ladder on the unrounded best score; no score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return (
        F.when(s >= duplicate, DECISIONS[0])
        .when(s >= possible, DECISIONS[1])
        .otherwise(DECISIONS[2])
    )


def assigned_cluster(
    score: Column, cluster: Column, possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD
) -> Column:
    """Cluster of the best match when it scores high enough, else -1."""
    return F.when(score >= possible, F.coalesce(cluster, F.lit(-1))).otherwise(F.lit(-1))


def hash_bucket(key: Column) -> Column:
    """MD5 of the key as a 128-bit integer, modulo 100.

    Done on the two 64-bit halves: 2**64 is 16 modulo 100.
    """
    digest = F.md5(key)
    halves = [
        F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % 100 for at in (1, 17)
    ]
    return ((halves[0] * 16 + halves[1]) % 100).cast("int")


def placeholder_decision(key: Column) -> Column:
    """Decision by hash bucket: a stable sample for display, not a real decision."""
    bucket = hash_bucket(key)
    return (
        F.when(bucket < 18, DECISIONS[0]).when(bucket < 42, DECISIONS[1]).otherwise(DECISIONS[2])
    )
