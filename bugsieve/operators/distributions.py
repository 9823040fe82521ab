"""Counts, shares, roll-ups and dashboard numbers over report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions.decisions import DECISIONS, placeholder_decision
from bugsieve.functions.text import fold_severity, strip, unicode_pattern
from bugsieve.operators.browse import first_members, without_noise

def severity_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Reports per severity; null counts as ``unknown``."""
    return df.groupBy(*by, F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(
        F.count("*").alias("n")
    )


def cluster_distribution(df: DataFrame, n: int | None = None) -> DataFrame:
    """Reports per cluster, ordered by id with noise last; the first ``n`` if given."""
    ordered = cluster_sizes(df).orderBy(F.col("cluster_id") == -1, "cluster_id")
    return ordered if n is None else ordered.limit(n)


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id")).agg(
        F.count("*").alias("n")
    )


def cluster_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters")
    )


def missing_field_distribution(df: DataFrame) -> DataFrame:
    return (
        df.select(F.explode("missing_fields").alias("field"))
        .groupBy("field")
        .agg(F.count("*").alias("n"))
    )


def placeholder_decisions(df: DataFrame) -> DataFrame:
    return df.groupBy(placeholder_decision(F.col("defect_id")).alias("decision")).agg(
        F.count("*").alias("n")
    )


def corpus_totals(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.max(F.size(vector)).cast("int").alias("dimension")
    )


def average_missing(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.avg(F.size("missing_fields")), 1).alias("avg_missing"))


def top_clusters(df: DataFrame, n: int = 10) -> DataFrame:
    return cluster_sizes(without_noise(df)).orderBy(F.desc("n"), "cluster_id").limit(n)


def with_shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """Whole-percent share of the total and of the largest group.

    The window spans one row per group, the result of an aggregation, not the reports.
    """
    everything = W.partitionBy()
    return counts.withColumns(
        {
            "pct_of_total": F.floor(F.col(n) * 100 / F.sum(n).over(everything) + 0.5).cast("bigint"),
            "pct_of_max": F.floor(F.col(n) * 100 / F.max(n).over(everything) + 0.5).cast("bigint"),
        }
    )


def by_count(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(n), key)


def cluster_rollup(df: DataFrame) -> DataFrame:
    """Per cluster: size, folded severity counts and the first three titles' ids."""
    folded = fold_severity(F.col("severity"))
    kept = without_noise(df)
    counts = kept.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        *[
            F.count_if(folded == name).alias(name.lower())
            for name in ("Critical", "High", "Medium", "Low", "Unknown")
        ],
    )
    members = (
        first_members(kept.select("cluster_id", "defect_id"), 3)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("member", "defect_id"))).alias("m"))
        .select("cluster_id", F.array_join("m.defect_id", ",").alias("first_members"))
    )
    return counts.join(members, "cluster_id")


def cluster_members(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` members of every cluster, noise left out."""
    return first_members(without_noise(df), n)


def dashboard_severities(df: DataFrame, raw_keys: bool = False) -> DataFrame:
    """Four dashboard buckets in one row; ``raw_keys`` counts one raw word per bucket."""
    folded = fold_severity(F.col("severity"))
    raw = {"Critical": "critical", "High": "major", "Medium": "normal", "Low": "minor"}
    return df.agg(
        *[
            F.count_if((F.col("severity") == word) if raw_keys else (folded == name)).alias(
                name.lower()
            )
            for name, word in raw.items()
        ]
    )


def executive_summary(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Total, duplicates, duplicate rate in whole percent and active clusters."""
    duplicates = F.count_if(F.col(decision) == DECISIONS[0])
    return df.agg(
        F.count("*").alias("total"),
        duplicates.alias("duplicates"),
        F.floor(duplicates * 100 / F.count("*") + 0.5).cast("bigint").alias("duplicate_pct"),
        F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"),
    )


def quality_counts(df: DataFrame) -> DataFrame:
    incomplete = F.size("missing_fields") > 0
    return df.agg(
        F.count_if(incomplete).alias("with_missing"), F.count_if(~incomplete).alias("complete")
    )


def population_rates(df: DataFrame, *columns: str) -> DataFrame:
    """Per column: non-blank rows and their share in percent, from one pass."""
    filled = [F.count_if(F.length(strip(F.col(c))) > 0).alias(c) for c in columns]
    row = df.agg(F.count("*").alias("_total"), *filled)
    long = row.unpivot(["_total"], list(columns), "field", "populated")
    return long.select(
        "field",
        "populated",
        F.round(F.col("populated") * 100 / F.col("_total"), 1).alias("pct"),
    )


def cluster_keywords(df: DataFrame) -> DataFrame:
    """Up to three keywords per cluster, from the titles of its first five members."""
    heads = first_members(without_noise(df).select("cluster_id", "defect_id", "title"), 5)
    titles = heads.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("member", "title"))).alias("heads")
    )
    words = F.filter(
        F.flatten(F.transform("heads", lambda h: F.split(h["title"], unicode_pattern(r"\s+")))),
        lambda w: (F.length(w) > 3) & ~F.lower(w).isin(fv.KEYWORD_STOPWORDS),
    )
    bare = F.transform(F.slice(words, 1, 3), lambda w: F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    return titles.select(
        "cluster_id", F.array_join(F.filter(bare, lambda w: w != ""), ",").alias("keywords")
    )


def map_rings(nodes: DataFrame) -> DataFrame:
    """Centre and radius of every cluster on the two-dimensional map."""
    return without_noise(nodes).groupBy("cluster_id").agg(
        F.avg("x").alias("x"),
        F.avg("y").alias("y"),
        F.greatest(F.lit(40), F.count("*") * 5).cast("bigint").alias("radius"),
    )


def vocabulary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Token counts over the corpus; partial counts keep the shuffle at one row per
    distinct token and task."""
    return (
        df.select(F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
