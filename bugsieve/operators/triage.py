"""Decisions for incoming reports: matches, severity vote, analysis, enhancement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.functions import completeness as cp
from bugsieve.functions import decisions as de
from bugsieve.functions import fixed_values as fv
from bugsieve.functions import text as tx
from bugsieve.operators.encoders import TfIdfEncoder
from bugsieve.operators import text_index as ti
from bugsieve.operators.similarity import near_duplicates, top_k_matches
from bugsieve.operators.skew import ALWAYS_COLD, join_one_row_per_key
from bugsieve.session import cut_lineage, spread, stored

QUERY_FIELDS = ("title", "description", "steps", "expected", "actual", "environment", "logs")


def vote_severity(matches: DataFrame, by: str = "query_id") -> DataFrame:
    """Most common non-empty severity among matches; ties go to the best-ranked value.

    Matches are at most k per query, so the window only orders a handful of rows.
    """
    votes = (
        matches.filter(F.length("severity") > 0)
        .groupBy(by, "severity")
        .agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    )
    w = W.partitionBy(by).orderBy(F.desc("votes"), "first")
    return (
        votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
        .select(by, F.col("severity").alias("suggested_severity"))
    )


def decide_matches(
    matches: DataFrame,
    duplicate: float = fv.DUPLICATE_THRESHOLD,
    possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD,
) -> DataFrame:
    """One row per query from ranked matches that carry ``cluster_id``: decision,
    confidence, assigned cluster, best match and matches in that cluster."""
    fields = [c for c in ("rank", "defect_id", "score", "cluster_id", "title", "severity") if c in matches.columns]
    top = F.array_sort(F.collect_list(F.struct(*fields)))
    best = F.get(F.col("top"), F.lit(0))
    grouped = matches.groupBy("query_id").agg(top.alias("top"))
    cluster = de.assigned_cluster(best["score"], best["cluster_id"], possible)
    return grouped.select(
        "query_id",
        de.decide(best["score"], duplicate, possible).alias("decision"),
        F.round(F.coalesce(best["score"], F.lit(0.0)), 4).alias("confidence"),
        cluster.alias("cluster_id"),
        best["defect_id"].alias("best_match"),
        F.size(F.filter("top", lambda m: m["cluster_id"] == cluster)).alias("same_cluster"),
        "top",
    )


def attach(matches: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Columns of the matched records, joined by id.

    Matches are stored first: several results are derived from them.  A modest number of
    them is sent to the records, which then are scanned in place; otherwise a record that
    very many queries match is joined apart from the rest.
    """
    stored = cut_lineage(matches)
    n = stored.count()
    wanted = records.select("defect_id", *columns)
    if n <= ALWAYS_COLD:
        return wanted.join(F.broadcast(stored), "defect_id")
    sizes = stored.groupBy("defect_id").agg(F.count("*").alias("_n"))
    return join_one_row_per_key(stored, wanted.join(sizes, "defect_id"), ["defect_id"], "_n", n)


def new_links(analysed: DataFrame) -> DataFrame:
    """Edge from a new report to its best match, unless the report is new."""
    return analysed.filter(F.col("decision") != de.DECISIONS[2]).select(
        F.col("query_id").alias("source"), F.col("best_match").alias("target")
    )


def apply_overrides(analysed: DataFrame, marked: DataFrame) -> DataFrame:
    """Reports a person marked as duplicates count as duplicates."""
    flag = marked.select("query_id").distinct().withColumn("_marked", F.lit(True))
    return analysed.join(flag, "query_id", "left").withColumn(
        "decision", F.when(F.col("_marked"), de.DECISIONS[0]).otherwise(F.col("decision"))
    ).drop("_marked")


def accept_enhancement(forms: DataFrame, improved: DataFrame, key: str = "report_id") -> DataFrame:
    """Overwrite title, description and severity by the improved values that are not empty."""
    new = improved.select(
        key,
        F.col("title").alias("_t"),
        F.col("summary").alias("_d"),
        F.col("suggested_severity").alias("_s"),
    )
    joined = forms.join(new, key, "left").withColumn("_hit", F.col("_d").isNotNull() | F.col("_t").isNotNull())
    return joined.withColumns(
        {
            "title": F.coalesce(tx.empty_to_null(F.col("_t")), F.col("title")),
            "description": F.coalesce(tx.empty_to_null(F.col("_d")), F.col("description")),
            "severity": F.when(
                F.col("_hit"), F.lower(F.coalesce(tx.empty_to_null(F.col("_s")), F.lit("normal")))
            ).otherwise(F.col("severity")),
        }
    ).drop("_t", "_d", "_s", "_hit")


# --- admission --------------------------------------------------------------------


def query_text_column():
    return tx.combine_query_text(*[F.col(f) for f in QUERY_FIELDS])


def admit_for_analysis(reports: DataFrame) -> DataFrame:
    short = cp.shorter_than(query_text_column(), 10)
    return reports.withColumn("reasons", cp.rejection_reasons({"Insufficient text content": short}))


def admit_for_search(requests: DataFrame, query: str = "query") -> DataFrame:
    short = cp.shorter_than(F.col(query), 3)
    return requests.withColumn("reasons", cp.rejection_reasons({"Query too short": short}))


def admit_for_enhancement(reports: DataFrame) -> DataFrame:
    both = F.concat(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    short = cp.shorter_than(both, 5)
    return reports.withColumn("reasons", cp.rejection_reasons({"Insufficient text": short}))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") == 0).drop("reasons")


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.size("reasons") > 0)


# --- composites -------------------------------------------------------------------


def encode_text(df: DataFrame, encoder: TfIdfEncoder, text: str) -> DataFrame:
    """Normalise a text column and encode it with a fitted encoder."""
    return encoder.encode(df.withColumn("tokens", tx.lemmatized_tokens(F.col(text)))).drop("tokens")


def text_matches(
    asked: DataFrame, text: str, corpus: DataFrame | ti.TextIndex, encoder: TfIdfEncoder | None, k: int
) -> DataFrame:
    """Top-k of the texts of ``asked(query_id, ...)``: by a stored index, or against a table of vectors
    with the encoder that made them."""
    if isinstance(corpus, ti.TextIndex):
        return ti.top_k(corpus, spread(asked).select("query_id", tx.lemmatized_tokens(F.col(text)).alias("tokens")), k)
    return top_k_matches(encode_text(asked, encoder, text).select("query_id", "vector"), corpus, k)


def search(
    requests: DataFrame,
    records: DataFrame,
    vectors: DataFrame | ti.TextIndex,
    encoder: TfIdfEncoder | None = None,
    k: int = fv.SEARCH_DEFAULT_K,
) -> DataFrame:
    """Text search: ``requests(query_id, query)`` to ranked records with their scores.

    ``vectors`` is a stored index, or the records' vectors; those need their ``encoder``.
    """
    if not 1 <= k <= fv.SEARCH_MAX_K:
        raise ValueError(f"k is from 1 to {fv.SEARCH_MAX_K}")
    admitted = accepted(admit_for_search(requests))
    matches = text_matches(admitted, "query", vectors, encoder, k)
    return attach(matches, records, "title", "severity", "cluster_id", "improved_summary").select(
        "query_id", "rank", "defect_id", "title", "severity", "cluster_id",
        F.round("score", 4).alias("similarity_score"), "improved_summary",
    )


def analyze(
    reports: DataFrame,
    records: DataFrame,
    vectors: DataFrame | ti.TextIndex,
    encoder: TfIdfEncoder | None = None,
    k: int = fv.TOP_MATCHES,
    duplicate: float = fv.DUPLICATE_THRESHOLD,
    possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD,
    key: str = "report_id",
) -> DataFrame:
    """Full analysis of a batch of incoming reports, one nested row per accepted report; ``vectors`` as
    in :func:`search`."""
    admitted = accepted(admit_for_analysis(reports)).withColumn("_text", query_text_column())
    asked = admitted.select(F.col(key).alias("query_id"), "_text")
    matches = attach(text_matches(asked, "_text", vectors, encoder, k), records, "title", "severity", "cluster_id")
    decided = decide_matches(matches, duplicate, possible)
    votes = vote_severity(matches)
    best = F.get(F.col("top"), F.lit(0))
    fields = {f: F.col(f) for f, _, _ in fv.REQUIRED_FIELDS}
    missing = cp.missing_details(fields)
    joined = (
        admitted.join(decided.withColumnRenamed("query_id", key), key, "left")
        .join(votes.withColumnRenamed("query_id", key), key, "left")
    )
    title = F.coalesce(tx.empty_to_null(F.col("title")), tx.extract_title(F.col("description")))
    summary = cp.query_summary(
        F.col("title"), F.col("description"), best["defect_id"], best["title"], F.round(best["score"], 4)
    )
    cluster = F.coalesce("cluster_id", F.lit(-1))
    rounded = F.transform("top", lambda m: m.withField("score", F.round(m["score"], 4)))
    return joined.select(
        key,
        F.coalesce("decision", F.lit(de.DECISIONS[2])).alias("decision"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        cluster.alias("cluster_id"),
        rounded.alias("top_matches"),
        F.struct(
            title.alias("title"),
            summary.alias("summary"),
            missing.alias("missing_fields"),
            F.coalesce("suggested_severity", F.lit("normal")).alias("suggested_severity"),
            cluster.alias("suggested_cluster"),
        ).alias("improved_report"),
        missing.alias("missing_fields"),
        F.struct(
            F.lit(duplicate).alias("duplicate"), F.lit(possible).alias("possible_duplicate")
        ).alias("thresholds"),
    )


def enhance(
    reports: DataFrame,
    records: DataFrame,
    vectors: DataFrame | ti.TextIndex,
    encoder: TfIdfEncoder | None = None,
    key: str = "report_id",
) -> DataFrame:
    """Improved title, summary, missing fields and suggested severity of each report."""
    text = tx.combine_enhance_text(*[F.col(f) for f in ("title", "description", "steps", "actual")])
    admitted = accepted(admit_for_enhancement(reports)).withColumn("_text", text)
    asked = admitted.select(F.col(key).alias("query_id"), "_text")
    matches = attach(text_matches(asked, "_text", vectors, encoder, fv.TOP_MATCHES), records, "severity")
    votes = vote_severity(matches).withColumnRenamed("query_id", key)
    fields = {f: F.col(f) for f, _, _ in fv.REQUIRED_FIELDS}
    return admitted.join(votes, key, "left").select(
        key,
        cp.enhanced_title(F.col("title"), F.col("description")).alias("title"),
        cp.enhanced_summary(
            *[F.col(f) for f in ("description", "steps", "actual", "expected", "environment")]
        ).alias("summary"),
        cp.missing_details(fields).alias("missing_fields"),
        F.coalesce("suggested_severity", F.lit("normal")).alias("suggested_severity"),
    )


def stored_decisions(
    vectors: DataFrame,
    duplicate: float = fv.DUPLICATE_THRESHOLD,
    possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD,
) -> DataFrame:
    """``(defect_id, decision, confidence)`` of every stored report, by the best score it has
    with another one; a score below ``possible`` counts as none."""
    vectors = stored(vectors.select("defect_id", "vector"), "vectors")  # read twice
    best = near_duplicates(vectors, possible, 1, stored=True).select(F.col("query_id").alias("defect_id"), "score")
    return vectors.select("defect_id").join(best, "defect_id", "left").select(
        "defect_id",
        de.decide(F.col("score"), duplicate, possible).alias("decision"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("confidence"),
    )


def decision_distribution(
    vectors: DataFrame,
    duplicate: float = fv.DUPLICATE_THRESHOLD,
    possible: float = fv.POSSIBLE_DUPLICATE_THRESHOLD,
) -> DataFrame:
    """How many stored reports are duplicates of another one, by best score."""
    decided = stored_decisions(vectors, duplicate, possible)
    return decided.groupBy("decision").agg(F.count("*").alias("n"))
