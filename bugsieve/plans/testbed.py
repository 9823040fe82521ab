"""The given tables seen as reports, records, vectors and incoming reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.functions.decisions import placeholder_decision
from bugsieve.operators.encoders import unit_vector
from bugsieve.operators.reports import defect_id
from bugsieve.plans.build import describe_reports
from bugsieve.session import spread
from bugsieve.sources.readers import parse_report_text


#: Added to row numbers, so that the ids of the checks pass from five digits to six.
FIRST_ID = 99_801


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Headers put into the middle of documents, one for each section pattern; in the patterns' order.
HEADERS = [
    "Steps to reproduce", "STM", "Reproduction steps", "How to reproduce", "Expected behavior", "Should display",
    "Actual outcome", "What happened", "Instead", "Environment", "Platform", "OS version", "Browser version",
    "System info", "Build ID", "User agent", "Log file", "Stack trace", "Error message", "Traceback", "Console output",
]
#: Of so many consecutive documents the first ``len(HEADERS)`` get a header.
HEADER_CYCLE = 24


def with_header(doc_id: Column, text: Column) -> Column:
    """The text with a section header between its halves, for most documents."""
    half = F.floor(F.length(text) / 2).cast("int")
    place = (doc_id % HEADER_CYCLE).cast("int")
    header = F.get(F.array(*[F.lit(h) for h in HEADERS]), place)
    parted = F.concat(
        F.substring(text, F.lit(1), half), F.lit("\n"), header, F.lit(": "), F.substring(text, half + 1, F.length(text))
    )
    return F.when(place < len(HEADERS), parted).otherwise(text)


def raw_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reports, most with a section header inside; labels give severity and fix
    label to some of them."""
    labels = table(spark, sf, "labels")
    severity = (
        F.when(F.col("toxic") == 1, "critical")
        .when(F.col("quality") == 1, "normal")
        .when(F.col("quality") == 0, "minor")
    )
    cluster = F.when(F.col("lang") == "fr", -1).otherwise(
        F.substring("source", 4, 9).cast("int")
    )
    return spread(table(spark, sf, "documents")).join(labels, "doc_id", "left").select(
        defect_id(F.col("doc_id") + FIRST_ID).alias("defect_id"),
        with_header(F.col("doc_id"), F.col("text")).alias("raw_description"),
        severity.alias("severity"),
        F.lit(None).cast("int").alias("fixing_time"),
        F.col("quality").alias("fix_label"),
        F.lit(None).cast("string").alias("title"),
        cluster.alias("cluster_id"),
        F.col("source").alias("project"),
    )


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Valid reports with every derived column."""
    return describe_reports(raw_reports(spark, sf))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """As stored, and a display decision for listings."""
    return described(spark, sf).withColumn(
        "decision", placeholder_decision(F.col("defect_id"))
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        defect_id(F.col("vec_id") + FIRST_ID).alias("defect_id"),
        F.col("embedding").alias("vector"),
        F.col("label").alias("cluster_id"),
    )


def clustered_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The given vectors, those of the first seven labels drawn to one vector each, some closer
    than others: dense clusters with borders, and noise around them."""
    e = table(spark, sf, "embeddings")
    anchors = e.filter("vec_id < 10").select(F.col("vec_id").alias("label"), F.col("embedding").alias("a"))
    weight = 0.5 + (F.col("vec_id") % 5) * 0.2
    drawn = F.zip_with("a", "embedding", lambda a, x: a.cast("double") + weight * x.cast("double"))
    mixed = F.when(F.col("label") < 7, drawn).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return e.join(F.broadcast(anchors), "label").select(  # ten anchors
        defect_id(F.col("vec_id") + FIRST_ID).alias("defect_id"),
        unit_vector(mixed).alias("vector"),
        F.col("label").alias("cluster_id"),
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector, perturbed lightly, clearly or strongly by its label."""
    amount = F.when(F.col("label") < 4, 0.3).when(F.col("label") < 7, 1.2).otherwise(3.0)
    wobble = F.transform(
        "embedding",
        lambda x, i: x.cast("double") * (1 + F.col("amount") * F.when(i % 2 == 0, 1).otherwise(-1)),
    )
    return table(spark, sf, "embeddings").withColumn("amount", amount).select(
        F.col("vec_id").alias("query_id"), unit_vector(wobble).alias("vector")
    )


def incoming_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the conversations as free-text reports."""
    turns = table(spark, sf, "conversations").select(
        F.format_string("C-%d-%d", "conv_id", "turn").alias("report_id"), "text"
    )
    return parse_report_text(turns).drop("text")
