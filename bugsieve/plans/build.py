"""The batch build: raw reports to records, vectors, clusters, index and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.operators import reports as rp
from bugsieve.operators.clustering import kmeans_labels, relabel
from bugsieve.operators.encoders import TfIdfEncoder, hashed_features
from bugsieve.session import cut_lineage
from bugsieve.sources import readers, split_csv, writers


def load_reports(
    spark: SparkSession, fix_path: str, severity_path: str, tracker_root: str | None = None,
    max_records: int | None = None, split: bool = False,
) -> DataFrame:
    """Base tables joined on the description, tracker exports appended, ids minted; capped only
    if ``max_records`` is given.

    ``split`` reads the base tables by the splits of their files; it is for files that follow the
    quoting of :mod:`bugsieve.sources.split_csv`.  Otherwise a file is one task.
    """
    read = split_csv.read_split_csv if split else readers.read_csv_reports
    fixes = read(spark, fix_path, readers.FIX_SCHEMA, positions=True)
    severities = read(spark, severity_path, readers.SEVERITY_SCHEMA)
    out = rp.canonical_base(rp.join_severity(fixes, severities))
    out = out.withColumn("_source", F.lit(0))
    if tracker_root:
        exports = readers.read_tracker_exports(spark, tracker_root, positions=True)
        rows = rp.canonical_tracker(exports, *readers.POSITION).withColumn("_source", F.lit(1))
        out = rp.union_reports(out, rows)
    # Positions come from the scans, so ids do not depend on how the join moves the rows; the
    # severities of one text follow in their own order.
    order = ("_source", *readers.POSITION)
    reports = rp.mint_ids(out, *order, "severity").drop(*order)
    return rp.cap_rows(reports, max_records) if max_records else reports


def describe_reports(raw: DataFrame, strict: bool = False) -> DataFrame:
    """All text columns of the valid reports: titles, sections, combined and normalised
    text, tokens, missing fields and summary.  One projection and one filter."""
    out = rp.with_tokens(rp.with_combined_text(rp.with_titles_and_sections(raw, strict)))
    return rp.with_completeness(rp.valid_text(rp.with_defaults(out)))


def stored_form(described: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The 16 record fields, texts whole."""
    fields = [f.name for f in readers.RECORD_SCHEMA.fields]
    return described.select(
        *[F.col(cluster).cast("int").alias("cluster_id") if f == "cluster_id" else F.col(f) for f in fields]
    )


def corpus_statistics(records: DataFrame, dimension: int) -> DataFrame:
    """Totals and distributions as ``(metric, key, value)`` rows."""
    cells = cut_lineage(
        records.groupBy("cluster_id", F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n"))
    )  # the only pass over the records; what follows sums a handful of rows
    noise = F.col("cluster_id") == -1

    def total(value, metric: str) -> DataFrame:
        return writers.as_stat(cells.agg(value.alias("n")), metric, None, "n")

    def by(key: str, rows: DataFrame, metric: str) -> DataFrame:
        return writers.as_stat(rows.groupBy(key).agg(F.sum("n").alias("n")), metric, key, "n")

    return writers.stats_rows(
        total(F.sum("n"), "total_records"),
        total(F.countDistinct(F.when(~noise, F.col("cluster_id"))), "total_clusters"),
        total(F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)), "noise_points"),
        by("cluster_id", cells.filter(~noise), "cluster_distribution"),
        total(F.lit(dimension), "embedding_dimension"),
        by("severity", cells, "severity_distribution"),
    )


def build_corpus(
    raw: DataFrame, out: str, k: int = fv.N_CLUSTERS, restarts: int = 10
) -> TfIdfEncoder:
    """Build and write everything a triage service reads.

    The text chain runs once and is written; the later steps read that table, so neither
    fitting nor clustering repeats it.
    """
    spark = raw.sparkSession
    describe_reports(raw).write.mode("overwrite").parquet(f"{out}/described")
    described = spark.read.parquet(f"{out}/described")
    encoder = TfIdfEncoder.fit(described)
    encoded = encoder.encode(described.select("defect_id", "tokens"))
    encoded.select("defect_id", "vector").write.mode("overwrite").parquet(f"{out}/vectors")
    vectors = spark.read.parquet(f"{out}/vectors")
    features = hashed_features(described.select("defect_id", "tokens"))
    labels = kmeans_labels(features, k, restarts=restarts, vector="features").select(
        "defect_id", "cluster_id"
    )
    clustered = relabel(described.drop("cluster_id").withColumn("cluster_id", F.lit(-1)), labels)
    writers.write_records(stored_form(clustered), f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    writers.lightweight_index(records).write.mode("overwrite").parquet(f"{out}/index")
    dimension = encoder.dimension
    writers.index_metadata(
        vectors.withColumn("embedding", F.col("vector.indices")), encoder.name
    ).withColumn("dimension", F.lit(dimension)).write.mode("overwrite").json(f"{out}/model")
    stats = corpus_statistics(records, dimension)
    stats.write.mode("overwrite").parquet(f"{out}/statistics")
    return encoder
