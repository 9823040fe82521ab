"""Listing operators: filters, search, paging, lookup, recent rows, map links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions.text import fold_severity
from bugsieve.operators.numbering import number_rows
from bugsieve.operators.reports import id_order
from bugsieve.session import cut_lineage


DEEP_ROWS = 100_000


def severity_is(severity: str) -> Column:
    return F.lower("severity") == severity.lower()


def cluster_is(cluster_id: int) -> Column:
    return F.col("cluster_id") == cluster_id


def mentions(q: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; no wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False))
    return hit


def search_reports(
    df: DataFrame, severity: str | None = None, cluster_id: int | None = None, q: str | None = None
) -> DataFrame:
    """Listing filters; those left out do not apply."""
    if severity:
        df = df.filter(severity_is(severity))
    if cluster_id is not None:
        df = df.filter(cluster_is(cluster_id))
    if q:
        df = df.filter(mentions(q, "title", "raw_description"))
    return df


def screen_reports(
    df: DataFrame, q: str = "", decision: str = "all", severity: str = "all"
) -> DataFrame:
    """Screen filter: text in title or id, and decision, and folded severity."""
    if q:
        df = df.filter(mentions(q, "title", "defect_id"))
    if decision != "all":
        df = df.filter(F.col("decision") == decision)
    if severity != "all":
        df = df.filter(fold_severity(F.col("severity")) == severity)
    return df


def without_noise(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("cluster_id"), F.lit(-1)) != -1)


def cluster_name(cluster: Column) -> Column:
    """Display name of a cluster; ids beyond the fixed list get a generic one."""
    names = F.array(*[F.lit(n) for n in fv.CLUSTER_NAMES])
    generic = F.concat(F.lit("Cluster #"), cluster.cast("string"))
    return F.coalesce(F.when(cluster >= 0, F.get(names, cluster)), generic)


def clusters_named(df: DataFrame, q: str = "") -> DataFrame:
    """Rows with their cluster's display name, kept when the name contains ``q``."""
    named = df.withColumn("cluster_name", cluster_name(F.col("cluster_id")))
    return named.filter(mentions(q, "cluster_name")) if q else named


def above_threshold(matches: DataFrame, t: float, score: str = "score") -> DataFrame:
    return matches.filter(F.col(score) >= t)


def lite_rows(records: DataFrame) -> DataFrame:
    return records.select(
        "defect_id",
        "title",
        "severity",
        "cluster_id",
        F.size("missing_fields").alias("missing_count"),
        "improved_summary",
    )


def without_heavy_fields(matches: DataFrame) -> DataFrame:
    return matches.drop("normalized_text")


def _check_page(page: int, per_page: int) -> int:
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")
    if per_page > fv.MAX_PER_PAGE:
        raise ValueError(f"per_page is at most {fv.MAX_PER_PAGE}")
    return per_page


def page_of(df: DataFrame, page: int, per_page: int = 20, order: str = "defect_id") -> DataFrame:
    """One page in id order.

    ``orderBy().limit()`` is a bounded top-n in each partition; only ``page * per_page``
    rows reach the final merge, never the whole table.  For pages beyond ``DEEP_ROWS`` rows all rows
    are numbered instead, so no task merges that many; a service keeps a :mod:`.pages` directory.
    """
    n = _check_page(page, per_page)
    if page * n > DEEP_ROWS:
        rows = df.select(F.struct(*id_order(df, order)).alias("_place"), F.struct(*df.columns).alias("_row"))
        wanted = F.col("_number").between((page - 1) * n + 1, page * n)
        return number_rows(rows, "_place", name="_number").filter(wanted).orderBy("_number").select("_row.*")
    return df.orderBy(*id_order(df, order)).limit(page * n).offset((page - 1) * n)


def page_after(
    df: DataFrame, last: object, per_page: int = 20, order: str = "defect_id"
) -> DataFrame:
    """The page after a known key: cost does not grow with the depth of the page."""
    n = _check_page(1, per_page)
    place = id_order(df, order)
    later = F.col(order) > F.lit(last)
    if len(place) > 1:
        size = F.length(F.lit(last))
        later = (place[0] > size) | ((place[0] == size) & later)
    return df.filter(later).orderBy(*place).limit(n)


def page_totals(df: DataFrame, per_page: int = 20) -> DataFrame:
    n = _check_page(1, per_page)
    return df.agg(
        F.count("*").alias("total"),
        F.ceil(F.count("*") / F.lit(n)).cast("bigint").alias("total_pages"),
    )


def recent(df: DataFrame, n: int = 5, order: str = "defect_id") -> DataFrame:
    return df.orderBy(*id_order(df, order)).limit(n)


def lookup(df: DataFrame, key: str | int, column: str = "defect_id") -> DataFrame:
    """One report by id; the equality is pushed into the parquet scan."""
    return df.filter(F.col(column) == key)


def first_members(df: DataFrame, n: int, order: str = "defect_id") -> DataFrame:
    """First ``n`` members of each cluster by id.

    ``row_number() <= n`` lets Spark cut every map task to ``n`` rows per cluster before
    the shuffle, so one huge cluster does not fill one task.
    """
    w = W.partitionBy("cluster_id").orderBy(*id_order(df, order))
    return df.withColumn("member", F.row_number().over(w)).filter(F.col("member") <= n)


def chain_links(df: DataFrame, key: str = "defect_id") -> DataFrame:
    """Edges between consecutive members of a cluster, in id order.

    One cluster may hold a large part of all rows, so a window per cluster is not safe.
    Rows are first sorted by range on ``(cluster, key)``: a hot cluster then spans many
    partitions.  Links inside a partition come from a window over (partition, cluster);
    the few links across partitions come from each partition's first and last member.
    """
    nodes = without_noise(df).select("cluster_id", key)
    place = id_order(nodes, key)
    # The partition number must not change between the two uses below.
    ranged = cut_lineage(
        nodes.repartitionByRange("cluster_id", *place).withColumn(
            "part", F.spark_partition_id()
        )
    )
    inside = W.partitionBy("part", "cluster_id").orderBy(*place)
    links = ranged.withColumn("target", F.lead(key).over(inside)).filter("target is not null")
    ends = ranged.groupBy("cluster_id", "part").agg(
        F.min_by(key, F.struct(*place)).alias("first"), F.max_by(key, F.struct(*place)).alias("last")
    )
    across = W.partitionBy("cluster_id").orderBy("part")  # at most one row per partition
    seams = ends.withColumn("target", F.lead("first").over(across)).filter("target is not null")
    return links.select("cluster_id", F.col(key).alias("source"), "target").unionByName(
        seams.select("cluster_id", F.col("last").alias("source"), "target")
    )
