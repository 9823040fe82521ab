"""Queries over distributions, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.operators import audits as au
from bugsieve.operators import distributions as di
from bugsieve.operators.clustering import centroids
from bugsieve.operators.reports import defect_id
from bugsieve.operators.similarity import top_k_matches
from bugsieve.plans import sql as S
from bugsieve.plans import testbed as tb
from bugsieve.plans.queries_vectors import decided_records, map_nodes
from bugsieve.plans.registry import query
from bugsieve.session import scratch_path
from bugsieve.sources import writers

# --- distributions ---------------------------------------------------------------------


@query(
    "ag1_severity_distribution",
    S.with_raw("SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM raw GROUP BY ALL"),
)
def ag1(spark, sf):
    return di.severity_distribution(tb.raw_reports(spark, sf))


@query(
    "ag1_priority_distribution",
    "SELECT o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY ALL",
)
def ag1_orders(spark, sf):
    o = tb.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("severity"))
    return di.severity_distribution(o)


@query(
    "ag2_cluster_distribution",
    S.with_raw(
        "SELECT cluster_id, count(*) AS n FROM raw GROUP BY cluster_id "
        "ORDER BY cluster_id = -1, cluster_id"
    ),
)
def ag2(spark, sf):
    return di.cluster_distribution(tb.raw_reports(spark, sf))


@query(
    "ag3_cluster_count",
    S.with_raw("SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters FROM raw"),
)
def ag3(spark, sf):
    return di.cluster_count(tb.raw_reports(spark, sf))


@query(
    "ag4_missing_field_distribution",
    S.with_records(
        "SELECT field, count(*) AS n FROM (SELECT unnest(missing_fields) AS field FROM records) GROUP BY field"
    ),
)
def ag4(spark, sf):
    return di.missing_field_distribution(tb.records(spark, sf))


@query(
    "ag5_placeholder_decisions",
    f"SELECT {S.placeholder('id')} AS decision, count(*) AS n "
    "FROM (SELECT format('DEF-{:05d}', o_orderkey + 1) AS id FROM orders) GROUP BY decision",
)
def ag5(spark, sf):
    ids = tb.table(spark, sf, "orders").select(defect_id(F.col("o_orderkey") + 1).alias("defect_id"))
    return di.placeholder_decisions(ids)


@query(
    "ag6_totals_and_dimension",
    "SELECT count(*) AS total, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings",
)
def ag6(spark, sf):
    return di.corpus_totals(tb.table(spark, sf, "embeddings"))


@query(
    "ag7_average_missing",
    S.with_records("SELECT round(avg(len(missing_fields)), 1) AS avg_missing FROM records"),
)
def ag7(spark, sf):
    return di.average_missing(tb.records(spark, sf))


@query(
    "ag8_top_clusters",
    S.with_raw(
        "SELECT cluster_id, count(*) AS n FROM raw WHERE cluster_id <> -1 GROUP BY cluster_id "
        "ORDER BY n DESC, cluster_id LIMIT 10"
    ),
)
def ag8(spark, sf):
    return di.top_clusters(tb.raw_reports(spark, sf))


@query(
    "ag9_shares",
    S.with_raw(
        "SELECT cluster_id, n, CAST(floor(n * 100 / sum(n) OVER () + 0.5) AS BIGINT) AS pct_of_total, "
        "CAST(floor(n * 100 / max(n) OVER () + 0.5) AS BIGINT) AS pct_of_max "
        "FROM (SELECT cluster_id, count(*) AS n FROM raw GROUP BY cluster_id)"
    ),
)
def ag9(spark, sf):
    return di.with_shares(di.cluster_sizes(tb.raw_reports(spark, sf)))


@query("ag10_cluster_sizes", "SELECT label AS cluster_id, count(*) AS n FROM embeddings GROUP BY label")
def ag10(spark, sf):
    return di.cluster_sizes(tb.vectors(spark, sf))


_FOLDED = ", ".join(
    f"count(*) FILTER ({S.fold('severity')} = '{n}') AS {n.lower()}"
    for n in ("Critical", "High", "Medium", "Low", "Unknown")
)


@query(
    "ag11_cluster_rollup",
    S.with_raw(
        f"""SELECT c.*, m.first_members FROM
              (SELECT cluster_id, count(*) AS n, {_FOLDED} FROM raw WHERE cluster_id <> -1 GROUP BY cluster_id) c
            JOIN (SELECT cluster_id, string_agg(defect_id, ',' ORDER BY length(defect_id), defect_id) AS first_members FROM
              (SELECT cluster_id, defect_id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(defect_id), defect_id) AS r
               FROM raw) WHERE r <= 3 GROUP BY cluster_id) m USING (cluster_id)"""
    ),
)
def ag11(spark, sf):
    return di.cluster_rollup(tb.raw_reports(spark, sf))


@query(
    "ag11_first_members",
    S.with_raw(
        "SELECT cluster_id, defect_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY length(defect_id), defect_id) "
        "AS INTEGER) AS member FROM raw WHERE cluster_id <> -1 QUALIFY member <= 20"
    ),
)
def ag11_members(spark, sf):
    return di.cluster_members(tb.raw_reports(spark, sf).select("cluster_id", "defect_id"))


@query(
    "ag12_dashboard_severities",
    S.with_raw(
        "SELECT " + ", ".join(f"count(*) FILTER ({S.fold('severity')} = '{n}') AS {n.lower()}"
                              for n in ("Critical", "High", "Medium", "Low")) + " FROM raw"
    ),
)
def ag12(spark, sf):
    return di.dashboard_severities(tb.raw_reports(spark, sf))


@query(
    "ag12_dashboard_raw_keys",
    S.with_raw(
        "SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS high, "
        "count(*) FILTER (severity = 'normal') AS medium, count(*) FILTER (severity = 'minor') AS low FROM raw"
    ),
)
def ag12_raw(spark, sf):
    return di.dashboard_severities(tb.raw_reports(spark, sf), raw_keys=True)


@query(
    "ag13_executive_summary",
    S.with_decided(
        "SELECT count(*) AS total, count(*) FILTER (decision = 'duplicate') AS duplicates, "
        "CAST(floor(count(*) FILTER (decision = 'duplicate') * 100 / count(*) + 0.5) AS BIGINT) AS duplicate_pct, "
        "count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters FROM decided_records"
    ),
)
def ag13(spark, sf):
    return di.executive_summary(decided_records(spark, sf))


@query(
    "ag14_quality_counts",
    S.with_records(
        "SELECT count(*) FILTER (len(missing_fields) > 0) AS with_missing, "
        "count(*) FILTER (len(missing_fields) = 0) AS complete FROM records"
    ),
)
def ag14(spark, sf):
    return di.quality_counts(tb.records(spark, sf))


_AG16 = ("title", "raw_description", "steps", "actual", "severity")


@query(
    "ag16_population_rates",
    S.with_records(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, count(*) FILTER (length({S.strip(c)}) > 0) AS populated, "
            f"round(count(*) FILTER (length({S.strip(c)}) > 0) * 100 / count(*), 1) AS pct FROM records"
            for c in _AG16
        )
    ),
)
def ag16(spark, sf):
    return di.population_rates(tb.records(spark, sf), *_AG16)


@query(
    "ag18_cluster_centroids",
    S.with_vectors(
        """SELECT m.cluster_id, m.pos::INTEGER AS pos, round(m.x / sqrt(s.ss), 6) AS x FROM means m JOIN
             (SELECT cluster_id, sum(x * x) AS ss FROM means GROUP BY cluster_id) s USING (cluster_id)""",
        """cells AS (SELECT cluster_id, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM vectors),
           means AS MATERIALIZED (SELECT cluster_id, pos, avg(x) AS x FROM cells GROUP BY ALL)""",
    ),
)
def ag18(spark, sf):
    c = centroids(tb.vectors(spark, sf))
    return c.select("cluster_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("ag19_map_rings")
def ag19(spark, sf):
    """Rings over principal components, whose signs no SQL fixes: checked by test."""
    return di.map_rings(map_nodes(spark, sf))


@query(
    "ag19_map_rings_by_size",
    "SELECT label AS cluster_id, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, "
    "greatest(40, count(*) * 5) AS radius FROM embeddings GROUP BY label",
)
def ag19_plain(spark, sf):
    nodes = tb.vectors(spark, sf).select(
        "cluster_id", F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y")
    )
    return di.map_rings(nodes).withColumns({c: F.round(c, 6) for c in ("x", "y")})


# --- splits ------------------------------------------------------------------------------

_SPLIT = """split AS (
  SELECT r.*, CASE WHEN row_number() OVER (ORDER BY length(defect_id), defect_id) <=
    (SELECT count(*) FROM raw) * (SELECT count(*) FROM labels)
      // ((SELECT count(*) FROM labels) + (SELECT count(*) FROM benchmark))
    THEN 'train' ELSE 'test' END AS split FROM raw r)"""


def _split(spark, sf):
    n_train, n_test = (tb.table(spark, sf, t).count() for t in ("labels", "benchmark"))
    return au.ordered_split(tb.raw_reports(spark, sf), n_train, n_test)


@query("sp1_ordered_split", S.with_raw("SELECT defect_id, split FROM split", _SPLIT))
def sp1(spark, sf):
    return _split(spark, sf).select("defect_id", "split")


@query(
    "sp2_split_metadata",
    S.with_raw(
        """SELECT split, 'size' AS metric, CAST(count(*) AS DOUBLE) AS value FROM split GROUP BY split
           UNION ALL SELECT split, 'ratio', round(count(*) / (SELECT count(*) FROM raw), 4) FROM split GROUP BY split
           UNION ALL SELECT split, 'severity:' || coalesce(severity, 'unknown'), count(*) FROM split GROUP BY ALL
           UNION ALL SELECT 'all', 'id_overlap', 0
           UNION ALL SELECT split, 'vector_rows', count(*) FROM split JOIN vectors USING (defect_id) GROUP BY split
           UNION ALL SELECT split, 'vector_dimension', max(len(vector)) FROM split JOIN vectors USING (defect_id)
             GROUP BY split""",
        _SPLIT, S.VECTORS,
    ),
)
def sp2(spark, sf):
    """Metadata of the splits, from their written records and vectors."""
    path = scratch_path(spark, "splits")
    au.write_splits(_split(spark, sf), tb.vectors(spark, sf).select("defect_id", "vector"), path)
    records, vectors = (spark.read.parquet(f"{path}/{name}") for name in ("records", "vectors"))
    return (
        au.split_metadata(records)
        .unionByName(au.split_overlap_count(records))
        .unionByName(au.split_shapes(records, vectors.drop("split")))
    )


# --- audits --------------------------------------------------------------------------------


@query(
    "au1_required_fields",
    S.with_records(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, true AS present, count(*) FILTER (length({S.strip(c)}) > 0) AS populated, "
            f"round(count(*) FILTER (length({S.strip(c)}) > 0) * 100 / count(*), 1) AS pct FROM records"
            for c in au.RECORD_FIELDS
        )
    ),
)
def au1(spark, sf):
    return au.required_field_audit(tb.records(spark, sf))


@query(
    "au2_normalized_presence",
    S.with_records(
        f"SELECT count(*) AS total, count(*) FILTER (length({S.strip('normalized_text')}) > 0) AS with_text FROM records"
    ),
)
def au2(spark, sf):
    return au.normalized_presence(tb.records(spark, sf))


_PER_FIELD = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (list_contains(missing_fields, '{f}')) AS n FROM records"
    for f, _, _ in fv.REQUIRED_FIELDS
)


@query(
    "au3_missing_field_breakdown",
    S.with_records(
        "SELECT field, n, round(n * 100 / t, 1) AS pct, round(n / t, 1) AS per_report FROM ("
        f"{_PER_FIELD} UNION ALL SELECT 'any field', CAST(sum(len(missing_fields)) AS BIGINT) FROM records), "
        "(SELECT count(*) AS t FROM records)"
    ),
)
def au3(spark, sf):
    return au.missing_field_audit(tb.records(spark, sf))


@query(
    "au4_critical_nulls",
    S.with_records(
        "SELECT count(*) AS total, count(*) FILTER (defect_id IS NULL OR defect_id = 'nan') AS bad_id, "
        "count(*) FILTER (title IS NULL OR title = 'nan') AS bad_title FROM records"
    ),
)
def au4(spark, sf):
    return au.critical_nulls(tb.records(spark, sf))


_UPPER = "regexp_matches({c}, '\\p{{Lu}}')"


def _sql_lowercase(column: str) -> str:
    upper = _UPPER.format(c=column)
    return S.with_records(
        f"SELECT count(*) AS total, count(*) FILTER ({upper}) AS with_upper, (SELECT coalesce(string_agg(defect_id, ',' "
        f"ORDER BY {S.by_id()}), '') FROM (SELECT defect_id FROM records WHERE {upper} ORDER BY {S.by_id()} LIMIT 3)) "
        "AS samples FROM records"
    )


@query("au5_lowercase_normalized", _sql_lowercase("normalized_text"))
def au5(spark, sf):
    return au.lowercase_audit(tb.records(spark, sf))


@query("au5_lowercase_titles", _sql_lowercase("title"))
def au5_titles(spark, sf):
    return au.lowercase_audit(tb.records(spark, sf), "title")


def _sql_artifacts(c: str, source: str) -> str:
    return (
        f"SELECT count(*) AS total, count(*) FILTER (regexp_matches({c}, '[^a-zA-Z\\s]')) AS special, "
        f"count(*) FILTER (regexp_matches({c}, 'https?://')) AS urls, "
        f"count(*) FILTER (regexp_matches({c}, '<[^>]+>')) AS html, "
        f"count(*) FILTER (regexp_matches({c}, '\\S+@\\S+\\.\\S+')) AS emails FROM {source}"
    )


@query("au6_artifacts_normalized", S.with_records(_sql_artifacts("normalized_text", "records")))
def au6(spark, sf):
    return au.artifact_audit(tb.records(spark, sf))


@query("au6_artifacts_pages", _sql_artifacts("html", "pages"))
def au6_pages(spark, sf):
    return au.artifact_audit(tb.table(spark, sf, "pages"), "html")


@query(
    "au7_stopword_ratio",
    S.with_records(
        f"""SELECT CAST(sum(len(w)) AS BIGINT) AS tokens, CAST(sum(len(s)) AS BIGINT) AS stopwords,
              round(sum(len(s)) * 100 / sum(len(w)), 2) AS pct, sum(len(s)) / sum(len(w)) < 0.01 AS passed
            FROM (SELECT w, list_filter(w, lambda t: t IN ({S.words(fv.AUDIT_STOPWORDS)})) AS s FROM (
              SELECT list_filter(string_split_regex(raw_description, '\\s+'), lambda t: t <> '') AS w FROM
                (SELECT raw_description FROM records)))"""
    ),
)
def au7(spark, sf):
    """On raw descriptions, where stopwords do occur."""
    return au.stopword_audit(tb.records(spark, sf), column="raw_description")


def _sql_whitespace(c: str, source: str) -> str:
    return (
        f"SELECT count(*) AS total, count(*) FILTER ({c} <> {S.strip(c)}) AS leading_or_trailing, "
        f"count(*) FILTER (contains({c}, '  ')) AS double_spaces, "
        f"count(*) FILTER (contains({c}, chr(9)) OR contains({c}, chr(10))) AS tabs_or_newlines FROM {source}"
    )


@query("au8_whitespace_normalized", S.with_records(_sql_whitespace("normalized_text", "records")))
def au8(spark, sf):
    return au.whitespace_audit(tb.records(spark, sf))


@query("au8_whitespace_documents", _sql_whitespace("text", "documents"))
def au8_raw(spark, sf):
    return au.whitespace_audit(tb.table(spark, sf, "documents"), "text")


_EXTRA = "(length(steps) > 0 OR length(actual) > 0)"


@query(
    "au9_combined_text",
    S.with_records(
        f"SELECT count(*) FILTER (length({S.strip('combined_text')}) > 0) AS nonempty, "
        + ", ".join(
            f"count(*) FILTER (contains(combined_text, {S.strip(c)}) OR length({c}) = 0) AS holds_{c}"
            for c in ("title", "steps", "actual")
        )
        + f", round(avg(length(normalized_text)) FILTER ({_EXTRA}), 4) AS mean_with_extra, "
        f"round(avg(length(normalized_text)) FILTER (NOT {_EXTRA}), 4) AS mean_without_extra FROM records"
    ),
)
def au9(spark, sf):
    return au.combined_text_audit(tb.records(spark, sf))


@query(
    "au10_vector_completeness",
    S.with_vectors(
        """SELECT count(r.defect_id) AS records, count(v.defect_id) AS vectors,
             count(*) FILTER (v.defect_id IS NULL) AS without_vector,
             count(*) FILTER (r.defect_id IS NULL) AS without_record,
             count(*) FILTER (len(list_filter(v.vector, lambda x: x <> 0)) = 0) AS zero_vectors,
             count(*) FILTER (len(list_filter(v.vector, lambda x: isnan(x))) > 0) AS nan_vectors
           FROM raw r FULL JOIN vectors v USING (defect_id)""",
        S.RAW,
    ),
)
def au10(spark, sf):
    return au.vector_completeness(tb.raw_reports(spark, sf), tb.vectors(spark, sf), vector="vector")


@query(
    "au11_vector_norms",
    S.with_vectors(
        "SELECT round(avg(sqrt(list_dot_product(vector, vector))), 4) AS mean_norm, "
        "abs(avg(sqrt(list_dot_product(vector, vector))) - 1) < 0.01 AS passed FROM vectors"
    ),
)
def au11(spark, sf):
    return au.norm_audit(tb.vectors(spark, sf), "vector")


@query(
    "au12_dimensions",
    "WITH s AS (SELECT side, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim "
    "FROM embeddings, (VALUES ('stored'), ('declared'), ('queries')) AS t(side) GROUP BY side) "
    "SELECT *, (SELECT min(min_dim) = max(max_dim) FROM s) AS passed FROM s",
)
def au12(spark, sf):
    """Stored vectors, the metadata written for them, and encoded queries."""
    declared = writers.index_metadata(tb.table(spark, sf, "embeddings"), "stored")
    return au.dimension_sides(tb.vectors(spark, sf), declared, tb.vector_queries(spark, sf))


@query(
    "au13_index_coverage",
    "SELECT *, records = vectors AND vectors = indexed AS passed FROM (SELECT (SELECT count(*) FROM documents) "
    "AS records, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT vec_id) FROM embeddings) AS indexed)",
)
def au13(spark, sf):
    v = tb.vectors(spark, sf)
    return au.index_coverage(tb.raw_reports(spark, sf), v, v.select("defect_id").distinct())


@query(
    "au14_search_contract",
    S.with_vectors(
        "SELECT count(*) AS queries, count(*) FILTER (n <> 5) AS wrong_size, "
        "count(*) FILTER (low < -1.000001 OR high > 1.000001) AS out_of_range, "
        "(SELECT count(*) FROM vectors) * 3 AS cases, (SELECT count(*) FROM vectors) * 3 AS cases_right FROM "
        "(SELECT query_id, count(*) AS n, min(score) AS low, max(score) AS high FROM matches GROUP BY query_id)",
        S.top_matches(5),
    ),
)
def au14(spark, sf):
    """Match sizes and score ranges; and the decision cases 0.90, 0.65 and 0.35, each made from
    every stored vector and a direction that is orthogonal to it."""
    v = tb.vectors(spark, sf)
    rows = au.search_contract(top_k_matches(tb.vector_queries(spark, sf), v), 5, v.count())
    cases = au.decision_cases(v)
    return rows.withColumns({c: cases.select(c).scalar() for c in cases.columns})
