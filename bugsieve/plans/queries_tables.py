"""Queries over sources, sinks, projections, filters, joins and listings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugsieve.functions import completeness as cp
from bugsieve.functions import fixed_values as fv
from bugsieve.operators import browse as br
from bugsieve.operators import clustering as cl
from bugsieve.operators import reports as rp
from bugsieve.operators import triage as tr
from bugsieve.operators.audits import common_ids, split_overlap
from bugsieve.operators.distributions import by_count, severity_distribution, vocabulary
from bugsieve.operators.pages import PageDirectory
from bugsieve.operators.similarity import top_k_matches
from bugsieve.plans import build
from bugsieve.plans import sql as S
from bugsieve.plans import testbed as tb
from bugsieve.plans.queries_vectors import decided_records
from bugsieve.plans.registry import query
from bugsieve.session import cut_lineage, scratch_path
from bugsieve.sources import readers, split_csv, writers

# --- sources and sinks --------------------------------------------------------------


@query(
    "io1_csv_scan",
    "SELECT d.text AS \"Description\", CAST(l.quality AS INTEGER) AS \"Label\", "
    "CAST(NULL AS INTEGER) AS \"Fixing_time\" FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def io1(spark, sf):
    return readers.read_csv_reports(spark, _fix_csv(spark, sf), readers.FIX_SCHEMA)


def _fix_csv(spark, sf, **options) -> str:
    path = scratch_path(spark, "fix_csv")
    tb.table(spark, sf, "documents").join(tb.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("Unnamed: 0"), F.col("text").alias("Description"),
        F.col("quality").alias("Label"),
    ).write.csv(path, header=True, quote='"', escape='"', quoteAll=False,
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options)
    return path


@query(
    "io1_split_csv",
    "SELECT d.text AS \"Description\", CAST(l.quality AS INTEGER) AS \"Label\", "
    "CAST(NULL AS INTEGER) AS \"Fixing_time\" FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def io1_split(spark, sf):
    """The same file read by its splits, every text in quotes."""
    return split_csv.read_split_csv(spark, _fix_csv(spark, sf, escapeQuotes=True), readers.FIX_SCHEMA)


@query(
    "io2_recursive_csv_scan",
    "SELECT CASE WHEN lang <> 'de' THEN substr(text, 1, 40) END AS \"Summary\", text AS \"Description\", "
    "CASE WHEN lang <> 'en' THEN source END AS \"Priority\" FROM documents",
)
def io2(spark, sf):
    """Documents written as tracker exports in several header layouts, read back as one."""
    return readers.read_tracker_exports(spark, _tracker_exports(spark, sf), glob="part-*.csv").drop("source_file")


def _tracker_exports(spark, sf, ending: str = "_bugs") -> str:
    root = scratch_path(spark, "trackers")
    d = tb.table(spark, sf, "documents").select(
        F.substring("text", 1, 40).alias("Summary"), F.col("text").alias("Description"),
        F.col("source").alias("Priority"), "lang",
    )
    options = {"header": True, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    layouts = {
        "en": (["Summary", "Description"], "lang = 'en'"),
        "de": (["Description", "Priority"], "lang = 'de'"),
        "rest": (["Priority", "Summary", "Description"], "lang not in ('en', 'de')"),
    }
    for name, (columns, rule) in layouts.items():
        d.filter(rule).select(*columns).write.options(**options).csv(f"{root}/{name}{ending}")
    d.select("Summary").write.options(**options).csv(f"{root}/undescribed{ending}")
    return root


@query(
    "io2_split_exports",
    "SELECT CASE WHEN lang <> 'de' THEN substr(text, 1, 40) END AS \"Summary\", text AS \"Description\", "
    "CASE WHEN lang <> 'en' THEN source END AS \"Priority\" FROM documents",
)
def io2_split(spark, sf):
    """The same exports in one scan: all splits of all layouts at once."""
    root = _tracker_exports(spark, sf, "_bugs.csv")
    return split_csv.read_split_exports(spark, f"{root}/*_bugs.csv", glob="*").drop("source_file")


@query("io3_drop_junk_columns", "SELECT doc_id, text, lang FROM documents")
def io3(spark, sf):
    d = tb.table(spark, sf, "documents").select(
        F.col("source").alias("Unnamed: 0"), "doc_id", "text", F.col("n_chars").alias("Unnamed: 4"), "lang"
    )
    return rp.drop_junk_columns(d)


_RECORD_COLUMNS = (
    "defect_id, title, raw_description, combined_text, normalized_text, severity, "
    "CAST(0 AS INTEGER) AS fixing_time, coalesce(fix_label, 0) AS fix_label, cluster_id, steps, "
    "expected, actual, environment, logs, array_to_string(missing_fields, ',') AS missing_fields, "
    "improved_summary"
)


@query("io4_record_table_json", S.with_records(f"SELECT {_RECORD_COLUMNS} FROM records"))
def io4(spark, sf):
    path = scratch_path(spark, "records_json")
    writers.write_records(build.stored_form(tb.described(spark, sf)), path, "json")
    return readers.read_records(spark, path, "json").withColumn(
        "missing_fields", F.array_join("missing_fields", ",")
    )


@query(
    "io5_vector_table",
    S.with_vectors(
        "SELECT defect_id, unnest(range(len(vector)))::INTEGER AS pos, unnest(vector) AS x FROM vectors"
    ),
)
def io5(spark, sf):
    path = scratch_path(spark, "vectors")
    writers.write_vectors(tb.vectors(spark, sf).withColumnRenamed("vector", "embedding"), path)
    v = readers.read_vectors(spark, path)
    return v.select("defect_id", F.posexplode("embedding").alias("pos", "x")).withColumn(
        "x", F.col("x").cast("double")
    )


@query(
    "io6_index_metadata",
    "SELECT 'stored' AS model_name, CAST(max(len(embedding)) AS INTEGER) AS dimension, "
    "count(*) AS index_size FROM embeddings",
)
def io6(spark, sf):
    return writers.index_metadata(tb.table(spark, sf, "embeddings"), "stored")


_STATS = """
  SELECT 'total_records' AS metric, '' AS key, count(*) AS value FROM records
  UNION ALL SELECT 'total_clusters', '', count(DISTINCT cluster_id) FROM records WHERE cluster_id <> -1
  UNION ALL SELECT 'noise_points', '', count(*) FILTER (cluster_id = -1) FROM records
  UNION ALL SELECT 'cluster_distribution', cluster_id::VARCHAR, count(*) FROM records
    WHERE cluster_id <> -1 GROUP BY cluster_id
  UNION ALL SELECT 'embedding_dimension', '', count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM described)
  UNION ALL SELECT 'severity_distribution', coalesce(severity, 'unknown'), count(*) FROM records GROUP BY severity"""


def _statistics(spark, sf):
    """Totals and vocabulary from one run of the text chain."""
    described = cut_lineage(tb.described(spark, sf).select("cluster_id", "severity", "tokens"))
    return build.corpus_statistics(described, vocabulary(described).count())


@query("io7_stats_rows", S.with_records(_STATS))
def io7(spark, sf):
    return _statistics(spark, sf)


@query(
    "io7_stats_document",
    S.with_records(
        "SELECT metric, '{' || string_agg('\"' || key || '\":' || value, ',' ORDER BY key) || '}' AS document "
        f"FROM ({_STATS}) GROUP BY metric"
    ),
)
def io7_document(spark, sf):
    return writers.stats_document(_statistics(spark, sf))


@query(
    "io8_lightweight_index",
    S.with_records(
        "SELECT defect_id, title, severity, cluster_id, CAST(len(missing_fields) AS INTEGER) AS missing_count "
        "FROM records"
    ),
)
def io8(spark, sf):
    return writers.lightweight_index(tb.records(spark, sf))


@query(
    "io9_csv_export",
    S.with_decided(
        f"""SELECT defect_id AS "ID", title AS "Title", {S.fold('severity')} AS "Severity",
          decision AS "Decision", cluster_id::VARCHAR AS "Cluster", confidence AS "Confidence", '' AS "Date"
        FROM decided_records"""
    ),
)
def io9(spark, sf):
    path = scratch_path(spark, "export")
    writers.write_csv_export(decided_records(spark, sf), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).fillna("")
    return back.withColumn("Confidence", F.col("Confidence").cast("double"))


@query(
    "io11_report_intake",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN substr(d.text, 1, 50) ELSE d.source END AS title,
         d.text AS description, CASE WHEN l.doc_id IS NOT NULL THEN d.lang END AS severity
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def io11(spark, sf):
    """Labelled documents arrive as JSON, the others as free text."""
    d = tb.table(spark, sf, "documents").join(
        tb.table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left"
    )
    body = F.to_json(
        F.struct(F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("severity"))
    )
    arrived = d.select("doc_id", F.when(F.col("labelled"), body).otherwise(F.col("text")).alias("text"))
    return readers.parse_report_text(arrived).select("doc_id", "title", "description", "severity")


@query(
    "io12_vocabulary_file",
    S.with_records(
        "SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (SELECT token, "
        "count(*) AS n FROM (SELECT unnest(tokens) AS token FROM described) GROUP BY token)"
    ),
)
def io12(spark, sf):
    """The corpus vocabulary written as a ranked token file, read back with its ranks."""
    path = scratch_path(spark, "vocabulary")
    counts = vocabulary(tb.described(spark, sf))
    counts.orderBy(F.desc("n"), "token").select("token").write.text(path)
    return readers.read_vocabulary(spark, path)


# --- projections, ids, caps -----------------------------------------------------------


@query(
    "pr1_rename_columns",
    "SELECT source AS title, text AS raw_description, lang AS severity FROM documents",
)
def pr1(spark, sf):
    d = tb.table(spark, sf, "documents").select(
        F.col("source").alias("Summary"), F.col("text").alias("Description"), F.col("lang").alias("Priority")
    )
    return d.withColumnsRenamed(rp.TRACKER_NAMES)


@query(
    "pr2_constants_and_kept_columns",
    "SELECT text AS raw_description, lang AS severity, source AS title, 0 AS fixing_time, 0 AS fix_label "
    "FROM documents",
)
def pr2(spark, sf):
    d = tb.table(spark, sf, "documents").select(
        F.col("source").alias("Summary"), F.col("text").alias("Description"),
        F.col("lang").alias("Priority"), F.col("n_chars").alias("Votes"),
    )
    return rp.canonical_tracker(d)


@query(
    "pr3_mint_ids",
    "SELECT format('DEF-{:05d}', row_number() OVER (ORDER BY source, doc_id)) AS defect_id, source, doc_id "
    "FROM documents",
)
def pr3(spark, sf):
    return rp.mint_ids(tb.table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


@query(
    "pr3_load_order",
    """WITH sev AS (SELECT d.text AS t, l.toxic AS s FROM documents d JOIN labels l USING (doc_id))
       SELECT format('DEF-{:05d}', row_number() OVER (ORDER BY d.doc_id, sev.s NULLS FIRST)) AS defect_id,
         CAST(sev.s AS VARCHAR) AS severity, length(d.text) AS chars
       FROM documents d LEFT JOIN sev ON d.text = sev.t""",
)
def pr3_load_order(spark, sf):
    """Documents written as several CSV files, loaded with their severities: ids in file order.  A file is
    read by one task, so there are more files where there is more input."""
    root = scratch_path(spark, "load")
    d = tb.table(spark, sf, "documents")
    options = {"header": True, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    files = max(3, d.rdd.getNumPartitions())
    d.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select(
        F.col("text").alias("Description"), F.lit(1).alias("Label")
    ).write.options(**options).csv(f"{root}/fix")
    d.join(tb.table(spark, sf, "labels"), "doc_id").select(
        F.col("text").alias("Description"), F.col("toxic").cast("string").alias("Severity")
    ).write.options(**options).csv(f"{root}/sev")
    loaded = build.load_reports(spark, f"{root}/fix", f"{root}/sev")
    return loaded.select("defect_id", "severity", F.length("raw_description").cast("bigint").alias("chars"))


@query(
    "pr4_row_cap",
    f"SELECT format('DEF-{{:05d}}', o_orderkey + 1) AS defect_id, o_orderpriority AS severity FROM orders "
    "ORDER BY o_orderkey LIMIT 5000",
)
def pr4(spark, sf):
    o = tb.table(spark, sf, "orders").select(
        rp.defect_id(F.col("o_orderkey") + 1).alias("defect_id"), F.col("o_orderpriority").alias("severity")
    )
    return rp.cap_rows(o, 5000)


@query(
    "pr5_truncate_fields",
    S.with_records("SELECT defect_id, " + ", ".join(S.preview(c) for c in fv.PREVIEW_CHARS) + " FROM records"),
)
def pr5(spark, sf):
    rows = rp.with_previews(tb.records(spark, sf))
    return rows.select("defect_id", *[f"{c}_preview" for c in fv.PREVIEW_CHARS])


@query(
    "pr6_defaults",
    S.with_raw(
        "SELECT defect_id, severity, 0 AS fixing_time, coalesce(fix_label, 0) AS fix_label, '' AS logs FROM raw"
    ),
)
def pr6(spark, sf):
    r = tb.raw_reports(spark, sf).withColumn("logs", F.lit(None).cast("string"))
    return rp.with_defaults(r).select("defect_id", "severity", "fixing_time", "fix_label", "logs")


@query(
    "pr7_lite_rows",
    S.with_records(
        "SELECT defect_id, title, severity, cluster_id, CAST(len(missing_fields) AS INTEGER) AS missing_count, "
        "improved_summary FROM records"
    ),
)
def pr7(spark, sf):
    return br.lite_rows(tb.records(spark, sf))


@query("pr8_drop_heavy_field", S.with_records("SELECT defect_id, title, severity, cluster_id FROM records"))
def pr8(spark, sf):
    kept = tb.records(spark, sf).select("defect_id", "title", "normalized_text", "severity", "cluster_id")
    return br.without_heavy_fields(kept)


# --- filters --------------------------------------------------------------------------


@query("fi1_valid_text", S.with_records("SELECT defect_id, length(normalized_text) AS chars FROM described"))
def fi1(spark, sf):
    return tb.described(spark, sf).select("defect_id", F.length("normalized_text").cast("bigint").alias("chars"))


_FI2 = {
    "analysis": ("length(" + S.strip("text") + ") < 10", "Insufficient text content"),
    "search": ("length(" + S.strip("text") + ") < 3", "Query too short"),
    "enhancement": ("length(" + S.strip("substr(text, 1, 50) || text") + ") < 5", "Insufficient text"),
}


@query(
    "fi2_admission",
    "SELECT conv_id, turn, "
    + ", ".join(f"CASE WHEN {c} THEN '{r}' ELSE '' END AS {n}" for n, (c, r) in _FI2.items())
    + f", CASE WHEN length({S.strip('text')}) = 0 THEN 'Title is required,Description is required' "
    "ELSE '' END AS form FROM (SELECT conv_id, turn, CASE WHEN conv_id % 8 < 5 THEN "
    "substr(text, 1, [0, 2, 3, 5, 9][(conv_id % 8 + 1)::INTEGER]) WHEN conv_id % 8 = 5 THEN '   ' ELSE text END AS text "
    "FROM conversations)",
)
def fi2(spark, sf):
    """Turns as reports, many cut so short, or blank, that one rule or more turns them away."""
    place = (F.col("conv_id") % 8).cast("int")
    size = F.get(F.array(*[F.lit(n) for n in (0, 2, 3, 5, 9)]), place)
    text = F.when(place < 5, F.substring(F.col("text"), F.lit(1), size)).when(place == 5, "   ").otherwise(F.col("text"))
    t = readers.parse_report_text(tb.table(spark, sf, "conversations").withColumn("text", text))

    def joined(df, name):
        return df.withColumn(name, F.array_join("reasons", ",")).drop("reasons")

    t = joined(tr.admit_for_analysis(t.withColumn("title", F.lit(None).cast("string"))), "analysis")
    t = t.withColumn("title", F.substring("text", 1, 50))
    t = joined(tr.admit_for_search(t, "text"), "search")
    t = joined(tr.admit_for_enhancement(t), "enhancement")
    form = F.array_join(cp.form_errors(F.col("title"), F.col("description")), ",")
    return t.select("conv_id", "turn", "analysis", "search", "enhancement", form.alias("form"))


@query("fi3_severity_equality", S.with_raw("SELECT defect_id, severity FROM raw WHERE lower(severity) = 'critical'"))
def fi3(spark, sf):
    return br.search_reports(tb.raw_reports(spark, sf), severity="Critical").select("defect_id", "severity")


@query("fi4_cluster_equality", S.with_raw("SELECT defect_id, cluster_id FROM raw WHERE cluster_id = 7"))
def fi4(spark, sf):
    return br.search_reports(tb.raw_reports(spark, sf), cluster_id=7).select("defect_id", "cluster_id")


@query(
    "fi5_substring_search",
    S.with_records(
        "SELECT defect_id, title FROM records WHERE contains(lower(title), 'tion') "
        "OR contains(lower(raw_description), 'tion')"
    ),
)
def fi5(spark, sf):
    return br.search_reports(tb.records(spark, sf), q="TION").select("defect_id", "title")


@query(
    "fi6_screen_filter",
    S.with_decided(
        f"SELECT defect_id, decision FROM decided_records WHERE (contains(lower(title), 'th') OR "
        f"contains(lower(defect_id), 'th')) AND decision = 'new_defect' AND {S.fold('severity')} = 'Medium'"
    ),
)
def fi6(spark, sf):
    kept = br.screen_reports(decided_records(spark, sf), "th", "new_defect", "Medium")
    return kept.select("defect_id", "decision")


@query("fi7_without_noise", S.with_raw("SELECT defect_id, cluster_id FROM raw WHERE cluster_id <> -1"))
def fi7(spark, sf):
    return br.without_noise(tb.raw_reports(spark, sf)).select("defect_id", "cluster_id")


_NAMES = ", ".join(
    "(" + str(i) + ", '" + n.replace("'", "''") + "')" for i, n in enumerate(fv.CLUSTER_NAMES)
)


@query(
    "fi9_cluster_name_search",
    S.with_raw(
        f"SELECT cluster_id, coalesce(name, 'Cluster #' || cluster_id) AS cluster_name, count(*) AS n "
        f"FROM raw LEFT JOIN (VALUES {_NAMES}) t(id, name) ON id = cluster_id WHERE cluster_id <> -1 "
        "AND contains(lower(coalesce(name, 'Cluster #' || cluster_id)), 'data') GROUP BY ALL"
    ),
)
def fi9(spark, sf):
    named = br.clusters_named(br.without_noise(tb.raw_reports(spark, sf)), "Data")
    return named.groupBy("cluster_id", "cluster_name").agg(F.count("*").alias("n"))


@query(
    "fi10_score_threshold",
    S.with_vectors(
        "SELECT query_id, defect_id, round(score, 4) AS score FROM matches WHERE score >= 0.75", S.top_matches(5)
    ),
)
def fi10(spark, sf):
    m = top_k_matches(tb.vector_queries(spark, sf), tb.vectors(spark, sf))
    return br.above_threshold(m, 0.75).select("query_id", "defect_id", F.round("score", 4).alias("score"))


# --- joins and sets --------------------------------------------------------------------


@query(
    "jo1_text_join",
    """WITH sev AS (SELECT d.text AS t, l.toxic AS s FROM documents d JOIN labels l USING (doc_id))
       SELECT d.doc_id, CAST(sev.s AS VARCHAR) AS severity FROM documents d LEFT JOIN sev ON d.text = sev.t""",
)
def jo1(spark, sf):
    d = tb.table(spark, sf, "documents")
    fixes = d.select("doc_id", F.col("text").alias("Description"))
    severities = d.join(tb.table(spark, sf, "labels"), "doc_id").select(
        F.col("text").alias("Description"), F.col("toxic").cast("string").alias("Severity")
    )
    return rp.join_severity(fixes, severities).select("doc_id", F.col("Severity").alias("severity"))


@query(
    "jo2_vector_label_alignment",
    S.with_raw(
        "SELECT raw.defect_id, raw.severity, e.label AS cluster_id, CAST(len(e.embedding) AS INTEGER) AS dim "
        "FROM raw JOIN embeddings e ON raw.defect_id = format('DEF-{:05d}', e.vec_id + 99801)"
    ),
)
def jo2(spark, sf):
    v = tb.vectors(spark, sf).select("defect_id", F.size("vector").alias("dim"), "cluster_id")
    return tb.raw_reports(spark, sf).select("defect_id", "severity").join(v, "defect_id")


@query(
    "jo4_split_overlap",
    "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def jo4(spark, sf):
    return split_overlap(tb.table(spark, sf, "documents"), tb.table(spark, sf, "labels"), "doc_id")


@query(
    "jo5_label_lookup",
    S.with_records(
        f"SELECT t.field, t.label, t.suggestion, count(*) AS n FROM (SELECT unnest(missing_fields) AS field "
        f"FROM described) JOIN (VALUES "
        + ", ".join("(" + S.words(r) + ")" for r in fv.REQUIRED_FIELDS)
        + ") t(field, label, suggestion) USING (field) GROUP BY ALL"
    ),
)
def jo5(spark, sf):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("field", "label", "suggestion")])
    labels = spark.createDataFrame([*fv.REQUIRED_FIELDS, fv.LOGS_SUGGESTION], schema)
    missing = tb.described(spark, sf).select(F.explode("missing_fields").alias("field"))
    counts = missing.groupBy("field").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(labels), "field").select("field", "label", "suggestion", "n")


@query(
    "jo7_nearest_centroid",
    S.with_vectors(
        """SELECT defect_id, cluster_id, round(score, 4) AS score FROM (
             SELECT v.defect_id, c.cluster_id, round(list_dot_product(v.vector, c.centroid), 9) AS score
             FROM vectors v CROSS JOIN centroids c)
           QUALIFY row_number() OVER (PARTITION BY defect_id ORDER BY score DESC, cluster_id) = 1""",
        """cells AS (SELECT cluster_id, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM vectors),
           means AS (SELECT cluster_id, pos, avg(x) AS x FROM cells GROUP BY ALL),
           mean_vectors AS (SELECT cluster_id, list(x ORDER BY pos) AS m FROM means GROUP BY cluster_id),
           centroids AS (SELECT cluster_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m)))
             AS centroid FROM mean_vectors)""",
    ),
)
def jo7(spark, sf):
    v = tb.vectors(spark, sf)
    centres = cl.centroids(v).withColumnRenamed("centroid", "vector")
    return cl.nearest_centroid(v, centres).withColumn("score", F.round("score", 4))


@query(
    "se1_union_layouts",
    S.with_raw(
        "SELECT raw_description, severity, NULL::VARCHAR AS title, fix_label FROM raw "
        "UNION ALL SELECT text, NULL, role, 0 FROM conversations"
    ),
)
def se1(spark, sf):
    base = tb.raw_reports(spark, sf).select("raw_description", "severity", "fix_label")
    other = tb.table(spark, sf, "conversations").select(
        F.col("text").alias("raw_description"), F.col("role").alias("title"), F.lit(0).alias("fix_label")
    )
    return rp.union_reports(base, other)


@query("se2_common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def se2(spark, sf):
    return common_ids(tb.table(spark, sf, "documents"), tb.table(spark, sf, "labels"), "doc_id")


# --- listings --------------------------------------------------------------------------


@query(
    "wi1_match_ranks",
    S.with_vectors("SELECT query_id, defect_id, rank FROM matches", S.top_matches(10)),
)
def wi1(spark, sf):
    m = top_k_matches(tb.vector_queries(spark, sf), tb.vectors(spark, sf), 10)
    return m.select("query_id", "defect_id", "rank")


@query(
    "wi2_chain_links",
    S.with_raw(
        "SELECT * FROM (SELECT cluster_id, defect_id AS source, lead(defect_id) OVER (PARTITION BY cluster_id "
        "ORDER BY length(defect_id), defect_id) AS target FROM raw WHERE cluster_id <> -1) WHERE target IS NOT NULL"
    ),
)
def wi2(spark, sf):
    return br.chain_links(tb.raw_reports(spark, sf))


def _orders(spark, sf):
    return tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("defect_id"), F.col("o_orderpriority").alias("severity"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "wi3_page",
    "SELECT o_orderkey AS defect_id, o_orderpriority AS severity, o_orderstatus AS status FROM orders "
    "WHERE lower(o_orderpriority) = '1-urgent' ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
def wi3(spark, sf):
    return br.page_of(br.search_reports(_orders(spark, sf), severity="1-URGENT"), 3, 50)


@query(
    "wi3_page_directory",
    "SELECT defect_id, severity, status FROM (SELECT o_orderkey AS defect_id, o_orderpriority AS severity, "
    "o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders) "
    "WHERE n BETWEEN 981 AND 1060 OR n > (total - 1) // 80 * 80",
)
def wi3_directory(spark, sf):
    """A page across the border of two slices, and the last one, from a stored directory of all orders."""
    directory = PageDirectory.build(_orders(spark, sf), scratch_path(spark, "pages"), slice_rows=1000)
    _, last = directory.totals(80)
    wide = directory.page(50, 20).unionByName(directory.page(51, 20)).unionByName(directory.page(52, 20)).unionByName(directory.page(53, 20))
    return wide.unionByName(directory.page(last, 80))


@query(
    "wi3_page_after_key",
    "SELECT o_orderkey AS defect_id, o_orderpriority AS severity, o_orderstatus AS status FROM orders "
    "WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 50",
)
def wi3_after(spark, sf):
    return br.page_after(_orders(spark, sf), 700, 50)


@query(
    "wi3_page_totals",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages FROM orders "
    "WHERE lower(o_orderpriority) = '1-urgent'",
)
def wi3_totals(spark, sf):
    return br.page_totals(br.search_reports(_orders(spark, sf), severity="1-URGENT"), 50)


@query(
    "wi5_recent",
    S.with_raw("SELECT defect_id, severity FROM raw ORDER BY length(defect_id), defect_id LIMIT 5"),
)
def wi5(spark, sf):
    return br.recent(tb.raw_reports(spark, sf).select("defect_id", "severity"))


@query(
    "wi6_sorted_counts",
    "SELECT o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, severity",
)
def wi6(spark, sf):
    return by_count(severity_distribution(_orders(spark, sf)), "severity")


@query(
    "wi8_point_lookup",
    "SELECT format('DEF-{:05d}', doc_id + 99801) AS defect_id, text AS raw_description FROM documents "
    "WHERE format('DEF-{:05d}', doc_id + 99801) = 'DEF-99842'",
)
def wi8(spark, sf):
    """The id is computed from the row number, so the lookup asks for the number: the equality
    reaches the scan, and no other table is read."""
    number = int("DEF-99842".removeprefix("DEF-")) - tb.FIRST_ID
    found = br.lookup(tb.table(spark, sf, "documents"), number, "doc_id")
    return found.select(rp.defect_id(F.col("doc_id") + tb.FIRST_ID).alias("defect_id"), F.col("text").alias("raw_description"))
