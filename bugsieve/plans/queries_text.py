"""Queries over text operators and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from bugsieve.functions import completeness as cp
from bugsieve.functions import fixed_values as fv
from bugsieve.functions import text as tx
from bugsieve.operators import distributions as di
from bugsieve.operators import triage as tr
from bugsieve.plans import sql as S
from bugsieve.plans import testbed as tb
from bugsieve.operators.reports import report_fields, with_titles_and_sections
from bugsieve.plans.registry import query
from bugsieve.session import spread


@query("t1_extract_title", S.with_raw(f"SELECT defect_id, {S.title('raw_description')} AS title FROM raw"))
def t1(spark, sf):
    r = tb.raw_reports(spark, sf)
    return r.select("defect_id", tx.title_or_extracted(F.col("title"), F.col("raw_description")).alias("title"))


@query("t2a_combine_fields", S.with_records("SELECT defect_id, combined_text FROM described"))
def t2a(spark, sf):
    return tb.described(spark, sf).select("defect_id", "combined_text")


_SEVEN = "concat_ws(' ', nullif(title, ''), nullif(raw_description, ''), nullif(steps, ''), nullif(expected, ''), nullif(actual, ''), nullif(environment, ''), nullif(logs, ''))"


@query("t2b_query_text", S.with_records(f"SELECT defect_id, {_SEVEN} AS query_text FROM sectioned"))
def t2b(spark, sf):
    r = with_titles_and_sections(tb.raw_reports(spark, sf))
    parts = ("title", "raw_description", "steps", "expected", "actual", "environment", "logs")
    return r.select("defect_id", tx.combine_query_text(*[F.col(c) for c in parts]).alias("query_text"))


_FOUR = S.strip("concat_ws(' ', coalesce(title, ''), coalesce(raw_description, ''), coalesce(steps, ''), coalesce(actual, ''))")


@query("t2c_enhance_text", S.with_records(f"SELECT defect_id, {_FOUR} AS enhance_text FROM sectioned"))
def t2c(spark, sf):
    r = with_titles_and_sections(tb.raw_reports(spark, sf))
    parts = ("title", "raw_description", "steps", "actual")
    return r.select("defect_id", tx.combine_enhance_text(*[F.col(c) for c in parts]).alias("enhance_text"))


def _sql_clean(x: str) -> str:
    return f"trim(regexp_replace({S.mask(x)}, '[^a-zA-Z]+', ' ', 'g'))"


@query("t3_clean_reports", f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def t3(spark, sf):
    return spread(tb.table(spark, sf, "documents")).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(
    "t3_clean_pages",
    f"SELECT page_id, {_sql_clean('url')} AS url_text, {_sql_clean('html')} AS html_text FROM pages",
)
def t3_pages(spark, sf):
    return tb.table(spark, sf, "pages").select(
        "page_id", tx.clean(F.col("url")).alias("url_text"), tx.clean(F.col("html")).alias("html_text")
    )


@query(
    "t4_tokens_filtered",
    f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all({S.mask('text')}, '[a-z]{{3,}}'), "
    f"lambda t: t NOT IN ({S.words(fv.STOPWORDS)})), ' ') AS words FROM documents",
)
def t4(spark, sf):
    return spread(tb.table(spark, sf, "documents")).select(
        "doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("words")
    )


@query(
    "t5_normalize_lemmas",
    f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS normalized_text FROM documents",
)
def t5(spark, sf):
    return spread(tb.table(spark, sf, "documents")).select(
        "doc_id", tx.normalize(F.col("text")).alias("normalized_text")
    )


@query(
    "t6_extract_sections",
    S.with_records("SELECT defect_id, steps, expected, actual, environment, logs FROM sectioned"),
)
def t6(spark, sf):
    r = with_titles_and_sections(tb.raw_reports(spark, sf))
    return r.select("defect_id", *fv.SECTION_PATTERNS)


@query(
    "t7_first_sentences",
    f"SELECT doc_id, {S.sentences('text', 20)}[1] || '.' AS stored_sentence, "
    f"{S.sentences('text', 15)}[1] || '.' AS first_sentence, "
    f"{S.sentences('text', 15)}[2] || '.' AS second_sentence FROM documents",
)
def t7(spark, sf):
    def at(n: int, i: int):
        return F.concat(F.get(tx.sentences(F.col("text"), n), F.lit(i)), F.lit("."))

    return spread(tb.table(spark, sf, "documents")).select(
        "doc_id",
        at(20, 0).alias("stored_sentence"),
        at(15, 0).alias("first_sentence"),
        at(15, 1).alias("second_sentence"),
    )


@query(
    "t8_cluster_keywords",
    S.with_records(
        f"""SELECT cluster_id, array_to_string(list_filter(list_transform(list_filter(flatten(
              list(string_split_regex(title, '\\s+') ORDER BY length(defect_id), defect_id)),
              lambda w: length(w) > 3 AND lower(w) NOT IN ({S.words(fv.KEYWORD_STOPWORDS)}))[1:3],
              lambda w: regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')), lambda w: w <> ''), ',') AS keywords
            FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(defect_id), defect_id) AS m
                  FROM records WHERE cluster_id <> -1) WHERE m <= 5 GROUP BY cluster_id"""
    ),
)
def t8(spark, sf):
    return di.cluster_keywords(tb.records(spark, sf))


@query(
    "t9_vocabulary",
    S.with_records(
        "SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM described) GROUP BY token"
    ),
)
def t9(spark, sf):
    return di.vocabulary(tb.described(spark, sf))


@query(
    "t10_fold_severity",
    S.with_raw(f"SELECT defect_id, {S.fold('severity')} AS severity_group FROM raw"),
)
def t10(spark, sf):
    return tb.raw_reports(spark, sf).select(
        "defect_id", tx.fold_severity(F.col("severity")).alias("severity_group")
    )


def _sql_intent(x: str) -> str:
    rules = " ".join(
        "WHEN "
        + " OR ".join(
            "(" + " AND ".join(f"contains(lower({x}), '{w}')" for w in ws) + ")" for ws in alternatives
        )
        + f" THEN '{intent}'"
        for intent, alternatives in fv.INTENT_RULES
    )
    return f"CASE {rules} ELSE '{fv.INTENT_FALLBACK}' END"


_TERM = S.strip(f"regexp_replace(text, '(?i){fv.SEARCH_TERM_PATTERN}', '', 'g')")


#: One question for each intent, put before a turn's text.
QUESTIONS = [
    "show me every cluster", "which cluster is it", "what severity has", "a duplicate decision on", "how many are like",
    "cassandra reports on", "firefox reports on", "hadoop reports on", "spark reports on", "vscode reports on",
    "hbase reports on", "thunderbird reports on", "which dataset has", "find", "help with", "and",
]


@query(
    "t13_question_intent",
    f"SELECT conv_id, turn, {_sql_intent('text')} AS intent, {_TERM} AS search_term FROM (SELECT conv_id, turn, "
    f"[{S.words(QUESTIONS)}][(conv_id % 16 + 1)::INTEGER] || ' ' || text AS text FROM conversations)",
)
def t13(spark, sf):
    question = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), (F.col("conv_id") % 16).cast("int"))
    q = tb.table(spark, sf, "conversations").withColumn("text", F.concat(question, F.lit(" "), F.col("text")))
    return q.select(
        "conv_id", "turn",
        tx.question_intent(F.col("text")).alias("intent"),
        tx.search_term(F.col("text")).alias("search_term"),
    )


# --- completeness and enhancement ------------------------------------------------------


@query(
    "en1_missing_fields",
    S.with_records("SELECT defect_id, array_to_string(missing_fields, ',') AS missing FROM described"),
)
def en1(spark, sf):
    return tb.described(spark, sf).select("defect_id", F.array_join("missing_fields", ",").alias("missing"))


_DETAIL_VALUES = ", ".join(
    "(" + S.words([f, label, hint]) + ")" for f, label, hint in fv.REQUIRED_FIELDS
)


@query(
    "en2_missing_with_suggestions",
    S.with_records(
        f"SELECT m.defect_id, t.field, t.label, t.suggestion FROM (SELECT defect_id, "
        f"unnest(missing_fields) AS field FROM described) m JOIN (VALUES {_DETAIL_VALUES}) "
        "t(field, label, suggestion) USING (field)"
    ),
)
def en2(spark, sf):
    d = tb.described(spark, sf)
    return d.select("defect_id", F.inline(cp.missing_details(report_fields(d))))


@query("en3_stored_summary", S.with_records("SELECT defect_id, improved_summary FROM described"))
def en3(spark, sf):
    return tb.described(spark, sf).select("defect_id", "improved_summary")


def _in_sections(spark, sf):
    return with_titles_and_sections(tb.raw_reports(spark, sf))


_TITLE = f"CASE WHEN {S.is_missing('title')} THEN {S.title('raw_description')} ELSE title END"


@query(
    "en5_enhanced_title",
    S.with_records(
        f"SELECT defect_id, CASE WHEN starts_with({_TITLE}, '[ENHANCED]') THEN {_TITLE} "
        f"ELSE '[ENHANCED] ' || {_TITLE} END AS title FROM sectioned"
    ),
)
def en5(spark, sf):
    d = _in_sections(spark, sf)
    return d.select("defect_id", cp.enhanced_title(F.col("title"), F.col("raw_description")).alias("title"))


def sql_enhanced_summary(description: str, sections: bool = True) -> str:
    lead = (
        f"nullif(array_to_string(list_transform({S.sentences(description, 15)}[1:2], "
        "lambda s: s || '.'), ' | '), '')"
    )
    parts = [lead]
    if sections:
        parts += [
            "'Steps to reproduce: ' || substr(nullif(steps, ''), 1, 200)",
            "'Actual behavior: ' || substr(nullif(actual, ''), 1, 150)",
            "'Expected behavior: ' || substr(nullif(expected, ''), 1, 150)",
            "'Environment: ' || substr(nullif(environment, ''), 1, 100)",
        ]
    joined = f"concat_ws(' | ', {', '.join(parts)})"
    return f"coalesce(nullif({joined}, ''), substr({description}, 1, 300), '')"


@query(
    "en6_enhanced_summary",
    S.with_records(
        f"SELECT defect_id, {sql_enhanced_summary('raw_description')} AS summary FROM sectioned"
    ),
)
def en6(spark, sf):
    d = _in_sections(spark, sf)
    parts = ("raw_description", "steps", "actual", "expected", "environment")
    return d.select("defect_id", cp.enhanced_summary(*[F.col(c) for c in parts]).alias("summary"))


@query(
    "en8_accept_enhancement",
    f"""WITH forms AS (
          SELECT item_id AS report_id, substr(text, 1, 50) AS title, text AS description FROM benchmark)
        SELECT report_id, '[ENHANCED] ' || CASE WHEN {S.is_missing('title')} THEN {S.title('description')}
            ELSE title END AS title,
          {sql_enhanced_summary('description', sections=False)} AS description,
          'normal' AS severity FROM forms""",
)
def en8(spark, sf):
    b = tb.table(spark, sf, "benchmark")
    forms = b.select(
        F.col("item_id").alias("report_id"),
        F.substring("text", 1, 50).alias("title"),
        F.col("text").alias("description"),
        F.lit("Trivial").alias("severity"),
    )
    none = F.lit(None).cast("string")
    improved = forms.select(
        "report_id",
        cp.enhanced_title(F.col("title"), F.col("description")).alias("title"),
        cp.enhanced_summary(F.col("description"), none, none, none, none).alias("summary"),
        F.lit("Normal").alias("suggested_severity"),
    )
    return tr.accept_enhancement(forms, improved).select("report_id", "title", "description", "severity")


_ALL_FIELDS = "[" + S.words([f for f, _, _ in fv.REQUIRED_FIELDS]) + "]"


@query(
    "en9_present_and_missing",
    S.with_records(
        f"SELECT defect_id, array_to_string(missing_fields, ',') AS missing, array_to_string("
        f"list_filter({_ALL_FIELDS}, lambda f: NOT list_contains(missing_fields, f)), ',') AS present "
        "FROM described"
    ),
)
def en9(spark, sf):
    d = tb.described(spark, sf)
    return d.select(
        "defect_id",
        F.array_join("missing_fields", ",").alias("missing"),
        F.array_join(cp.present_fields(F.col("missing_fields")), ",").alias("present"),
    )
