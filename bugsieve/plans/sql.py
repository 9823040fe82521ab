"""SQL pieces of the checks: the same results stated for a SQL engine."""

from __future__ import annotations

from bugsieve.functions import fixed_values as fv


def words(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def strip(x: str) -> str:
    return f"trim({x}, '{fv.WHITESPACE}')"


def title(x: str) -> str:
    line = strip(f"split_part({strip(x)}, chr(10), 1)")
    bare = f"regexp_replace({line}, '(?i){fv.TITLE_PREFIX}', '')"
    return f"coalesce(nullif({bare}, ''), '{fv.UNTITLED}')"


def mask(x: str) -> str:
    out = f"lower({x})"
    for pattern, token in fv.CLEANING_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '{token}', 'g')"
    return out


def lemma(t: str) -> str:
    out = "CASE " + " ".join(
        f"WHEN {t} = '{k}' THEN '{v}'" for k, v in fv.LEMMA_EXCEPTIONS.items()
    )
    out += f" WHEN length({t}) < 4 THEN {t}"
    for suffix, new in fv.LEMMA_SUFFIXES:
        out += (
            f" WHEN ends_with({t}, '{suffix}') THEN "
            f"substr({t}, 1, length({t}) - {len(suffix)}) || '{new}'"
        )
    return out + f" ELSE {t} END"


def tokens(x: str) -> str:
    found = f"regexp_extract_all({mask(x)}, '[a-z]{{3,}}')"
    kept = f"list_filter({found}, lambda t: t NOT IN ({words(fv.STOPWORDS)}))"
    return f"list_transform({kept}, lambda t: {lemma('t')})"


def section(x: str, name: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({x}, '(?i)(?:{p})') THEN regexp_extract({x}, '(?is)(?:{p})(.*)$', 1)"
        for p in fv.SECTION_PATTERNS[name]
    )
    body = f"string_split_regex(CASE {cases} END, '(?i){fv.NEXT_HEADER}')[1]"
    return f"coalesce({strip(body)}, '')"


def by_id(x: str = "defect_id") -> str:
    """Order of ids by their numbers."""
    return f"length({x}), {x}"


def is_missing(x: str) -> str:
    return f"coalesce(length({strip(x)}) < 5, true)"


def missing_list(fields: dict[str, str]) -> str:
    items = ", ".join(
        f"CASE WHEN {is_missing(fields[f])} THEN '{f}' END" for f, _, _ in fv.REQUIRED_FIELDS
    )
    return f"list_filter([{items}], lambda f: f IS NOT NULL)"


def sentences(x: str, n: int) -> str:
    pieces = f"list_transform(string_split({x}, '.'), lambda s: {strip('s')})"
    return f"list_filter({pieces}, lambda s: length(s) > {n})"


def fold(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SEVERITY_FOLD.items())
    return f"coalesce(CASE lower({x}) {cases} END, nullif({x}, ''), 'Unknown')"


def bucket(x: str) -> str:
    def half(at: int) -> str:
        return f"(('0x' || substr(md5({x}), {at}, 16))::UBIGINT % 100)"

    return f"CAST(({half(1)} * 16 + {half(17)}) % 100 AS INTEGER)"


def placeholder(x: str) -> str:
    b = bucket(x)
    return (
        f"CASE WHEN {b} < 18 THEN 'duplicate' WHEN {b} < 42 THEN 'possible_duplicate' "
        "ELSE 'new_defect' END"
    )


def decision(x: str) -> str:
    return (
        f"CASE WHEN {x} >= {fv.DUPLICATE_THRESHOLD} THEN 'duplicate' "
        f"WHEN {x} >= {fv.POSSIBLE_DUPLICATE_THRESHOLD} THEN 'possible_duplicate' "
        "ELSE 'new_defect' END"
    )


HEADERS = [
    "Steps to reproduce", "STM", "Reproduction steps", "How to reproduce", "Expected behavior", "Should display",
    "Actual outcome", "What happened", "Instead", "Environment", "Platform", "OS version", "Browser version",
    "System info", "Build ID", "User agent", "Log file", "Stack trace", "Error message", "Traceback", "Console output",
]
RAW = f"""raw AS (
  SELECT format('DEF-{{:05d}}', d.doc_id + 99801) AS defect_id,
    CASE WHEN d.doc_id % 24 < 21 THEN substr(d.text, 1, length(d.text) // 2) || chr(10)
      || [{words(HEADERS)}][(d.doc_id % 24 + 1)::INTEGER] || ': ' || substr(d.text, length(d.text) // 2 + 1)
      ELSE d.text END AS raw_description,
    CASE WHEN l.toxic = 1 THEN 'critical' WHEN l.quality = 1 THEN 'normal'
         WHEN l.quality = 0 THEN 'minor' END AS severity,
    l.quality AS fix_label,
    CASE WHEN d.lang = 'fr' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END AS cluster_id,
    d.source AS project
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_D = "raw_description"
SECTIONED = (
    f"sectioned AS (SELECT *, {title(_D)} AS title, "
    + ", ".join(f"{section(_D, s)} AS {s}" for s in fv.SECTION_PATTERNS)
    + " FROM raw)"
)


def _joined(separator: str, parts: list[str]) -> str:
    return f"concat_ws('{separator}', {', '.join(parts)})"


_COMBINED = _joined(
    " . ", [f"nullif({strip(c)}, '')" for c in ("title", _D, "steps", "actual")]
)
COMBINED = f"combined AS (SELECT *, {_COMBINED} AS combined_text FROM sectioned)"
TOKENS = f"tokenized AS MATERIALIZED (SELECT *, {tokens('combined_text')} AS tokens FROM combined)"
NORMALIZED = (
    "normalized AS (SELECT *, coalesce(array_to_string(tokens, ' '), '') AS normalized_text"
    " FROM tokenized)"
)
_FIELDS = {f: (_D if f == "description" else f) for f, _, _ in fv.REQUIRED_FIELDS}
_SUMMARY = (
    "coalesce(nullif("
    + _joined(
        " | ",
        [
            f"'**' || CASE WHEN title <> '{fv.UNTITLED}' THEN title END || '**'",
            "'Severity: ' || severity",
            f"substr({sentences(_D, 20)}[1], 1, 200) || '.'",
            "'Steps: ' || substr(nullif(steps, ''), 1, 150)",
            "'Expected: ' || substr(nullif(expected, ''), 1, 100)",
            "'Actual: ' || substr(nullif(actual, ''), 1, 100)",
        ],
    )
    + ", ''), 'No summary available')"
)
DESCRIBED = (
    f"described AS (SELECT *, {missing_list(_FIELDS)} AS missing_fields, "
    f"{_SUMMARY} AS improved_summary FROM normalized WHERE length(normalized_text) > "
    f"{fv.MIN_NORMALIZED_CHARS})"
)


def preview(c: str) -> str:
    return f"{strip(f'substr({c}, 1, {fv.PREVIEW_CHARS[c]})')} AS {c}_preview"


RECORDS = f"records AS MATERIALIZED (SELECT *, {placeholder('defect_id')} AS decision FROM described)"
VECTORS = """vectors AS (
  SELECT format('DEF-{:05d}', vec_id + 99801) AS defect_id, embedding::DOUBLE[] AS vector,
    label AS cluster_id FROM embeddings)"""
CLUSTERED = """mixed AS (
  SELECT e.vec_id, e.label, list_transform(range(1, len(e.embedding) + 1), lambda i: CASE WHEN e.label < 7
    THEN a.embedding[i]::DOUBLE + (0.5::DOUBLE + (e.vec_id % 5) * 0.2::DOUBLE) * e.embedding[i]::DOUBLE
    ELSE e.embedding[i]::DOUBLE END) AS v FROM embeddings e JOIN embeddings a ON a.vec_id = e.label),
vectors AS MATERIALIZED (
  SELECT format('DEF-{:05d}', vec_id + 99801) AS defect_id, label AS cluster_id,
    list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vector FROM mixed)"""
VECTOR_QUERIES = """wobbled AS (
  SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x, i: x * (1 +
    CASE WHEN label < 4 THEN 0.3::DOUBLE WHEN label < 7 THEN 1.2::DOUBLE ELSE 3.0::DOUBLE END
    * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) AS v FROM embeddings),
queries AS (
  SELECT query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))
    AS vector FROM wobbled)"""

_CHAIN = [RAW, SECTIONED, COMBINED, TOKENS, NORMALIZED, DESCRIBED, RECORDS]


def with_records(body: str, *more: str) -> str:
    """A query over the derived report tables."""
    return "WITH " + ",\n".join([*_CHAIN, *more]) + "\n" + body


def with_raw(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([RAW, *more]) + "\n" + body


def with_vectors(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([VECTORS, VECTOR_QUERIES, *more]) + "\n" + body


def top_matches(k: int, queries: str = "queries", corpus: str = "vectors") -> str:
    return f"""scored AS (
  SELECT q.query_id, v.defect_id, round(list_dot_product(q.vector, v.vector), 9) AS score
  FROM {queries} q CROSS JOIN {corpus} v),
matches AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(defect_id), defect_id) AS INTEGER)
    AS rank FROM scored QUALIFY rank <= {k})"""


# --- TF-IDF stated relationally --------------------------------------------------------

TFIDF = """tf AS MATERIALIZED (
  SELECT defect_id, token, count(*) AS n
  FROM (SELECT defect_id, unnest(tokens) AS token FROM described) GROUP BY ALL),
vocabulary AS (
  SELECT token, sum(n) AS total, count(*) AS df FROM tf GROUP BY token),
idf AS (
  SELECT token, ln(((SELECT count(*) FROM described) + 1.0::DOUBLE) / (df + 1)) AS idf FROM vocabulary),
weights AS (SELECT defect_id, token, n * idf AS w FROM tf JOIN idf USING (token)),
lengths AS (SELECT defect_id, sqrt(sum(w * w)) AS length FROM weights GROUP BY defect_id),
units AS MATERIALIZED (
  SELECT defect_id, token, w / length AS w FROM weights JOIN lengths USING (defect_id)
  WHERE length > 0 AND w <> 0)"""


def ranked_pairs(t: float, k: int, pairs: str) -> str:
    return f"""ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(defect_id), defect_id)
      AS INTEGER) AS rank FROM ({pairs}) WHERE score >= {t} QUALIFY rank <= {k})"""


DENSE_PAIRS = """SELECT a.defect_id AS query_id, b.defect_id, round(list_dot_product(a.vector, b.vector), 9) AS score
  FROM vectors a JOIN vectors b ON a.defect_id <> b.defect_id"""
TEXT_PAIRS = """SELECT a.defect_id AS query_id, b.defect_id, round(sum(a.w * b.w), 9) AS score
  FROM units a JOIN units b ON a.token = b.token AND a.defect_id <> b.defect_id GROUP BY ALL"""


def text_queries(source: str) -> str:
    """Unit vectors of ``source(query_id, text)`` under the fitted encoder."""
    return f"""q_tf AS (
  SELECT query_id, token, count(*) AS n
  FROM (SELECT query_id, unnest({tokens('text')}) AS token FROM ({source})) GROUP BY ALL),
q_weights AS (SELECT query_id, token, n * idf AS w FROM q_tf JOIN idf USING (token)),
q_lengths AS (SELECT query_id, sqrt(sum(w * w)) AS length FROM q_weights GROUP BY query_id),
q_units AS MATERIALIZED (
  SELECT query_id, token, w / length AS w FROM q_weights JOIN q_lengths USING (query_id)
  WHERE length > 0)"""


def text_matches(source: str, k: int) -> str:
    """Ranked matches of every query of ``source`` against all valid reports."""
    return f"""{text_queries(source)},
hits AS (
  SELECT q.query_id, u.defect_id, sum(q.w * u.w) AS score
  FROM q_units q JOIN units u USING (token) GROUP BY ALL),
scored AS (
  SELECT q.query_id, d.defect_id, round(coalesce(h.score, 0.0), 9) AS score
  FROM ({source}) q CROSS JOIN described d
  LEFT JOIN hits h ON h.query_id = q.query_id AND h.defect_id = d.defect_id),
matches AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(defect_id), defect_id) AS INTEGER)
    AS rank FROM scored QUALIFY rank <= {k})"""


def with_decided(body: str) -> str:
    """A query over ``decided_records``: the stored reports with their decisions."""
    judged = f"""decided_records AS (
      SELECT d.*, {decision('coalesce(r.score, 0)')} AS decision, round(coalesce(r.score, 0.0), 4) AS confidence
      FROM described d LEFT JOIN ranked r ON r.query_id = d.defect_id)"""
    return with_records(body, TFIDF, ranked_pairs(fv.POSSIBLE_DUPLICATE_THRESHOLD, 1, TEXT_PAIRS), judged)


INCOMING = """incoming AS (
  SELECT printf('C-%d-%d', conv_id, turn) AS report_id, substr(text, 1, 50) AS title,
    text AS description FROM conversations)"""
