"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.llm import bpe, chat, decontam, impact, paragraphs, pii, quality, repair, shards, simhash, trie, urls, warc
from bugsieve.llm.common import table
from bugsieve.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, row_number() OVER w AS pos,
             string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>'
                        || chr(10), '') OVER w AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
n AS (SELECT conv_id, max(pos) AS n FROM p GROUP BY conv_id),
e AS (SELECT upto, pos, min(conv_id) AS conv_id, count(*) AS n_copies
      FROM p JOIN n USING (conv_id) WHERE pos = n GROUP BY upto, pos),
i AS (SELECT DISTINCT upto, pos FROM p JOIN n USING (conv_id) WHERE pos < n)
SELECT conv_id, pos AS n_turns, n_copies, upto AS rendered FROM e ANTI JOIN i ON e.upto = i.upto AND e.pos = i.pos
"""


@_query("op1_chat_snapshots", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.snapshots_collapsed(table(spark, sf_dir, "conversations"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS rep, 100 * n_symbols > 20 * n_words AS sym,
             n_words > 0 AND (word_chars / greatest(n_words, 1) < 1.5 OR word_chars / greatest(n_words, 1) > 20) AS len,
             100 * n_dup_lines > 50 * n_lines AS lin FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
       NOT (few OR rep OR sym OR len OR lin) AS kept,
       (CASE WHEN few THEN 1 ELSE 0 END + CASE WHEN rep THEN 2 ELSE 0 END + CASE WHEN sym THEN 4 ELSE 0 END
        + CASE WHEN len THEN 8 ELSE 0 END + CASE WHEN lin THEN 16 ELSE 0 END)::BIGINT AS fail_bits
FROM f
"""


@_query("op2_quality_rules", QUALITY_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"),
        quality.passes("v2").alias("kept"),
        "fail_bits",
    )


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, s, array_to_string(ws[i:i + s - 1], ' ') AS win
       FROM (SELECT item_id, ws, least(len(ws), 10) AS s, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i
             FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, s, array_to_string(ws[i:i + s - 1], ' ') AS win
       FROM (SELECT doc_id, ws, s, unnest(range(1, len(ws) - s + 2)) AS i
             FROM d, (SELECT DISTINCT s FROM bw) AS sizes WHERE len(ws) >= s)),
h AS (SELECT DISTINCT doc_id, i, dw.s AS s, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.s = bw.s),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS place FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(k.n, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@_query("op4_winnowing", DECONTAM_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op8_paragraph_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.occurrences(table(spark, sf_dir, "documents"))


URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


@_query("op9_url_trees")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model, URL_RULES)\
        .select("page_id", "host", "path", "rule", "verdict")


@_query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@_query("op3_crf_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), prefix="").select(
        "doc_id", "base", "spans", "counts"
    )
    return found.select(
        "doc_id",
        *[F.get("counts", F.lit(k)).alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERN_KINDS)],
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS o FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN o IS NULL OR o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


@_query("op5_warc_segments", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op6_histogram_sort")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op7_bpe_merge_replay")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


IMPACT_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op11_impact_search", IMPACT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


#: CRC-32 of the ASCII text ``{text}``, by the table ``crc.tab``.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)),
    lambda a, b: xor(crc.tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::BIGINT)"""
_CRC_TABLE = """
t(i, k, v) AS (SELECT r.i, 0, r.i::BIGINT FROM range(256) AS r(i) UNION ALL
               SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8)"""

REPAIR_SQL = (
    "WITH RECURSIVE"
    + _CRC_TABLE
    + """,
o AS (SELECT coalesce('=' || conv_id::VARCHAR, '') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             """
    + _CRC.format(text="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    + """ % 20 AS kind FROM conversations, crc),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM o, (VALUES (1), (2)) AS v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM d),
x AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
             row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS is_seen,
             NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut, role[1] AS ini,
             lag(role[1]) OVER (PARTITION BY key ORDER BY pos) AS before FROM w),
f AS (SELECT key, pos, role, text, turn, ini, before, is_blank, is_seen AND NOT is_blank AS is_dup,
             is_cut AND NOT is_blank AND NOT is_seen AS is_late FROM x),
ins(p, word, m) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3), (2, '', 2), (2, 'I', 3),
                           (3, '', 3), (3, 'I', 2)),
ed(m, letter, ini, cost, q) AS (VALUES (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3),
    (3, 'K', 'u', 0, 2), (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 2, 3), (3, 'R', NULL, 2, 2),
    (0, 'D', NULL, 3, 0), (1, 'D', NULL, 3, 1), (2, 'D', NULL, 3, 2), (3, 'D', NULL, 3, 3)),
dp AS (SELECT key, 0::BIGINT AS pos, 0 AS st, {'cost': 0, 'audit': ''} AS best FROM f GROUP BY key
       UNION ALL
       SELECT dp.key, f.pos, ed.q,
              min({'cost': dp.best.cost + 2 * len(ins.word)::INTEGER + ed.cost
                           + CASE WHEN f.is_late AND ed.letter <> 'D' THEN 1 ELSE 0 END,
                   'audit': dp.best.audit || ins.word || ed.letter})
       FROM dp JOIN f ON f.key = dp.key AND f.pos = dp.pos + 1 JOIN ins ON ins.p = dp.st JOIN ed ON ed.m = ins.m
       WHERE (ed.ini IS NULL OR ed.ini = f.ini) AND (ed.letter = 'D' OR NOT (f.is_blank OR f.is_dup))
       GROUP BY dp.key, f.pos, ed.q),
ends AS (SELECT dp.key, min({'cost': dp.best.cost + 2 * len(ins.word)::INTEGER, 'audit': dp.best.audit || ins.word}) AS best
         FROM dp JOIN (SELECT key, max(pos) AS n FROM f GROUP BY key) AS l ON l.key = dp.key AND l.n = dp.pos
         JOIN ins ON ins.p = dp.st WHERE ins.m IN (0, 3) GROUP BY dp.key),
letters AS (SELECT key, unnest(range(1, len(best.audit) + 1)) AS i, best.audit AS audit FROM ends),
steps AS (SELECT key, i, audit[i] AS letter, len(replace(audit[1:i], 'I', '')) AS pos FROM letters),
kept AS (SELECT s.key, s.i, s.letter, f.role, f.text FROM steps AS s LEFT JOIN f ON f.key = s.key AND f.pos = s.pos AND s.letter <> 'I'
         WHERE s.letter <> 'D'),
roles AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i)
                    - max(CASE WHEN letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS k FROM kept),
text AS (SELECT key, string_agg(CASE WHEN letter = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END
                                || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS body
         FROM roles GROUP BY key),
n AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
             count(*) FILTER (is_dup) AS duplicate, count(*) FILTER (is_late) AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM o) AS c LEFT JOIN n USING (key) LEFT JOIN ends USING (key) LEFT JOIN text USING (key)
"""
)


@_query("op12_repair_grammar", REPAIR_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


TRIE_SQL = (
    "WITH RECURSIVE"
    + _CRC_TABLE
    + """,
l AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                           ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, """
    + _CRC.format(text="conv_id::VARCHAR")
    + """ % 4 AS h FROM l, crc),
b AS (SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) AS said
      FROM h LEFT JOIN l AS f ON f.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, said[1:d] AS node, d, d = len(said) AS ends FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS d FROM b)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
             FILTER (ends), '') AS ends,
             (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(node[d].text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS gain
      FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)),
s AS (SELECT node[1:a] AS node, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(gain) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (node, d) LEFT JOIN m AS u ON m.d > 0 AND u.d = m.d - 1 AND u.node = m.node[1:m.d - 1]
"""
)


@_query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.with_ends(trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True))
