"""Benchmark decontamination by winnowing.

A *window* of a benchmark item is ``window`` (10) consecutive words; an item of fewer words is
one window by itself.  Of every ``window - gram + 1`` consecutive k-gram hashes of a text the
smallest is kept as a fingerprint (Schleimer, Wilkerson and Aiken, Winnowing, 2003), so any
shared span of ``window`` words shares a fingerprint: none can be missed.  Document and item
fingerprints are joined, and each hit is extended word by word to both sides, as far as a
window that holds the k-gram can reach; the words of extended runs of ``window`` words are hit.
Hashes only find candidates, words decide.

Items shorter than a window get their own length as gram and span (every gram is kept).

Plan: texts are cut into overlapping chunks of bounded length, so a very long text is many
rows.  The benchmark's fingerprints are measured and cut into blocks;
each block, of some ``block_bytes``, is broadcast to one pass over the documents, which are not shuffled.  Only hits
travel: one row per document and matched span.

Cases: null and empty texts have no words, are never contaminated, and an item of them has no
window.  Repeated documents each get their row; repeated items each count.  Rows of one id with
different texts are told apart by a hash of the text.  A null item id hits but is not counted.
Empty tables give no hits.  Other columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.functions.text import let
from bugsieve.llm.common import lower_ascii
from bugsieve.session import cut_lineage

WINDOW = 10
GRAM = 5
#: What stands between words while A-Z are still in the text.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POSITION_BITS = 12
CHUNK = 1 << (_POSITION_BITS - 1)  # words a chunk adds; with its overlap a position fits the bits
BLOCK_BYTES = 16 << 20


def words(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII, with A-Z in lower case."""

    def bare(split: Column) -> Column:
        first = F.when(F.get(split, F.lit(0)) == "", 2).otherwise(1)
        return F.slice(split, first, _count(split))

    # Most words have no capital letter and stay as they are.
    lowered = lambda w: F.when(w == F.lower(w), w).otherwise(lower_ascii(w))
    return F.transform(let(F.split(F.coalesce(text, F.lit("")), _BREAKS), bare), lowered)


def n_words(text: Column) -> Column:
    """How many words a text has."""
    return let(F.split(F.coalesce(text, F.lit("")), _BREAKS), _count).cast("long")


def _count(split: Column) -> Column:
    """Parts of a split text without an empty first and last one."""
    n = F.size(split)
    outer = F.when(F.get(split, F.lit(0)) == "", 1).otherwise(0) + F.when(F.get(split, n - 1) == "", 1).otherwise(0)
    return F.greatest(n - outer, F.lit(0))


def _fingerprints(ws: Column, gram: int, window: int) -> Column:
    """Kept grams as ``hash bits | position``: of each span of ``window`` words the smallest.

    Hash and position share one number, so that the smallest number is the smallest hash and,
    among equal ones, the first.
    """
    span = window - gram + 1
    low = (1 << _POSITION_BITS) - 1

    def kept(grams: Column) -> Column:
        if span == 1:
            return grams
        n = F.size(grams)
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))),
                lambda i: F.least(*[F.get(grams, i + k) for k in range(span)]),
            )
        )

    grams = F.transform(
        F.sequence(F.lit(0), F.size(ws) - gram),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(gram)])
        .bitwiseAND(F.lit(~low))
        .bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(ws) >= window, let(grams, kept)).otherwise(F.array().cast("array<bigint>"))


def _around(ws: Column, at: Column, gram: int, window: int) -> Column:
    """The words of all windows that hold the gram at ``at``."""
    reach = window - gram
    start = F.greatest(at - reach, F.lit(0))
    return F.struct(
        start.cast("int").alias("start"), F.slice(ws, (start + 1).cast("int"), (at + gram + reach - start).cast("int")).alias("ws")
    )


def _spotted(rows: DataFrame, keys: list[str], gram: int, window: int) -> DataFrame:
    """``keys``, ``gram_key``, ``base`` (first word of ``ws`` in the text) and ``ws`` around each fingerprint."""
    low = (1 << _POSITION_BITS) - 1
    overlap = window - 1
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = F.transform(
        starts, lambda s: F.struct(s.alias("base"), F.slice(F.col("ws"), s + 1, F.lit(CHUNK + overlap)).alias("ws"))
    )
    cut = rows.select(*keys, F.explode(chunks).alias("c")).select(*keys, F.col("c.base").alias("base"), F.col("c.ws").alias("ws"))
    found = F.transform(
        _fingerprints(F.col("ws"), gram, window),
        lambda x: F.struct(
            F.shiftright(x, _POSITION_BITS).alias("gram_key"),
            x.bitwiseAND(F.lit(low)).cast("int").alias("at"),
            _around(F.col("ws"), x.bitwiseAND(F.lit(low)), gram, window).alias("near"),
        ),
    )
    return cut.select(*keys, "base", F.explode(found).alias("f")).select(
        *keys,
        F.col("f.gram_key").alias("gram_key"),
        (F.col("base") + F.col("f.near.start")).alias("base"),
        (F.col("f.at") - F.col("f.near.start")).alias("offset"),
        F.col("f.near.ws").alias("ws"),
    )


def _extended(doc_ws: Column, doc_at: Column, item_ws: Column, item_at: Column, gram: int, window: int) -> Column:
    """Starts, in ``doc_ws``, of the windows around the grams at ``doc_at`` and ``item_at`` that agree."""
    shift = item_at - doc_at
    reach = window - gram
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: doc_at - reach + k),
        lambda s: (s >= 0)
        & (s + shift >= 0)
        & (s + window <= F.size(doc_ws))
        & (s + shift + window <= F.size(item_ws))
        & (F.slice(doc_ws, F.greatest(s, F.lit(0)) + 1, F.lit(window)) == F.slice(item_ws, F.greatest(s + shift, F.lit(0)) + 1, F.lit(window))),
    )


def matched_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, th, start, size, item_text)``: spans of each document that are windows of an item text.

    ``docs`` has ``(doc_id, th, ws)``, ``items`` has ``(item_text, ws)`` with distinct texts.
    """
    sized = items.withColumn("size", F.least(F.size("ws"), F.lit(window))).filter("size > 0")
    spans = sorted(r["size"] for r in sized.select("size").distinct().collect())  # at most ``window`` numbers
    parts = []
    for size in spans:
        own = gram if size == window else size
        prints = cut_lineage(_spotted(sized.filter(F.col("size") == size), ["item_text"], own, size))
        volume = prints.agg(F.sum(F.length(F.array_join("ws", " ")) + 64)).head()[0] or 0
        blocks = -(-volume // block_bytes)
        theirs = prints.select(
            "item_text",
            "gram_key",
            F.col("offset").alias("i_at"),
            F.col("ws").alias("i_ws"),
            F.pmod(F.xxhash64("item_text", "gram_key", "base"), F.lit(max(blocks, 1))).alias("_block"),
        )
        ours = _spotted(docs, ["doc_id", "th"], own, size)
        for b in range(blocks):
            hits = ours.join(F.broadcast(theirs.filter(F.col("_block") == b).drop("_block")), "gram_key")
            starts = _extended(F.col("ws"), F.col("offset"), F.col("i_ws"), F.col("i_at"), own, size)
            parts.append(
                hits.select(
                    "doc_id", "th", "item_text", F.lit(size).alias("size"), "base", F.explode(starts).alias("s")
                ).select("doc_id", "th", (F.col("base") + F.col("s")).alias("start"), "size", "item_text")
            )
    if not parts:
        return docs.select(
            "doc_id", "th", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("item_text")
        ).filter("false")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _covered(spans: Column) -> Column:
    """Words under the union of ``(start, end)`` spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, th, ws)``: id, a hash of the text that tells rows of one id apart, words."""
    column = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(column).alias("th"), words(column).alias("ws"))


def hits(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, th, n_hit, item_ids)`` of the documents that are hit; ``th`` hashes the text."""
    own = _named(docs, doc_id, text)
    listed = items.select(F.col(f"`{item_id}`").alias("item_id"), words(F.col(f"`{item_text}`")).alias("ws"))
    # Items of equal words are one text; the documents meet the text, the ids come back last.
    texts = cut_lineage(
        listed.select("ws").distinct().withColumn("item_text", F.monotonically_increasing_id())
    )
    named = listed.filter("item_id IS NOT NULL").join(texts, "ws").select("item_text", "item_id").distinct()
    spans = cut_lineage(matched_spans(own, texts, window, gram, block_bytes).distinct())
    covered = (
        spans.groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"))
        .select("doc_id", "th", _covered(F.col("spans")).alias("n_hit"))
    )
    ids = (
        spans.select("doc_id", "th", "item_text").distinct()
        .join(named, "item_text")
        .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    none = F.array().cast("array<string>")
    return covered.join(ids, same, "left").select(
        "doc_id", "th", "n_hit", F.coalesce("item_ids", none).alias("item_ids")
    )


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids)`` for every document."""
    found = hits(docs, items, doc_id, text, **more).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_hit", "item_ids"
    )
    every = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.xxhash64(f"`{text}`").alias("th"),
        n_words(F.col(f"`{text}`")).alias("n_words"),
    )
    joined = every.join(found, every["doc_id"].eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


#: Up to so many hit documents are sent to the others instead of sorting all texts by id.
FEW_HIT = 100_000


def clean(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents no window of the benchmark occurs in, with the columns they came with."""
    texts = items.select(words(F.col(f"`{item_text}`")).alias("ws")).distinct().withColumn("item_text", F.lit(0).cast("long"))
    spans = matched_spans(_named(docs, doc_id, text), cut_lineage(texts), window, gram, block_bytes)
    found = cut_lineage(spans.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct())
    few = found.count() <= FEW_HIT
    mine = docs.alias("d")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("h._id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("h._th"))
    return mine.join((F.broadcast(found) if few else found).alias("h"), same, "left_anti")
