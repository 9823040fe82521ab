"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half the shingle hashes.  Fingerprints within
``radius`` bits link.  Each of the 64 bit positions carries a vector of ``radius + 1`` bits;
mask ``v`` keeps the positions whose vector has an odd product with ``v``.  Any ``radius``
positions leave some ``v`` orthogonal to all their vectors, so two fingerprints within the
radius agree under at least one of the ``2^(radius+1) - 1`` masks: no pair can be missed
(Pagh, Locality-sensitive hashing without false negatives, 2016).

Only distinct fingerprints are looked at, so copies cost nothing.  In a table's bucket of up
to ``bucket`` fingerprints the members are compared with each other.  The members of larger
buckets are linked through *centres* instead: two fingerprints differ in at most 2 bits
exactly when some 64-bit value is at most one bit from both.  A centre has at most 65 members
whatever the data, so no bucket, however hot, is compared pairwise, and nothing is cut off.

Cases: a null or empty text has no shingles and fingerprint zero, linked like any other; fewer
words than a shingle make one shingle of what there is.  Texts of any length are hashed whole
in bounded steps.  Repeated rows share a fingerprint.  A null id counts as larger than any other;
a component of null ids only has a null ``component_id``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.llm.common import free_name, text_batches
from bugsieve.operators.graph import component_labels
from bugsieve.session import cut_lineage

BITS = 64
_SEED = 42
_STEP = 1 << 16  # shingles whose bits are unfolded at a time


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        n, shingle = 1, len(words)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _STEP):
        hashes = np.fromiter(
            [digest(joined[a:b], _SEED) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP])], np.uint64
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` but the text, and the fingerprint as a signed 64-bit number."""
    text_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, name)]
    inner = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint_of(x.as_py(), shingle) for x in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(made.view(np.int64))], names=["_row", "_made"]
            )

    schema = inner.select("_row", F.lit(0).cast("long").alias("_made")).schema
    done = inner.mapInArrow(run, schema)
    return done.select(*[F.col("_row").getField(c).alias(c) for c in rest], F.col("_made").alias(name))


def masks(radius: int) -> list[int]:
    """The covering masks of a radius, as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + k % size for k in range(BITS)]
    made = [
        sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)
    ]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def _flips() -> list[int]:
    return [0, *[1 << k for k in range(BITS - 1)], -(1 << (BITS - 1))]


def links(points: DataFrame, radius: int = 2, bucket: int = 32) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all pairs within ``radius``.

    Every pair in a bucket of at most ``bucket`` gives its own edge.  Larger buckets give
    edges over centres, which connect the same fingerprints; that needs a radius of at most 2.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius))])
    placed = points.select("fp", F.explode(tables).alias("x")).select(
        "fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")
    )
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(placed.join(sizes, ["t", "key"]))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    small = (
        shared.filter(F.col("n") <= bucket)
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("a"), "fps")
        .select("a", F.explode(F.filter("fps", lambda y: (y > F.col("a")) & near(y, F.col("a")))).alias("b"))
    )
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return small.unionByName(_through_centres(hot, radius)).distinct()


def _through_centres(points: DataFrame, radius: int) -> DataFrame:
    if radius == 0:
        return points.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("false")
    flips = F.array(*[F.lit(f) for f in _flips()])
    around = points.select("fp", F.explode(flips).alias("f")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("centre")
    )
    if radius == 1:  # the neighbour itself is the centre
        return around.join(points.select(F.col("fp").alias("centre")), "centre").filter("fp <> centre").select(
            F.col("centre").alias("a"), F.col("fp").alias("b")
        )
    groups = around.groupBy("centre").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def components(marked: DataFrame, doc_id: str, fp: str, radius: int = 2, bucket: int = 32) -> DataFrame:
    """``(fp, label, component_id)`` of each distinct fingerprint: the smallest fingerprint and
    the smallest id of its component."""
    points = cut_lineage(
        marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first"))
    )
    edges = links(points.select("fp"), radius, bucket).select(F.lit(0).alias("level"), "a", "b")
    labels = component_labels(edges).select(F.col("id").alias("fp"), "label")
    placed = points.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    return placed.select("fp", "label").join(smallest, "label").select("fp", "label", "component_id")


def _marked(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``(doc_id, th, fp)``: id, a hash of the text that tells rows of one id apart, fingerprint."""
    columns = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("th")
    )
    return cut_lineage(fingerprints(columns, "text", shingle, "fp"))


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _join_by_fingerprint(marked: DataFrame, found: DataFrame) -> DataFrame:
    """Attach what is known of a fingerprint to every row.  One fingerprint may hold a third of
    all rows: rows are dealt by fingerprint and a salt, and the one row of each fingerprint is
    repeated for every salt."""
    salts = 16
    salted = marked.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(salts)).cast("int"))
    repeated = found.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return salted.join(repeated, ["fp", "_salt"]).drop("_salt")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, bucket: int = 32
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row; the fingerprint as 16 hex digits."""
    marked = _marked(docs, doc_id, text, shingle)
    found = components(marked, "doc_id", "fp", radius, bucket).select("fp", "component_id")
    return _join_by_fingerprint(marked, found).select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, bucket: int = 32
) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns.

    Of repeated rows one stays.  In a component of null ids only, one row stays as well.
    """
    marked = _marked(docs, doc_id, text, shingle)
    labels = components(marked, "doc_id", "fp", radius, bucket).select("fp", "label")
    rows = _join_by_fingerprint(marked, labels)
    winners = (
        rows.groupBy("label", "doc_id", "th")
        .agg(F.count("*").alias("n"))
        .groupBy("label")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col("th"), "n")).alias("w"))
    )
    a, b = free_name(docs, "_kept_id"), free_name(docs, "_kept_th")
    winners = cut_lineage(winners.select(F.col("w.doc_id").alias(a), F.col("w.th").alias(b), F.col("w.n").alias("_n")))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(a)) & (F.xxhash64(f"`{text}`") == F.col(b))
    kept = docs.join(winners.filter("_n = 1").select(a, b), same, "left_semi")
    repeats = winners.filter("_n > 1").select(a, b)
    if repeats.isEmpty():
        return kept
    several = docs.join(repeats, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.unionByName(several)
