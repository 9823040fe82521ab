"""Repeated passages: paragraphs compared by MinHash bands and exact Jaccard similarity.

A sentence of at least ``least_words`` words is a paragraph.  Shorter sentences in a row, and lines
without sentences (lists, verse), are cut where the words decide: after a word whose hash is the
least among the ``AROUND`` on either side, once ``least_words`` are together.  So two texts fall into
step within a shared passage, whatever stands before it and however its lines are wrapped.  Only
a line that has ``least_words`` words itself and is parted from the next within a sentence keeps its
end as a boundary.  Fewer words left over before a long sentence go to the paragraph before it
(or, where there is none or they are too few to matter, to the sentence); left over before such a
boundary, or at the end, they are no paragraph.

The cuts are no guarantee: some passages of 50 to 100 words have no paragraph in common with
their copies (the README has figures), nor have texts wrapped at different widths of
``least_words`` words or more.

* Exact copies are one class from the start; everything below sees distinct paragraphs.
* Signatures of five-word shingles are cut into bands, as many as ``bands_for`` says the wanted
  recall needs at the similarity asked for.
* In each bucket of equal bands a paragraph meets the first of the bucket and the ``reach`` before
  it.  So a bucket of up to ``reach + 2`` gives all its pairs, and a larger one a number of pairs
  in proportion to its size: its members lie in order of their next two bands, so a paragraph
  meets those most like it, others in every band, and what is alike connects through many paths.
* Pairs are verified by the exact Jaccard similarity of their shingle sets (of 32-bit hashes).
* In a larger bucket whose members these pairs do not connect to one component, all members of
  different components are compared too, in blocks of bounded size.  So no link within a bucket
  is lost, whatever its size; two paragraphs that are in one component already need no comparison.
* Connected paragraphs form a class.  Its first occurrence, by document id and place, stays; the
  others are removed.

Cases: a null or empty text has no paragraphs.  A paragraph of any length is taken whole; fewer
words than a shingle make one shingle.  Repeated rows are occurrences like any other (ties at the
first place: each equal row stays).  Null ids come after all others.  Extra columns are ignored by
``occurrences`` and kept by ``without_repeats``.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugsieve.llm.common import BLANKS, text_batches
from bugsieve.operators import cells as ce
from bugsieve.operators import kernels as kn
from bugsieve.operators.graph import component_labels
from bugsieve.session import cut_lineage, scratch_path

LEAST_WORDS = 16
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
REACH = 8
AROUND = 8
_GATHERED = 1 << 22  # shingles looked up at once
_BLOCK_SHINGLES = 1 << 22  # that a block of members may have

_BREAK = re.compile(r"[.!?]+(?=[\x20\x09-\x0D])|\n(?=[\x20\x09\x0B-\x0D]*+\n)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 24) -> tuple[int, int]:
    """``(bands, rows)``: the most rows a band for which the recall is met within that many hashes."""
    for rows in range(8, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


def _words(piece: str) -> list[bytes]:
    return piece.encode("utf-8", "surrogatepass").lower().split()


def _sections(text: str, least_words: int) -> Iterator[tuple[int, int]]:
    """Runs of lines that are read as one: a line of ``least_words`` words is parted from its
    neighbours where no sentence ends between them, other line ends are blanks like any other."""
    start = at = 0
    long_before = False
    for line in text.split("\n"):
        long = len(_words(line)) >= least_words
        if (long or long_before) and not text[start:at].rstrip(BLANKS).endswith((".", "!", "?")):
            yield start, at
            start = at
        long_before = long
        at = min(at + len(line) + 1, len(text))
    yield start, at


def _pieces(text: str, start: int, stop: int, least_words: int) -> Iterator[tuple[int, int]]:
    """Pieces of at least ``least_words`` words of a run of short sentences, cut after words whose
    hash is the least of their surroundings; fewer words at the end are in none."""
    places = [m.end() for m in _WORD.finditer(text, start, stop)]
    last = 0
    if len(places) > 2 * AROUND:
        h = np.fromiter(map(xxhash.xxh64_intdigest, _words(text[start:stop])), np.uint64, len(places))
        least = np.lib.stride_tricks.sliding_window_view(h, 2 * AROUND + 1).argmin(1) == AROUND
        for k in (np.nonzero(least)[0] + AROUND + 1).tolist():
            if k - last >= least_words:
                yield start, places[k - 1]
                start, last = places[k - 1], k
    if len(places) - last >= least_words:
        yield start, stop


def paragraphs_of(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, list[bytes]]]:
    """Start, end (code points) and words, A-Z in lower case, of each paragraph."""
    found: list[tuple[int, int]] = []
    for start, stop in _sections(text, least_words):
        at = start
        for end in [*(m.end() for m in _BREAK.finditer(text, start, stop)), stop]:
            n = len(_words(text[at:end]))
            if n < least_words or n >= 3 * least_words and "\n" in text[at:end].strip(BLANKS):
                at = end  # short, or lines without sentences
                continue
            found += _pieces(text, start, at, least_words)
            if found and found[-1][1] > start:
                start = found[-1][1]
                # Few words in front leave a sentence alike to itself; more go to the piece before.
                if 8 * len(_words(text[start:at])) > n - SHINGLE + 1:
                    found[-1] = found[-1][0], at
                    start = at
            found.append((start, end))
            start = at = end
        found += _pieces(text, start, stop, least_words)
    for start, end in found:
        piece = text[start:end]
        yield start + len(piece) - len(piece.lstrip(BLANKS)), start + len(piece.rstrip(BLANKS)), _words(piece)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(words: list[bytes], counts: list[int], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit hashes of the shingles of each paragraph, and where each begins.

    ``words`` holds the words of all paragraphs, ``counts`` how many each has.
    """
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sizes = np.array(counts, np.int64)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # words from here to the paragraph's end
    # A paragraph shorter than a shingle is one shingle of all its words.
    reach = np.minimum(np.repeat(sizes, sizes), shingle)
    total = reach.astype(np.uint64)
    for k in range(shingle):
        ahead = np.append(h[k:], np.zeros(min(k, len(h)), np.uint64))
        total = np.where(k < reach, _mixed(total + ahead), total)
    keys = np.unique(unit[left >= reach].astype(np.uint64) << np.uint64(32) | total[left >= reach] >> np.uint64(32))
    found = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(sizes))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate([[0], np.cumsum(found)])


_UNIT = "start int, stop int, n_words int, h1 long, h2 long, shingles array<int>"


def _units(docs: DataFrame, doc_id: str, text: str, least_words: int, shingle: int) -> DataFrame:
    """One row per paragraph: its document, place, 128-bit hash and shingles."""
    text_batches(docs.sparkSession)
    inner = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes, all_words = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                for start, stop, words in paragraphs_of(text.as_py() or "", least_words):
                    rows.append(k)
                    places.append((start, stop, len(words)))
                    hashes.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    all_words += words
            table = np.array(places, np.int32).reshape(-1, 3)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            flat, offsets = _shingles(all_words, table[:, 2].tolist(), shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *[pa.array(table[:, i]) for i in range(3)],
                    *[pa.array(np.ascontiguousarray(halves[:, i])) for i in range(2)],
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int32))),
                ],
                names=["doc_id", "start", "stop", "n_words", "h1", "h2", "shingles"],
            )

    kind = inner.schema["doc_id"].dataType.simpleString()
    return inner.mapInArrow(run, f"doc_id {kind}, {_UNIT}")


def _first_of_each(h1: np.ndarray) -> np.ndarray:
    """Row numbers of the first row of each value: copies within a batch travel once."""
    return np.sort(np.unique(h1, return_index=True)[1])


def _banded(units: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(key, h1)`` per paragraph and band; copies within a batch once.

    The upper 48 bits of a key are the band.  The lower ones hint at the next two bands, so that
    in order of keys the members of a bucket that are most alike lie together.
    """
    steps = np.random.default_rng(17)
    factors = steps.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    shifts = steps.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(_first_of_each(batch.column(0).to_numpy())))
            if not batch.num_rows:
                continue
            h1 = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
            offsets = lists.offsets.to_numpy()
            starts = (offsets - offsets[0])[:-1]
            made = []
            for b in range(bands):
                key = np.full(len(h1), b + 1, np.uint64)
                for r in range(b * rows, (b + 1) * rows):
                    least = np.minimum.reduceat((flat * factors[r] + shifts[r]) >> np.uint64(32), starts)
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
                made.append(key)
            byte = np.uint64(255)
            keys = [
                key >> np.uint64(16) << np.uint64(16)
                | (made[(b + 1) % bands] & byte) << np.uint64(8)
                | made[(b + 2) % bands] & byte
                for b, key in enumerate(made)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(h1, bands))], names=["key", "h1"]
            )

    return units.select("h1", "shingles").mapInArrow(run, "key long, h1 long")


def _distinct(units: DataFrame) -> DataFrame:
    """``(h1, shingles)``, copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_first_of_each(batch.column(0).to_numpy())))

    rows = units.select("h1", "shingles")
    return rows.mapInArrow(run, rows.schema)


def _meetings(ordered: DataFrame, reach: int) -> DataFrame:
    """``(a, b, bucket)``: pairs met in buckets, each paragraph with the first of its bucket and the
    ``reach`` before it; and, without ``b``, the members of buckets this leaves pairs out of.
    ``ordered`` has whole buckets in a partition, in order of key and hash."""
    whole = reach + 2  # members of a bucket that all meet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, hashes, leaders, places = (np.zeros(0, np.int64) for _ in range(4))  # the last rows seen
        for batch in batches:
            h = batch.column(1).to_numpy()
            band = batch.column(0).to_numpy() >> 16
            new = np.append(True, (h[1:] != h[:-1]) | (band[1:] != band[:-1]))
            if len(h) and len(hashes) and (h[0], band[0]) == (hashes[-1], bands[-1]):
                new[0] = False
            h, band = h[new], band[new]
            old = len(hashes)
            band, h = np.append(bands, band), np.append(hashes, h)
            if len(h) == old:
                continue
            begins = np.append(True, band[1:] != band[:-1])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
            leader, place = h[first], np.arange(len(h)) - first
            if old:  # the first row kept may stand in the middle of its bucket
                leader[band == band[0]] = leaders[0]
                place[band == band[0]] += places[0]
            pairs = [(h[old:], leader[old:])]
            for k in range(1, reach + 1):
                late = np.arange(max(old, k), len(h))
                late = late[band[late] == band[late - k]]
                pairs.append((h[late], h[late - k]))
            x, y = (np.concatenate(side) for side in zip(*pairs))
            differ = x != y
            made = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, differ], axis=1)
            over = np.flatnonzero(place[old:] >= whole) + old
            before = over[place[over] == whole][:, None] + np.arange(-whole, 0)
            over = np.append(over, before.ravel())
            none = np.zeros(len(over), np.int64)
            met = np.repeat([True, False], [made.shape[1], len(over)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(made[0], h[over])),
                    pa.array(np.append(made[1], none), mask=~met),
                    pa.array(np.append(np.zeros(made.shape[1], np.int64), band[over]), mask=met),
                ],
                names=["a", "b", "bucket"],
            )
            bands, hashes, leaders, places = (rows[-whole:] for rows in (band, h, leader, place))

    return ordered.mapInArrow(run, "a long, b long, bucket long")


def _shared_counts(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """How many shingles each row of ``x`` has in common with each row of ``y``."""
    (a, of_a), (b, of_b) = (
        (kn.numbers(side.flatten()), np.repeat(np.arange(len(side)), kn.numbers(side.value_lengths()))) for side in (x, y)
    )
    order = np.argsort(b, kind="stable")
    b, of_b = b[order], of_b[order]
    lo = np.searchsorted(b, a, side="left")
    sizes = np.searchsorted(b, a, side="right") - lo
    ends = np.cumsum(sizes)
    out = np.zeros(len(x) * len(y), np.int64)
    first = 0
    while first < len(a):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _GATHERED, side="right")))
        size = sizes[first:last]
        at = np.arange(size.sum()) + np.repeat(lo[first:last] - (ends[first:last] - size - done), size)
        out += np.bincount(np.repeat(of_a[first:last], size) * len(y) + of_b[at], minlength=len(out))
        first = last
    return out.reshape(len(x), len(y))


def _links(q: pa.Table, c: pa.Table, similarity: float) -> dict:
    """Links ``(a, b)`` between the components of two blocks: a star for each that has one."""
    found = [np.zeros((2, 0), np.int64)]
    labels = [kn.numbers(side["label"]) for side in (q, c)]
    shingles = [kn.whole(side["shingles"]) for side in (q, c)]
    names, counts = np.unique(np.concatenate(labels), return_counts=True)
    common = names[counts.argmax()]  # members of the largest component only meet the others
    for rows, others in ((labels[0] != common, labels[1] == labels[1]), (labels[0] == common, labels[1] != common)):
        if not (rows.any() and others.any()):
            continue
        x, y = (side.filter(pa.array(kept)) for side, kept in zip(shingles, (rows, others)))
        u, v = labels[0][rows], labels[1][others]
        s = _shared_counts(x, y)
        n = kn.numbers(x.value_lengths())[:, None] + kn.numbers(y.value_lengths())
        alike = np.nonzero((s >= similarity * (n - s)) & (u[:, None] != v))
        found.append(np.stack([u[alike[0]], v[alike[1]]]))
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    _, node, least = kn.contracted(np.zeros(len(a), np.int64), a, b)
    return {"a": node, "b": least}


def _components(pairs: DataFrame) -> DataFrame:
    return component_labels(pairs.select(F.lit(0).alias("level"), "a", "b")).select("id", "label")


def _linked_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``labels`` and what links the components within buckets of ``members``, ``(cell, id)``."""
    named = members.join(labels, "id", "left").select("cell", "id", F.coalesce("label", "id").alias("label"))
    named = cut_lineage(named)
    parted = named.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rows = cut_lineage(named.join(parted.select("cell"), "cell", "left_semi"))
    if rows.isEmpty():
        return labels
    largest = sets.agg(F.max(F.size("shingles")).alias("n")).head()["n"]
    block_rows = max(1, min(ce.BLOCK_ROWS, _BLOCK_SHINGLES // largest))
    blocks = ce.block_rows_of(rows, None, block_rows).join(sets.withColumnRenamed("h1", "id"), "id")
    links = ce.map_blocks(blocks, lambda q, c: _links(q, c, similarity), "a long, b long")
    links = cut_lineage(links.distinct())
    if links.isEmpty():
        return labels
    # The smallest of the smallest members is the smallest of all.
    roots = cut_lineage(_components(links).select(F.col("id").alias("label"), F.col("label").alias("root")))
    moved = labels.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    alone = roots.select(F.col("label").alias("id"), F.col("root").alias("label")).join(labels, "id", "left_anti")
    return moved.unionByName(alone)


def similar_components(
    units: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, reach: int = REACH
) -> DataFrame:
    """``(id, label)``: paragraph hashes connected by verified pairs, and the smallest of each component."""
    bands, rows = bands_for(similarity, recall)
    dealt = _banded(units, bands, rows).repartition(F.shiftright("key", 16))
    found = cut_lineage(_meetings(dealt.sortWithinPartitions("key", "h1"), reach))
    met = cut_lineage(found.filter("b IS NOT NULL").select("a", "b").distinct())
    members = found.filter("b IS NULL").select(F.col("bucket").alias("cell"), F.col("a").alias("id"))
    # Members of a large bucket have met its first.
    wanted = met.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    sets = cut_lineage(_distinct(units).join(wanted, "h1", "left_semi").dropDuplicates(["h1"]))
    both = met.join(sets.select(F.col("h1").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("h1").alias("b"), F.col("shingles").alias("y")), "b"
    )
    shared = F.size(F.array_intersect("x", "y"))
    alike = both.withColumn("s", shared).filter(
        F.col("s") >= similarity * (F.size("x") + F.size("y") - F.col("s"))
    ).select("a", "b")
    labels = cut_lineage(_components(alike))
    return labels if members.isEmpty() else _linked_buckets(members, labels, sets, similarity)


def occurrences(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    reach: int = REACH,
) -> DataFrame:
    """Every paragraph that occurs more than once: ``(doc_id, start, stop, n_words, first_doc_id,
    first_start, n_alike, removed)``; places are code points, the end exclusive."""
    spark = docs.sparkSession
    path = scratch_path(spark, "paragraphs")
    _units(docs, doc_id, text, least_words, shingle).write.parquet(path)
    units = spark.read.parquet(path)
    labels = similar_components(units, similarity, recall, reach).withColumnRenamed("id", "h1")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    copies = units.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # A class is a component, or the copies of one paragraph that is like no other.
    named = copies.join(labels, "h1", "left").withColumns(
        {"c1": F.coalesce("label", "h1"), "c2": F.when(F.col("label").isNull(), F.col("h2")).otherwise(0)}
    )
    named = cut_lineage(named.filter("n > 1 OR label IS NOT NULL").select("h1", "h2", "c1", "c2", "n", "first"))
    classes = named.groupBy("c1", "c2").agg(F.sum("n").alias("n_alike"), F.min("first").alias("first"))
    found = named.select("h1", "h2", "c1", "c2").join(classes.filter("n_alike > 1"), ["c1", "c2"])
    rows = units.select("doc_id", "start", "stop", "n_words", "h1", "h2").join(found, ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))
    return rows.select(
        "doc_id",
        "start",
        "stop",
        "n_words",
        F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.start").alias("first_start"),
        "n_alike",
        (~stays).alias("removed"),
    )


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of ``text``.  Ids should be unique: of rows that
    share one, each loses what any of them must lose only where the places agree."""
    cuts = occurrences(docs, doc_id, text, **more).filter("removed").groupBy(F.col("doc_id").alias("_cut_id")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_cuts")
    )
    packed = docs.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{text}`").alias("_text"),
    )
    joined = packed.join(cuts, F.col("_id").eqNullSafe(F.col("_cut_id")), "left")
    whole = F.length("_text")
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(whole))
    kept = F.array_join(
        F.zip_with(starts, stops, lambda a, b: F.substring(F.col("_text"), a + 1, F.greatest(b - a, F.lit(0)))), ""
    )
    changed = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(F.col("_row").withField(f"`{text}`", changed).alias("_row")).select("_row.*")
