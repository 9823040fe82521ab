"""Quoted CSV whose fields span lines, read by as many tasks as the file has splits.

A line break ends a record only outside quotes, and whether a split starts inside quotes depends on all
splits before it.  But that is one bit: the parity of the quotes before the split (a doubled quote
counts twice and changes nothing).  So the quotes of every split are counted first, parities are added up
over the splits of a file, and with its own start known each split puts its lines together alone.  A
record that runs over the end of its split is stitched from the pieces of the splits it touches; these are the
only rows that are shuffled.

Holds for files that follow the format: a field that holds a quote or a line break is quoted, quotes in it
are doubled.  Other files need the reader that takes a file as one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugsieve.functions.text import let
from bugsieve.session import cut_lineage, ship_package
from bugsieve.sources.readers import CSV_OPTIONS, POSITION, TRACKER_SCHEMA, typed_columns

#: A piece of a record: all of it, its end, its beginning, or a whole split in the middle of it.
_WHOLE, _END, _MIDDLE, _BEGINNING = range(4)
_PIECES = "file string, block long, seq long, piece int, text string"


def _lines(spark: SparkSession, path: str, **options: str | bool) -> DataFrame:
    text = spark.read.options(lineSep="\n", **options).text(path)
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (quotes % 2).cast("int").alias("odd"),
        value.alias("line"),
        F.monotonically_increasing_id().alias("at"),  # the order within a split
    )


def split_starts(lines: DataFrame) -> DataFrame:
    """``(file, block, inside, header)``: whether a split starts inside quotes, and the first line of its
    file; one row per split, from one pass over the lines."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counted = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.min_by("line", "at").alias("first"))
    return counted.select(
        "file", "block",
        (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"),
        F.first("first").over(W.partitionBy("file").orderBy("block")).alias("header"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their splits to records and pieces of records; holds one record and a batch."""
    at: tuple | None = None
    held: list[str] = []  # lines of a record that has not ended
    open_, headless, seq = False, False, 0

    def row(piece: int, texts: list[str], first: int) -> tuple:
        n = len(texts)
        return [at[0]] * n, [at[1]] * n, range(first, first + n), [piece] * n, texts

    def leave() -> list[tuple]:
        if not held:
            return []
        return [row(_MIDDLE if headless else _BEGINNING, ["\n".join(held)], seq)]

    for batch in batches:
        files, blocks = batch["file"].to_pylist(), batch["block"].to_numpy()
        inside, odd, lines = batch["inside"].to_numpy(), batch["odd"].to_numpy(), batch["line"].to_pylist()
        out: list[tuple] = []
        cuts = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(files)]):
            if a == b:
                continue
            if at != (files[a], int(blocks[a])):
                if at is not None:
                    out += leave()
                at, held, seq = (files[a], int(blocks[a])), [], 0
                open_ = headless = bool(inside[a])
            # A line ends a record if the quotes up to it are even.
            within = (int(open_) + np.cumsum(odd[a:b])) % 2
            ends = a + np.flatnonzero(within == 0) + 1
            open_ = bool(within[-1])
            if not len(ends):
                held += lines[a:b]
                continue
            starts = [a, *ends[:-1]]
            texts = [lines[s] if e - s == 1 else "\n".join(lines[s:e]) for s, e in zip(starts, ends)]
            if held:
                texts[0] = "\n".join([*held, texts[0]])
            if headless:
                out.append(row(_END, texts[:1], 0))
                texts, headless = texts[1:], False
            out.append(row(_WHOLE, texts, seq))
            seq += len(texts)
            held = lines[ends[-1] : b]
        if out:
            yield _batch(out)
    if at is not None and held:
        yield _batch(leave())


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [[x for part in parts for x in part[i]] for i in range(5)]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PIECES.split(", ")]
    )


def records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``(file, block, seq, text)``: every record of the files, by the split it begins in and its place there."""
    ship_package(lines.sparkSession)
    # One row per split of the input.
    marked = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "odd", "line")
    pieces = marked.mapInArrow(_pieces, _PIECES)
    whole = pieces.filter(F.col("piece") == _WHOLE).drop("piece")
    # At most two pieces per split: the last beginning before a piece is its record's.
    upto = W.partitionBy("file").orderBy("block", "piece").rowsBetween(W.unboundedPreceding, 0)
    begins = F.when(F.col("piece") == _BEGINNING, F.struct(F.col("block").alias("block"), F.col("seq").alias("seq")))
    parts = pieces.filter(F.col("piece") != _WHOLE).withColumn("of", F.last(begins, ignorenulls=True).over(upto))
    stitched = parts.groupBy("file", "of").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "piece", "text")))["text"], "\n").alias("text")
    )
    return whole.unionByName(stitched.select("file", "of.block", "of.seq", "text"))


_SPLIT = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV_OPTIONS.items() if k != "header"}


def _fields(text: Column, n: int) -> Column:
    """The first ``n`` fields of a record as an array."""
    parsed = F.from_csv(text, ", ".join(f"c{i} string" for i in range(n)), _SPLIT)
    return let(parsed, lambda r: F.array(*[r[f"c{i}"] for i in range(n)]))


def _bodies(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Records but headers and blank lines, without the line end."""
    body = records(lines, starts).filter((F.col("block") > 0) | (F.col("seq") > 0))
    return body.withColumn("text", F.regexp_replace("text", "\r$", "")).filter(F.length("text") > 0)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, positions: bool = False) -> DataFrame:
    """As ``read_csv_reports``, by all splits of the files at once; the header is that of the first file."""
    names = spark.read.csv(path, **CSV_OPTIONS).columns
    lines = _lines(spark, path)
    parsed = _bodies(lines, split_starts(lines)).withColumn("r", _fields(F.col("text"), max(len(names), 1)))
    flat = parsed.select(
        *[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)],
        *[F.col(a).alias(b) for a, b in zip(("file", "block", "seq"), POSITION)],
    )
    return flat.select(*typed_columns(names, schema), *(POSITION if positions else ()))


def read_split_exports(spark: SparkSession, root: str, glob: str = "*_bugs.csv", positions: bool = False) -> DataFrame:
    """As ``read_tracker_exports``, in one scan for all header layouts.

    Every file's header comes from the pass that counts quotes, and each record picks its fields by the
    header of its own file; neither files nor layouts are listed on the driver.
    """
    lines = _lines(spark, root, recursiveFileLookup=True, pathGlobFilter=glob)
    starts = cut_lineage(split_starts(lines))
    tops = starts.filter("block = 0").select("file", F.regexp_replace("header", "\r$", "").alias("header"))
    commas = F.length("header") - F.length(F.replace(F.col("header"), F.lit(","), F.lit("")))
    n = tops.agg(F.max(commas)).head()[0]
    n = 1 if n is None else n + 1
    named = tops.withColumn("names", F.transform(_fields(F.col("header"), n), F.trim)).select(
        "file", "names", F.size(F.filter("names", lambda x: x.isNotNull())).alias("width")
    )
    # A mark after the last field tells a record of another width, which is unreadable.
    marked = _fields(F.concat("text", F.lit(",\x01")), n + 1)
    rows = (
        _bodies(lines, starts)
        .join(F.broadcast(named.filter(F.array_contains("names", "Description"))), "file")  # one row per file
        .withColumn("r", marked)
    )

    def field(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, F.get("r", at - 1)).alias(name)

    whole = F.get("r", F.col("width")).eqNullSafe(F.lit("\x01"))
    picked = rows.select(
        *[field(f.name) for f in TRACKER_SCHEMA.fields], whole.alias("_whole"), F.col("file").alias("source_file"),
        *[F.col(a).alias(b) for a, b in zip(("file", "block", "seq"), POSITION)],
    )
    kept = picked.filter(F.col("Description").isNotNull() | F.col("_whole"))
    clean = [F.when(F.col(f.name) != "\x01", F.col(f.name)).alias(f.name) for f in TRACKER_SCHEMA.fields]
    return kept.select(*clean, "source_file", *(POSITION if positions else ()))
