"""Sharding by histogram sort: shards of near equal bytes, found by counting, and one exchange.

The order is that of a hash of the text, then of a row number, so copies of a text lie
together and a text that holds a third of all rows can still be split between shards.  Splitters
are found by rounds of exact counts (Solomonik and Kale, Highly scalable parallel sorting, 2010):
each round places probes in the interval where a splitter must lie and sums the bytes below each
of them over all partitions; the interval shrinks to the two probes around the target.  A
splitter is settled when its bytes are within the tolerance, or no row lies in its interval.  What
comes to the driver is one row per probe interval, whatever the data.  The rows are then exchanged
once, by their place in the order, into any number of tasks.

Cases: a null text has size 1 and the checksum of nothing; so has an empty one.  Repeated rows,
null ids and equal texts are all kept and may part at a boundary.  A row larger than a shard gets
into one shard whole, and others may then be empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.llm.common import free_name
from bugsieve.session import scratch_path

PROBES = 32  # per splitter and round
TOLERANCE = 0.001  # of a shard's bytes
_HALF = 1 << 63
_ROW_BITS = 63


def _number(hash_: int, row: int) -> int:
    """A place in the order as one whole number."""
    return (hash_ + _HALF) << _ROW_BITS | row


def _parts(number: int) -> tuple[int, int]:
    return (number >> _ROW_BITS) - _HALF, number & ((1 << _ROW_BITS) - 1)


def _below(number: int) -> Column:
    """True for rows before a place in the order."""
    h, r = _parts(number)
    return (F.col("_h") < h) | ((F.col("_h") == h) & (F.col("_r") < r))


def _interval(cuts: list[int], low: int = 0) -> Column:
    """How many of the sorted cuts are not above a row, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(_below(cuts[mid]), _interval(cuts[:mid], low)).otherwise(_interval(cuts[mid + 1 :], low + mid + 1))


def _counts(keys: DataFrame, cuts: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Per interval between cuts: bytes, rows, and places that enclose its rows.

    Only numbers are aggregated, so a round is one scan with a hash table of a few hundred rows.
    """
    rows = (
        keys.withColumn("_i", _interval(cuts))
        .groupBy("_i")
        .agg(
            F.sum("_size").alias("bytes"),
            F.count("*").alias("n"),
            *[f(c).alias(name + c) for name, f in (("min", F.min), ("max", F.max)) for c in ("_h", "_r")],
        )
        .collect()
    )
    found = {}
    for r in rows:
        one = r["min_h"] == r["max_h"]  # then the row numbers are those of this hash
        first = _number(r["min_h"], r["min_r"] if one else 0)
        last = _number(r["max_h"], r["max_r"] if one else (1 << _ROW_BITS) - 1)
        found[r["_i"]] = (r["bytes"], r["n"], first, last)
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """The places where shard 1, 2, ... begin, for rows ``(_h, _r, _size)``.

    ``keys`` is read once per round and should be a stored table.
    """
    whole = _counts(keys, [])
    if not whole:
        return [0] * (shards - 1)
    total, _, first, last = whole[0]
    targets = [total * k / shards for k in range(1, shards)]
    allowed = tolerance * total / shards
    spans = {k: (first, last + 1) for k in range(shards - 1)}  # where each splitter must lie
    settled: dict[int, int] = {}
    while spans:
        wanted: set[int] = set()
        for low, high in spans.values():
            step = max(1, (high - low) // (probes + 1))
            wanted |= set(range(low, high, step)) | {high}
        cuts = sorted(wanted)
        found = _counts(keys, cuts)
        before, run = [], 0  # bytes before each cut
        for i in range(len(cuts)):
            run += found.get(i, (0,))[0]
            before.append(run)
        for k in list(spans):
            near = min(range(len(cuts)), key=lambda i: abs(before[i] - targets[k]))
            if abs(before[near] - targets[k]) <= allowed:
                settled[k] = cuts[near]
                del spans[k]
                continue
            i = next(i for i in range(1, len(cuts)) if before[i] >= targets[k])
            inside = found[i]  # between cuts i - 1 and i; the target lies in these bytes
            _, n, low, high = inside
            if n == 1:  # one row: the splitter goes to its nearer side
                upper = targets[k] - before[i - 1] > before[i] - targets[k]
                settled[k] = low + 1 if upper else low
                del spans[k]
            else:
                spans[k] = (low, high + 1)
    return [settled[k] for k in range(shards - 1)]


def assign(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row; slots count from 0 within a shard."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    measured = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("_size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("_h"),
        F.monotonically_increasing_id().alias("_r"),
    )
    path = scratch_path(spark, "shard-keys")
    measured.write.parquet(path)  # row numbers are fixed from here on, and rounds read no text
    keys = spark.read.parquet(path)
    cuts = splitters(keys, shards, tolerance)
    ordered_path = scratch_path(spark, "shard-order")
    placed = keys.withColumn("shard", _interval(cuts))
    # The one exchange: rows in order, in as many tasks as the session shuffles with.
    placed.orderBy("_h", "_r").withColumn("_at", F.monotonically_increasing_id()).write.parquet(ordered_path)
    ordered = spark.read.parquet(ordered_path)
    part = F.shiftright("_at", 33)
    # Places within a task are consecutive, and so are shards: offsets need a row per task and shard.
    sizes = [
        (r["p"], r["shard"], r["n"], r["first"])
        for r in ordered.groupBy(part.alias("p"), "shard")
        .agg(F.count("*").alias("n"), F.min("_at").alias("first"))
        .collect()
    ]
    offsets, run = [], dict.fromkeys(range(shards), 0)
    for p, shard, n, first in sorted(sizes):
        offsets.append((shard, p, run[shard] - first))
        run[shard] += n
    table = spark.createDataFrame(offsets, "shard int, _p long, _offset long")
    return ordered.withColumn("_p", part).join(F.broadcast(table), ["shard", "_p"]).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("_at") + F.col("_offset")).alias("slot"),
    )


def write(docs: DataFrame, path: str, shards: int = 8, text: str = "text", tolerance: float = TOLERANCE) -> list[int]:
    """Write all columns of ``docs`` as parquet folders ``shard=0``, ... under ``path``; return the splitters.

    The rows move once: they are dealt by shard and hash, so a shard is several files and no
    task holds all of it.  ``docs`` is read twice and must give the same rows in the same order
    of partitions, as a stored table does.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.xxhash64(raw).alias("_h"),
        F.monotonically_increasing_id().alias("_r"),
        (F.octet_length(raw) + 1).cast("long").alias("_size"),
    )
    keys_path = scratch_path(spark, "shard-keys")
    keyed.select("_h", "_r", "_size").write.parquet(keys_path)
    cuts = splitters(spark.read.parquet(keys_path), shards, tolerance)
    shard = free_name(docs, "shard")
    keyed.withColumn(shard, _interval(cuts)).repartition(F.col(shard), F.pmod("_r", F.lit(16))).select(
        "_row.*", shard
    ).write.partitionBy(shard).parquet(path)
    return cuts
