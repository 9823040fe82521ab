"""Consecutive row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.session import cut_lineage

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def number_rows(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Number rows 1..n in the given order.

    A range sort puts the rows in order across partitions and the sorted rows are
    checkpointed, so that partition and position of a row are fixed for good.  Counts
    per partition then give each partition's offset: a table with one row per
    partition, which is what the broadcast is bounded by.
    """
    return numbered(placed_rows(df, *order), name)


def placed_rows(df: DataFrame, *order: str) -> DataFrame:
    """The checkpointed rows of :func:`number_rows`, for callers that delete them when they are done."""
    ordered = df.orderBy(*order) if order else df
    return cut_lineage(ordered.withColumn("_nr_at", F.monotonically_increasing_id()))


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Rows of :func:`placed_rows` with their numbers."""
    placed = rows.withColumns(
        {
            "_nr_part": F.shiftright("_nr_at", _POSITION_BITS),
            "_nr_pos": F.col("_nr_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    )
    sizes = placed.groupBy("_nr_part").agg(F.count("*").alias("_nr_n"))
    before = W.orderBy("_nr_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_nr_part", F.coalesce(F.sum("_nr_n").over(before), F.lit(0)).alias("_nr_offset"))
    return (
        placed.join(F.broadcast(offsets), "_nr_part")
        .withColumn(name, (F.col("_nr_offset") + F.col("_nr_pos") + 1).cast("bigint"))
        .drop("_nr_at", "_nr_part", "_nr_pos", "_nr_offset")
    )
