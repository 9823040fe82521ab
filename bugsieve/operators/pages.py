"""Pages of a listing from a stored directory: every page costs the same, however deep it lies.

The rows are numbered in id order once and written in a folder per slice of ``SLICE_ROWS`` numbers, in order
of number.  Which slice a page lies in is arithmetic, so a page reads one slice, or two where it crosses
from one to the next, and of those the row groups of its numbers.

Rows with a null id come first, rows of one id stand in order of their other columns: all pages
together hold every row once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.operators.numbering import number_rows
from bugsieve.operators.reports import id_order

SLICE_ROWS = 1 << 18


@dataclass(frozen=True)
class PageDirectory:
    """A stored listing; ``rows`` has its columns, ``number`` from 1, and ``slice``."""

    rows: DataFrame
    total: int
    slice_rows: int
    columns: tuple[str, ...]

    @staticmethod
    def build(df: DataFrame, path: str, order: str = "defect_id", slice_rows: int = SLICE_ROWS) -> PageDirectory:
        place = F.struct(*id_order(df, order), F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("c"))) for c in df.columns])).alias("_place")
        number = number_rows(df.select(place, F.struct(*df.columns).alias("_row")), "_place", name="_number")
        sliced = number.select(
            "_row.*", F.col("_number").alias("number"), F.floor((F.col("_number") - 1) / slice_rows).alias("slice")
        )
        # A slice is one file: its rows are dealt by slice and sorted by number.
        sliced.repartition("slice").sortWithinPartitions("slice", "number").write.partitionBy("slice").parquet(f"{path}/rows")
        total = sliced.agg(F.count("*").alias("total"), F.lit(slice_rows).alias("slice_rows"))
        total.write.parquet(f"{path}/total")
        df.limit(0).write.parquet(f"{path}/columns")
        return PageDirectory.open(df.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> PageDirectory:
        layout = spark.read.parquet(f"{path}/total").head()
        own = spark.read.parquet(f"{path}/columns").schema
        rows = spark.read.schema(own.add("number", "long").add("slice", "long")).parquet(f"{path}/rows")
        return PageDirectory(rows, layout["total"], layout["slice_rows"], tuple(rows.columns[:-2]))

    def page(self, page: int, per_page: int = 20) -> DataFrame:
        """Rows ``(page - 1) * per_page + 1`` to ``page * per_page`` of the listing."""
        if page < 1 or per_page < 1:
            raise ValueError("page and per_page start at 1")
        if per_page > fv.MAX_PER_PAGE:
            raise ValueError(f"per_page is at most {fv.MAX_PER_PAGE}")
        first, last = (page - 1) * per_page + 1, page * per_page
        slices = sorted({(first - 1) // self.slice_rows, (last - 1) // self.slice_rows})
        inside = F.col("slice").isin(slices) & F.col("number").between(first, last)
        return self.rows.filter(inside).orderBy("number").select(*self.columns)

    def totals(self, per_page: int = 20) -> tuple[int, int]:
        """Rows and pages."""
        return self.total, -(-self.total // per_page)
