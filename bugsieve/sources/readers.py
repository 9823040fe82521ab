"""Readers: report tables, tracker exports, record tables, vectors and vocabulary."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugsieve.operators.numbering import number_rows

FIX_SCHEMA = T.StructType(
    [
        T.StructField("Description", T.StringType()),
        T.StructField("Fixing_time", T.IntegerType()),
        T.StructField("Label", T.IntegerType()),
    ]
)
SEVERITY_SCHEMA = T.StructType(
    [T.StructField("Description", T.StringType()), T.StructField("Severity", T.StringType())]
)
TRACKER_SCHEMA = T.StructType(
    [
        T.StructField("Summary", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Priority", T.StringType()),
    ]
)
REPORT_FIELDS = (
    "title", "description", "steps", "expected", "actual", "environment", "logs", "severity",
)
REPORT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in REPORT_FIELDS])
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("defect_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("raw_description", T.StringType()),
        T.StructField("combined_text", T.StringType()),
        T.StructField("normalized_text", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("fixing_time", T.IntegerType()),
        T.StructField("fix_label", T.IntegerType()),
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("steps", T.StringType()),
        T.StructField("expected", T.StringType()),
        T.StructField("actual", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("logs", T.StringType()),
        T.StructField("missing_fields", T.ArrayType(T.StringType())),
        T.StructField("improved_summary", T.StringType()),
    ]
)
VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("defect_id", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
_CORRUPT = "_corrupt_record"
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


#: Columns that say where a row was read; in their order, rows stand as in the files.
POSITION = ("_file", "_block", "_at")


def _position() -> list[Column]:
    """File, block and place of a row, taken at the scan.  Within a block rows are read in
    order, by one task, so the place needs to grow only there."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    ]


def read_csv_reports(
    spark: SparkSession, path: str, schema: T.StructType, positions: bool = False
) -> DataFrame:
    """Quoted multi-line CSV with a header.

    Columns are taken by header name and typed by ``schema``, so extra or reordered
    columns in the file do no harm and no inference pass is needed.  ``positions`` adds
    the columns ``POSITION``.
    """
    raw = spark.read.csv(path, **CSV_OPTIONS)
    return raw.select(*typed_columns(raw.columns, schema), *(_position() if positions else []))


def typed_columns(header: list[str], schema: T.StructType) -> list[Column]:
    """The fields of ``schema`` from text columns named by a header; missing ones are null."""
    names = {c.strip(): c for c in header}
    return [
        (F.expr(f"try_cast(`{names[f.name]}` as {f.dataType.simpleString()})") if f.name in names
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]


def tracker_files(spark: SparkSession, root: str, glob: str = "*_bugs.csv") -> DataFrame:
    """The tracker exports below ``root`` with their header line, read in parallel.

    Only each file's first line is kept: one row per file, and a few header layouts.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .option("wholetext", False).text(root)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("header"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    return (
        lines.filter("block = 0").groupBy("file").agg(F.min_by("header", "at").alias("header"))
    )


def read_tracker_exports(
    spark: SparkSession, root: str, glob: str = "*_bugs.csv", positions: bool = False
) -> DataFrame:
    """All ``*_bugs.csv`` files below ``root``, unified, each row with its ``source_file``.

    Files are grouped by header layout and each layout is one scan.  Layouts without a
    ``Description`` column are skipped; unreadable rows are dropped, not fatal.
    """
    layouts = tracker_files(spark, root, glob).groupBy("header").agg(F.collect_list("file").alias("files"))
    out = None
    for layout in layouts.orderBy("header").toLocalIterator():
        columns = [c.strip() for c in next(csv.reader([layout["header"] or ""]), [])]
        if "Description" not in columns:
            continue
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        schema = schema.add(_CORRUPT, T.StringType())
        scan = (
            spark.read.schema(schema)
            .options(**CSV_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
            .csv(layout["files"])
        )
        part = scan.filter(F.col("Description").isNotNull() | F.col(_CORRUPT).isNull()).select(
            *[
                (F.col(f.name) if f.name in columns else F.lit(None).cast("string")).alias(f.name)
                for f in TRACKER_SCHEMA.fields
            ],
            F.col("_metadata.file_path").alias("source_file"),
            *(_position() if positions else []),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        more = [T.StructField("source_file", T.StringType())]
        if positions:
            kinds = (T.StringType(), T.LongType(), T.LongType())
            more += [T.StructField(c, k) for c, k in zip(POSITION, kinds)]
        return spark.createDataFrame([], T.StructType([*TRACKER_SCHEMA.fields, *more]))
    return out


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed records, as parquet or JSON, under the fixed 16-field schema."""
    return spark.read.schema(RECORD_SCHEMA).format(fmt).load(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector table: one ``(defect_id, embedding)`` row per report."""
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary, one token per line, in one file or in parts that follow each other by name;
    ``rank`` is the line number from 1."""
    lines = spark.read.text(path).select(F.col("value").alias("token"), *_position())
    return number_rows(lines, *POSITION, name="rank").drop(*POSITION)


def parse_report_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Free text or JSON to report fields.

    Text that parses as a JSON object gives its fields; anything else becomes the
    description, with its first 50 characters as title.
    """
    parsed = F.from_json(F.col(text), REPORT_SCHEMA, {"mode": "PERMISSIVE"})
    is_json = F.btrim(F.col(text)).startswith("{") & F.get_json_object(text, "$").isNotNull()
    free = {
        "title": F.substring(F.col(text), 1, 50),
        "description": F.col(text),
    }
    out = df.withColumn("_parsed", F.when(is_json, parsed))
    fields = {
        f: F.when(is_json, F.col(f"_parsed.{f}")).otherwise(
            free.get(f, F.lit(None).cast("string"))
        )
        for f in REPORT_FIELDS
    }
    return out.withColumns(fields).drop("_parsed")
