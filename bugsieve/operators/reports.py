"""Shaping report tables: renames, unions, ids, caps, defaults and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions import text as tx
from bugsieve.functions.completeness import missing_fields, stored_summary
from bugsieve.operators.numbering import number_rows

BASE_NAMES = {
    "Description": "raw_description",
    "Fixing_time": "fixing_time",
    "Label": "fix_label",
    "Severity": "severity",
}
TRACKER_NAMES = {"Description": "raw_description", "Priority": "severity", "Summary": "title"}
FAN_OUT = 100_000  # rows made from one array at a time
KEPT = ("raw_description", "severity", "title", "fixing_time", "fix_label")


def drop_junk_columns(df: DataFrame, marker: str = "Unnamed") -> DataFrame:
    return df.drop(*[c for c in df.columns if marker in c])


def join_severity(
    fixes: DataFrame, severities: DataFrame, key: str = "Description", dedupe_right: bool = False
) -> DataFrame:
    """Left join on the description text; repeated texts fan out as SQL says.

    The right side is first reduced to one row per text, with its severities and how often
    each occurs; the fan-out happens after the join.  A text copied over a large part of
    both tables then meets one row, and only the left side of its key can be skewed, which
    adaptive execution splits.  Long texts are joined by a 64-bit hash and by equality:
    hashing and sorting compare eight bytes, and collisions do no harm.
    ``dedupe_right`` keeps one severity per text (the smallest), without fan-out.
    """
    counted = severities.groupBy(key, "Severity").agg(F.count("*").alias("_n"))
    if dedupe_right:
        counted = counted.groupBy(key).agg(F.min("Severity").alias("Severity"), F.lit(1).alias("_n"))
    right = counted.groupBy(F.col(key).alias("_text")).agg(
        F.collect_list(F.struct("Severity", "_n")).alias("_found")
    ).withColumn("_rh", F.xxhash64("_text"))
    left = fixes.withColumn("_h", F.xxhash64(key))
    on = (F.col("_h") == F.col("_rh")) & (F.col(key) == F.col("_text"))
    joined = left.join(right, on, "left").select(*fixes.columns, F.explode_outer("_found").alias("_f"))
    # n rows out of one: first the chunks, then the rows of each, so no array is long.
    n, chunk = F.coalesce(F.col("_f._n"), F.lit(1)), F.lit(FAN_OUT)
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1, chunk.cast("bigint"))
    chunks = joined.select(
        *fixes.columns, F.col("_f.Severity").alias("Severity"), n.alias("_n"), F.explode(starts).alias("_s")
    )
    rows = F.sequence(F.lit(1).cast("bigint"), F.least(chunk.cast("bigint"), F.col("_n") - F.col("_s")))
    return chunks.select(*fixes.columns, "Severity", F.explode(rows).alias("_t")).drop("_t")


def canonical_base(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(BASE_NAMES)


def canonical_tracker(df: DataFrame, *extra: str) -> DataFrame:
    """Tracker layout to the common names, with constant fix columns."""
    out = df.withColumnsRenamed(TRACKER_NAMES).withColumns(
        {"fixing_time": F.lit(0), "fix_label": F.lit(0)}
    )
    return out.select(*[c for c in (*KEPT, *extra) if c in out.columns])


def union_reports(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a layout lacks become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def defect_id(number: Column) -> Column:
    """``DEF-`` and a number padded to at least five digits, never cut."""
    return F.format_string("DEF-%05d", number)


def id_order(df: DataFrame, key: str = "defect_id") -> list[Column]:
    """Columns that put ids in the order of their numbers.  Ids are padded to five digits and
    longer from 100,000 on, so shorter text comes first; ids that are numbers are their own order."""
    column = F.col(key)
    return [F.length(column), column] if df.schema[key].dataType.typeName() == "string" else [column]


def mint_ids(df: DataFrame, *order: str) -> DataFrame:
    """Consecutive ids in the given order, numbered without a single-task window."""
    numbered = number_rows(df, *order)
    return numbered.select(defect_id(F.col("number")).alias("defect_id"), *df.columns)


def cap_rows(df: DataFrame, n: int, order: str = "defect_id") -> DataFrame:
    """First ``n`` rows by id, for callers that ask for a cap: a top-n per partition, then one merge."""
    return df.orderBy(*id_order(df, order)).limit(n)


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing integers are 0, missing logs are empty; a missing severity stays null."""
    return df.withColumns(
        {
            "fixing_time": F.coalesce(F.col("fixing_time").cast("int"), F.lit(0)),
            "fix_label": F.coalesce(F.col("fix_label").cast("int"), F.lit(0)),
            "logs": F.coalesce("logs", F.lit("")),
        }
    )


def with_previews(df: DataFrame) -> DataFrame:
    """Add ``<column>_preview`` for display: cut by code points, then stripped.  The columns
    themselves stay whole, and everything that searches or audits reads those."""
    return df.withColumns(
        {
            f"{c}_preview": tx.strip(tx.first_chars(F.coalesce(c, F.lit("")), n))
            for c, n in fv.PREVIEW_CHARS.items()
            if c in df.columns
        }
    )


def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are costly and used several times, each computed once per row.

    Without this, a filter on such a column is pushed below it and computes it again, and
    every later use inlines it once more.  Values that come out of a generator are not
    inlined.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def with_titles_and_sections(df: DataFrame, strict: bool = False) -> DataFrame:
    description = F.col("raw_description")
    given = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    probed = evaluate_once(df, {"_probe": tx.folded(description)})
    return evaluate_once(
        probed,
        {
            "title": tx.title_or_extracted(given, description, strict),
            **tx.extract_sections(description, strict, F.col("_probe")),
        },
    ).drop("_probe")


def with_combined_text(df: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("title", "raw_description", "steps", "actual")]
    return df.withColumn("combined_text", tx.combine_index_text(*parts))


def with_tokens(df: DataFrame, text: str = "combined_text") -> DataFrame:
    """Lemmatized tokens and the normalised text they make."""
    return evaluate_once(df, {"tokens": tx.lemmatized_tokens(F.col(text))}).withColumn(
        "normalized_text", F.coalesce(F.array_join("tokens", " "), F.lit(""))
    )


def valid_text(df: DataFrame, column: str = "normalized_text") -> DataFrame:
    return df.filter(F.length(column) > fv.MIN_NORMALIZED_CHARS)


def report_fields(df: DataFrame) -> dict[str, Column]:
    """The columns a stored report answers the required fields with."""
    names = {"description": "raw_description"}
    fields = [f for f, _, _ in fv.REQUIRED_FIELDS]
    return {f: F.col(names.get(f, f)) for f in fields}


def with_completeness(df: DataFrame) -> DataFrame:
    f = report_fields(df)
    return df.withColumns(
        {
            "missing_fields": missing_fields(f),
            "improved_summary": stored_summary(
                f["title"], f["severity"], f["description"], f["steps"], f["expected"], f["actual"]
            ),
        }
    )
