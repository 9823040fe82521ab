"""Splits and data-quality audits.  Each audit is one job of ``(check, passed, detail)``
rows or of plain counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions.decisions import decide
from bugsieve.functions.text import let, strip, unicode_pattern
from bugsieve.operators.distributions import severity_distribution
from bugsieve.operators.encoders import unit_vector
from bugsieve.operators.numbering import number_rows
from bugsieve.operators.reports import id_order
from bugsieve.session import cut_lineage

RECORD_FIELDS = (
    "defect_id", "title", "raw_description", "steps", "expected", "actual", "environment", "logs",
)


# --- splits -----------------------------------------------------------------------


def ordered_split(df: DataFrame, n_train: int, n_test: int, order: str = "defect_id") -> DataFrame:
    """First ``floor(n * ratio)`` rows by id are ``train``, the rest ``test``.

    Only the ids are sorted and numbered; the boundary id then splits the table by a
    comparison, without moving its rows.
    """
    place = F.struct(*id_order(df, order))
    ids = number_rows(df.select(place.alias("place")), "place")
    n = ids.count()
    at = (n * n_train) // (n_train + n_test)
    boundary = ids.filter(F.col("number") == at).select("place.*").head()
    last = F.struct(*[F.lit(x) for x in boundary]) if boundary else None
    split = F.when(place <= last, "train").otherwise("test") if boundary else F.lit("test")
    return df.withColumn("split", split)


def split_overlap(train: DataFrame, test: DataFrame, key: str = "defect_id") -> DataFrame:
    """Ids present in both splits."""
    return train.select(key).join(test.select(key), key, "left_semi").distinct()


def common_ids(a: DataFrame, b: DataFrame, key: str = "defect_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def split_overlap_count(df: DataFrame, key: str = "defect_id") -> DataFrame:
    """Ids that occur in more than one split, as one metric row."""
    several = df.groupBy(key).agg(F.countDistinct("split").alias("s"))
    return several.agg(F.count_if(F.col("s") > 1).cast("double").alias("value")).select(
        F.lit("all").alias("split"), F.lit("id_overlap").alias("metric"), "value"
    )


def split_shapes(df: DataFrame, vectors: DataFrame, vector: str = "vector", key: str = "defect_id") -> DataFrame:
    """Rows and dimension of the vectors of every split, as metric rows."""
    sized = df.select(key, "split").join(vectors.select(key, F.size(vector).alias("d")), key)
    row = sized.groupBy("split").agg(
        F.count("*").cast("double").alias("vector_rows"), F.max("d").cast("double").alias("vector_dimension")
    )
    return row.unpivot(["split"], ["vector_rows", "vector_dimension"], "metric", "value")


def write_splits(df: DataFrame, vectors: DataFrame, path: str, key: str = "defect_id") -> None:
    """Records and vectors of both splits under ``path``, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/records")
    vectors.join(df.select(key, "split"), key).write.mode("overwrite").partitionBy("split").parquet(f"{path}/vectors")


def split_metadata(df: DataFrame) -> DataFrame:
    """Size and ratio of every split and its severity counts, in long form."""
    by_severity = severity_distribution(df, "split")
    sizes = by_severity.groupBy("split").agg(F.sum("n").cast("bigint").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over one row per split
    ratios = sizes.select(
        "split", F.lit("ratio").alias("metric"), F.round(F.col("n") / total, 4).alias("value")
    )
    return (
        sizes.select("split", F.lit("size").alias("metric"), F.col("n").cast("double").alias("value"))
        .unionByName(ratios)
        .unionByName(
            by_severity.select(
                "split",
                F.concat(F.lit("severity:"), F.col("severity")).alias("metric"),
                F.col("n").cast("double").alias("value"),
            )
        )
    )


# --- audits -----------------------------------------------------------------------


def _counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    )


def zero_checks(counts: DataFrame) -> DataFrame:
    """Counts of offending rows as check rows: a check passes when its count is 0."""
    names = [c for c in counts.columns if c != "total"]
    long = counts.unpivot([], names, "check", "offending") if names else counts
    return long.select("check", (F.col("offending") == 0).alias("passed"),
                       F.col("offending").alias("detail"))


def required_field_audit(records: DataFrame) -> DataFrame:
    """Presence and population of the eight record fields, one row per field."""
    present = [f for f in RECORD_FIELDS if f in records.columns]
    filled = [F.count_if(F.length(strip(F.col(f))) > 0).alias(f) for f in present]
    row = records.agg(F.count("*").alias("_total"), *filled)
    row = row.withColumns({f: F.lit(0).cast("bigint") for f in RECORD_FIELDS if f not in present})
    long = row.unpivot(["_total"], list(RECORD_FIELDS), "field", "populated")
    return long.select(
        "field",
        F.col("field").isin(present).alias("present"),
        "populated",
        F.round(F.col("populated") * 100 / F.col("_total"), 1).alias("pct"),
    )


def normalized_presence(records: DataFrame) -> DataFrame:
    return _counts(records, with_text=F.length(strip(F.col("normalized_text"))) > 0)


def missing_field_audit(records: DataFrame) -> DataFrame:
    """Per field: how many reports lack it, in percent of all reports.

    One pass: each field is a conditional count, so the total comes with it.
    """
    fields = [f for f, _, _ in fv.REQUIRED_FIELDS]
    lacking = [F.count_if(F.array_contains("missing_fields", f)).alias(f) for f in fields]
    row = records.agg(
        F.count("*").alias("_total"), *lacking, F.sum(F.size("missing_fields")).alias("any field")
    )
    long = row.unpivot(["_total"], [*fields, "any field"], "field", "n")
    return long.select(
        "field",
        "n",
        F.round(F.col("n") * 100 / F.col("_total"), 1).alias("pct"),
        F.round(F.col("n") / F.col("_total"), 1).alias("per_report"),
    )


def critical_nulls(records: DataFrame) -> DataFrame:
    def bad(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "nan")

    return _counts(records, bad_id=bad("defect_id"), bad_title=bad("title"))


def lowercase_audit(records: DataFrame, column: str = "normalized_text") -> DataFrame:
    """Rows with an upper-case letter and the first three ids among them.

    The ids come from a top-3 of the offending rows, never from a list of all of them.  The texts
    are read, and made, once: their verdicts are stored with the ids.
    """
    marked = cut_lineage(records.select("defect_id", F.col(column).rlike(r"\p{Lu}").alias("_upper")))
    samples = (
        marked.filter("_upper").select(F.struct(*id_order(marked)).alias("place")).orderBy("place").limit(3)
        .agg(F.array_join(F.array_sort(F.collect_list("place"))["defect_id"], ",").alias("samples"))
    )
    return _counts(marked, with_upper=F.col("_upper")).withColumn("samples", samples.scalar())


def artifact_audit(records: DataFrame, column: str = "normalized_text") -> DataFrame:
    """Rows that still hold special characters, links, markup or addresses.

    Plain substring tests spare most texts the patterns: a link holds ``://``, an address an ``@``.  Whether all
    characters are letters and blanks is one possessive run over the text.
    """
    c = F.col(column)
    return _counts(
        records,
        special=~c.rlike(unicode_pattern(r"\A[a-zA-Z\s]*+\z")),
        urls=c.contains("://") & c.rlike("https?://"),
        html=c.contains("<") & c.rlike("<[^>]+>"),
        emails=c.contains("@") & c.rlike(unicode_pattern(r"(?<!\S)\S+@\S+\.\S+")),
    )


def stopword_audit(records: DataFrame, n: int | None = None, column: str = "normalized_text") -> DataFrame:
    """Stopword share in percent over all reports, or over the first ``n`` by id if given."""
    head = records.select("defect_id", column)
    head = head if n is None else head.orderBy(*id_order(head)).limit(n)
    words = F.filter(F.split(F.col(column), unicode_pattern(r"\s+")), lambda w: w != "")
    stop = F.filter(words, lambda w: w.isin(fv.AUDIT_STOPWORDS))
    total, hits = F.sum(F.size(words)), F.sum(F.size(stop))
    return head.agg(
        total.alias("tokens"),
        hits.alias("stopwords"),
        F.round(hits * 100 / total, 2).alias("pct"),
        (hits / total < 0.01).alias("passed"),
    )


def whitespace_audit(records: DataFrame, column: str = "normalized_text") -> DataFrame:
    c = F.col(column)
    return _counts(
        records,
        leading_or_trailing=c != strip(c),
        double_spaces=F.contains(c, F.lit("  ")),
        tabs_or_newlines=F.contains(c, F.lit("\t")) | F.contains(c, F.lit("\n")),
    )


def combined_text_audit(records: DataFrame) -> DataFrame:
    """Whether combined text holds the whole parts it is made of, and mean normalised length
    with and without the extra sections."""
    def holds(c: str) -> Column:
        return F.contains(F.col("combined_text"), strip(F.col(c))) | (F.length(c) == 0)

    extra = (F.length("steps") > 0) | (F.length("actual") > 0)
    size = F.length("normalized_text")
    return records.agg(
        F.count_if(F.length(strip(F.col("combined_text"))) > 0).alias("nonempty"),
        *[F.count_if(holds(c)).alias(f"holds_{c}") for c in ("title", "steps", "actual")],
        F.round(F.avg(F.when(extra, size)), 4).alias("mean_with_extra"),
        F.round(F.avg(F.when(~extra, size)), 4).alias("mean_without_extra"),
    )


def vector_completeness(
    records: DataFrame, vectors: DataFrame, key: str = "defect_id", vector: str = "embedding"
) -> DataFrame:
    """Records without a vector, vectors without a record, zero and NaN vectors."""
    v = vectors.select(
        F.col(key),
        F.forall(vector, lambda x: x == 0).alias("zero"),
        F.exists(vector, lambda x: F.isnan(x)).alias("nan"),
    )
    r = records.select(key, F.lit(True).alias("in_records"))
    both = r.join(v.withColumn("in_vectors", F.lit(True)), key, "full")
    return both.agg(
        F.count_if(F.col("in_records")).alias("records"),
        F.count_if(F.col("in_vectors")).alias("vectors"),
        F.count_if(F.col("in_vectors").isNull()).alias("without_vector"),
        F.count_if(F.col("in_records").isNull()).alias("without_record"),
        F.count_if(F.col("zero")).alias("zero_vectors"),
        F.count_if(F.col("nan")).alias("nan_vectors"),
    )


def vector_norm(vector: str = "embedding") -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def norm_audit(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    mean = F.avg(vector_norm(vector))
    return vectors.agg(
        F.round(mean, 4).alias("mean_norm"), (F.abs(mean - 1) < 0.01).alias("passed")
    )


def dimension_audit(vectors: DataFrame, declared: int | None = None, vector: str = "embedding") -> DataFrame:
    """All vectors share one dimension, and it is the declared one if given."""
    low, high = F.min(F.size(vector)), F.max(F.size(vector))
    ok = (low == high) if declared is None else (low == high) & (high == declared)
    return vectors.agg(low.alias("min_dim"), high.alias("max_dim"), ok.alias("passed"))


def dimension_sides(vectors: DataFrame, declared: DataFrame, queries: DataFrame, vector: str = "vector") -> DataFrame:
    """Smallest and largest dimension of stored vectors, of the declared metadata (a table with
    ``dimension``) and of encoded queries, and whether a side is of one dimension, that of all."""
    parts = [
        df.select(F.lit(side).alias("side"), size.alias("d"))
        for side, df, size in (
            ("stored", vectors, F.size(vector)),
            ("declared", declared, F.col("dimension").cast("int")),
            ("queries", queries, F.size(vector)),
        )
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("side").agg(
        F.min("d").alias("min_dim"), F.max("d").alias("max_dim")
    )
    every = W.partitionBy()  # over three rows
    same = F.min("min_dim").over(every) == F.max("max_dim").over(every)
    return rows.withColumn("passed", same)


CASES = {0.90: "duplicate", 0.65: "possible_duplicate", 0.35: "new_defect"}


def decision_cases(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The search contract's three score cases, made from every stored vector: a query with that
    score against it, and whether the decision is the one the contract names."""
    v = F.transform(vector, lambda x: x.cast("double"))

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def across(unit: Column) -> Column:
        """A unit vector orthogonal to ``unit``: its mirror image without the part along it."""
        turned = F.reverse(unit)
        along = product(unit, turned)
        return let(F.zip_with(turned, unit, lambda a, b: a - along * b), unit_vector)

    rows = vectors.select(let(unit_vector(v), lambda u: F.struct(u.alias("u"), across(u).alias("w"))).alias("x"))
    made = rows.select(
        "x.u",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(want).alias("want"),
                        F.zip_with("x.u", "x.w", lambda a, b: a * s + b * (1 - s * s) ** 0.5).alias("q"),
                    )
                    for s, want in CASES.items()
                ]
            )
        ).alias("case"),
    )
    decision = decide(F.round(product(F.col("u"), F.col("case.q")), 9))
    return made.agg(F.count("*").alias("cases"), F.count_if(decision == F.col("case.want")).alias("cases_right"))


def index_coverage(records: DataFrame, vectors: DataFrame, indexed: DataFrame) -> DataFrame:
    """Row counts of records, stored vectors and indexed vectors, and whether they agree."""
    tagged = None
    for name, df in (("records", records), ("vectors", vectors), ("indexed", indexed)):
        part = df.select(F.lit(name).alias("part"))
        tagged = part if tagged is None else tagged.unionByName(part)
    row = tagged.agg(
        *[F.count_if(F.col("part") == n).alias(n) for n in ("records", "vectors", "indexed")]
    )
    same = (F.col("records") == F.col("vectors")) & (F.col("vectors") == F.col("indexed"))
    return row.withColumn("passed", same)


def search_contract(
    matches: DataFrame, k: int, corpus_size: int, query: str = "query_id", score: str = "score"
) -> DataFrame:
    """Exactly ``min(k, corpus)`` matches per query, distinct ranks, scores in [-1, 1]."""
    per_query = matches.groupBy(query).agg(
        F.count("*").alias("n"),
        F.countDistinct("rank").alias("ranks"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
    )
    want = min(k, corpus_size)
    return per_query.agg(
        F.count("*").alias("queries"),
        F.count_if((F.col("n") != want) | (F.col("ranks") != want)).alias("wrong_size"),
        F.count_if((F.col("low") < -1 - 1e-6) | (F.col("high") > 1 + 1e-6)).alias("out_of_range"),
    )
