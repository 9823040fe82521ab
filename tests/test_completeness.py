from pyspark.sql import functions as F

from bugsieve.functions import completeness as cp
from bugsieve.functions import decisions as de
from bugsieve.functions import fixed_values as fv

FIELDS = [f for f, _, _ in fv.REQUIRED_FIELDS]


def _report(spark, **values):
    schema = ", ".join(f"{f} string" for f in [*FIELDS, "logs"])
    return spark.createDataFrame([tuple(values.get(f) for f in [*FIELDS, "logs"])], schema)


def test_missing_is_null_blank_or_short(spark):
    df = _report(spark, title="Crash", description="  abc  ", steps="1. open", severity="low", actual="\u00a0" * 9)
    row = df.select(
        cp.missing_fields({f: F.col(f) for f in FIELDS}).alias("m"),
        cp.missing_details({f: F.col(f) for f in FIELDS}).alias("d"),
    ).head()
    assert row["m"] == ["description", "expected", "actual", "environment", "severity"]
    assert [d["field"] for d in row["d"]] == row["m"]
    assert row["d"][0]["label"] == "Detailed description"


def test_present_fields(spark):
    df = _report(spark, title="Crash now", severity="normal")
    out = df.select(cp.present_fields(cp.missing_fields({f: F.col(f) for f in FIELDS})).alias("p")).head()
    assert out["p"] == ["title", "severity"]


def _stored(spark, **v):
    df = _report(spark, **v)
    names = ("title", "severity", "description", "steps", "expected", "actual")
    return df.select(cp.stored_summary(*[F.col(n) for n in names]).alias("s")).head()["s"]


def test_stored_summary(spark):
    text = _stored(
        spark, title="T", severity="major", description="No. The window closes on its own. x",
        steps="s" * 200, expected="e", actual="a" * 150,
    )
    assert text == (
        "**T** | Severity: major | The window closes on its own. | Steps: " + "s" * 150
        + " | Expected: e | Actual: " + "a" * 100
    )


def test_stored_summary_without_anything(spark):
    assert _stored(spark, title=fv.UNTITLED, severity="nan", description="short") == "No summary available"
    assert _stored(spark) == "No summary available"


def test_query_summary_similarity_is_strict(spark):
    df = spark.createDataFrame(
        [("T", "A sentence of some length. b", "DEF-1", "Old", s) for s in (0.5, 0.5001)]
        + [("", "x", None, None, None)],
        "t string, d string, i string, bt string, s double",
    )
    out = df.select(cp.query_summary(*[F.col(c) for c in ("t", "d", "i", "bt", "s")]).alias("o")).collect()
    assert [r["o"] for r in out] == [
        "T A sentence of some length.",
        "T A sentence of some length. (Similar to DEF-1: Old)",
        "Insufficient information for summary generation.",
    ]


def test_enhanced_title_and_summary(spark):
    rows = [
        ("abc", "Bug: The real title\nmore", None),
        ("[ENHANCED] done already", "d", None),
        ("Long title", "One long sentence here. Another long sentence. Third long sentence.", "s"),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, d string, s string")
    none = F.lit(None).cast("string")
    out = df.select(
        cp.enhanced_title(F.col("t"), F.col("d")).alias("t"),
        cp.enhanced_summary(F.col("d"), F.col("s"), none, none, none).alias("s"),
    ).collect()
    assert [r["t"] for r in out] == [
        "[ENHANCED] The real title", "[ENHANCED] done already", "[ENHANCED] Long title",
        f"[ENHANCED] {fv.UNTITLED}",
    ]
    assert [r["s"] for r in out] == [
        "Bug: The real title\nmore.", "d",
        "One long sentence here. | Another long sentence. | Steps to reproduce: s", "",
    ]


def test_form_errors(spark):
    df = spark.createDataFrame([(" ", None), ("a", "b")], "t string, d string")
    out = [r["e"] for r in df.select(cp.form_errors(F.col("t"), F.col("d")).alias("e")).collect()]
    assert out == [["Title is required", "Description is required"], []]


def test_decision_ladder_uses_unrounded_scores(spark):
    scores = [0.9, 0.85, 0.849999, 0.65, 0.5, 0.499999, 0.35, -0.2, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    out = [r["d"] for r in df.select(de.decide(F.col("s")).alias("d")).collect()]
    assert out == ["duplicate"] * 2 + ["possible_duplicate"] * 3 + ["new_defect"] * 4
    wide = df.select(de.decide(F.col("s"), duplicate=0.75).alias("d")).collect()
    assert [r["d"] for r in wide][2] == "duplicate"


def test_assigned_cluster(spark):
    df = spark.createDataFrame([(0.5, 3), (0.49, 3), (None, None), (0.9, None)], "s double, c int")
    out = df.select(de.assigned_cluster(F.col("s"), F.col("c")).alias("c")).collect()
    assert [r["c"] for r in out] == [3, -1, -1, -1]


def test_placeholder_buckets(spark):
    ids = spark.range(1, 20001).select(F.format_string("DEF-%05d", "id").alias("i"))
    counts = ids.groupBy(de.placeholder_decision(F.col("i")).alias("d")).count().collect()
    assert {r["d"]: r["count"] for r in counts} == {
        "duplicate": 3506, "possible_duplicate": 4896, "new_defect": 11598,
    }
