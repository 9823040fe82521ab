"""Loading reports from CSV: no task reads a share of the input that does not shrink."""

from pathlib import Path

from bugsieve.plans import build, queries_tables as qt


def test_load_by_splits_equals_load_by_files(spark, tmp_path):
    texts = ['a "quoted" word', "two\nlines, one comma", "plain", "two\nlines, one comma", "last"] * 20
    rows = [(f"{t} {i // 7}", i, i % 2) for i, t in enumerate(texts)]
    options = {"header": True, "quote": '"', "escape": '"'}
    fixes = spark.createDataFrame(rows, "Description string, Fixing_time int, Label int").coalesce(1)
    fixes.write.options(**options).csv(f"{tmp_path}/fix")
    fixes.selectExpr("Description", "cast(Label AS string) AS Severity").write.options(**options).csv(f"{tmp_path}/sev")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        want, got = (
            sorted(map(tuple, build.load_reports(spark, f"{tmp_path}/fix", f"{tmp_path}/sev", split=s).collect()), key=repr)
            for s in (False, True)
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and len(got) >= 100


def test_more_input_makes_more_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, real = [], build.load_reports
    monkeypatch.setattr(build, "load_reports", lambda s, fix, sev: seen.append(fix) or real(s, fix, sev))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        found = qt.pr3_load_order(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(found) == 40
    assert len(list(Path(seen[0].removeprefix("file:")).glob("part-*"))) >= 7
