"""Sources, sinks, report shaping, listings and audits on hand-written rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from bugsieve.operators import audits as au
from bugsieve.operators import browse as br
from bugsieve.operators import distributions as di
from bugsieve.operators import reports as rp
from bugsieve.operators.numbering import number_rows
from bugsieve.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- sources and sinks ------------------------------------------------------------------


def test_csv_with_quotes_newlines_and_junk_columns(spark, tmp_path):
    (tmp_path / "fix.csv").write_text(
        'Unnamed: 0,Label,Description,Fixing_time\n0,1,"a ""quoted""\nsecond line, more",7\n1,,plain,x\n'
    )
    out = readers.read_csv_reports(spark, str(tmp_path / "fix.csv"), readers.FIX_SCHEMA)
    assert rows(out, "Description", "Fixing_time", "Label") == [
        ('a "quoted"\nsecond line, more', 7, 1), ("plain", None, None),
    ]


def test_tracker_walk_takes_layouts_with_a_description(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "one_bugs.csv").write_text("Summary,Description,Priority\ns1,d1,P1\n")
    (tmp_path / "a" / "deep" / "two_bugs.csv").write_text('Priority,Votes,Description\nP2,3,"d2\nmore"\n')
    (tmp_path / "a" / "bad_bugs.csv").write_text("Summary,Body\nx,y\n")
    (tmp_path / "a" / "other.csv").write_text("Summary,Description,Priority\nno,no,no\n")
    (tmp_path / "a" / "empty_bugs.csv").write_text("")
    out = readers.read_tracker_exports(spark, str(tmp_path))
    got = sorted(out.select("Summary", "Description", "Priority").collect(), key=lambda r: r["Description"])
    assert [tuple(r) for r in got] == [("s1", "d1", "P1"), (None, "d2\nmore", "P2")]
    assert out.filter(F.col("source_file").contains("two_bugs")).count() == 1
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    (nothing / "x_bugs.csv").write_text("Summary\nx\n")
    assert readers.read_tracker_exports(spark, str(nothing)).count() == 0


def test_intake_of_json_and_free_text(spark):
    texts = ['{"title": "T", "severity": "major"}', "plain " * 20, '{"title": "broken', "[1, 2]", '{"a": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = readers.parse_report_text(df).orderBy("i").collect()
    assert (out[0]["title"], out[0]["description"], out[0]["severity"]) == ("T", None, "major")
    assert out[1]["title"] == ("plain " * 20)[:50] and out[1]["description"] == "plain " * 20
    assert out[2]["title"] == '{"title": "broken' and out[2]["description"] == texts[2]
    assert (out[4]["title"], out[4]["description"]) == (None, None)


def test_vocabulary_file_ranks(spark, tmp_path):
    (tmp_path / "v.lst").write_text("</s>\nthe\nto\n")
    assert rows(readers.read_vocabulary(spark, str(tmp_path / "v.lst")), "rank", "token") == [
        (1, "</s>"), (2, "the"), (3, "to"),
    ]


def test_export_quotes_titles(spark, tmp_path):
    df = spark.createDataFrame([("DEF-00001", 'say "hi", now\nx ', None, 4)],
                               "defect_id string, title string, severity string, cluster_id int")
    writers.write_csv_export(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, escape='"', multiLine=True).fillna("").head()
    assert back.asDict() == {
        "ID": "DEF-00001", "Title": 'say "hi", now\nx ', "Severity": "Unknown", "Decision": "",
        "Cluster": "4", "Confidence": "", "Date": "",
    }


def test_json_records_keep_text_unescaped(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("DEF-00001", "é　ü", ["title"])],
                               "defect_id string, title string, missing_fields array<string>")
    writers.write_records(df, path, "json")
    row = readers.read_records(spark, path, "json").head()
    assert row["title"] == "é　ü" and row["missing_fields"] == ["title"] and row["severity"] is None


def test_stats_document(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "key string, n long")
    doc = writers.stats_document(writers.as_stat(df, "m", "key", "n")).head()
    assert doc["metric"] == "m" and json.loads(doc["document"]) == {"a": 2, "b": 1}


# --- shaping -----------------------------------------------------------------------------


def test_numbers_are_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    out = number_rows(df, "v")
    assert out.filter("number != v + 1").count() == 0 and out.count() == 1000


def test_minted_ids_are_not_cut(spark):
    df = spark.range(100_002).withColumnRenamed("id", "v")
    out = rp.mint_ids(df, "v")
    assert out.filter("v = 0").head()["defect_id"] == "DEF-00001"
    assert out.filter("v = 100001").head()["defect_id"] == "DEF-100002"
    capped = rp.cap_rows(out, 100_000)
    assert capped.agg(F.max("v")).head()[0] == 99_999


def test_text_join_fans_out_and_dedupes(spark):
    fixes = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "Description string, Label int")
    sev = spark.createDataFrame([("x", "major"), ("x", "minor")], "Description string, Severity string")
    assert rp.join_severity(fixes, sev).count() == 5
    assert rp.join_severity(fixes, sev.union(sev)).filter("Severity = 'minor'").count() == 4
    assert rp.join_severity(fixes, sev).filter("Description = 'y'").head()["Severity"] is None
    once = rp.join_severity(fixes, sev, dedupe_right=True)
    assert sorted((r["Label"], r["Severity"] or "") for r in once.collect()) == [(1, "major"), (2, "major"), (3, "")]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("d", 1)], "raw_description string, fix_label int")
    b = spark.createDataFrame([("e", "t")], "raw_description string, title string")
    assert {tuple(r) for r in rp.union_reports(a, b).select("raw_description", "title", "fix_label").collect()} == {
        ("d", None, 1), ("e", "t", None),
    }


def test_defaults_and_truncation(spark):
    df = spark.createDataFrame(
        [(None, None, None, " " + "é" * 1200, None)],
        "fixing_time int, fix_label int, logs string, raw_description string, severity string",
    )
    row = rp.with_previews(rp.with_defaults(df)).head()
    assert (row["fixing_time"], row["fix_label"], row["logs"], row["severity"]) == (0, 0, "", None)
    assert row["raw_description_preview"] == "é" * 999 and row["raw_description"] == " " + "é" * 1200


# --- listings -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def listing(spark):
    data = [
        (f"DEF-{i:05d}", f"Title {i} 100% _x", f"Body {i}", ["critical", "Major", None, "minor"][i % 4], i % 3 - 1)
        for i in range(1, 61)
    ]
    df = spark.createDataFrame(data, "defect_id string, title string, raw_description string, severity string, cluster_id int")
    return df.repartition(6).withColumn("decision", F.lit("new_defect"))


def test_search_filters(listing):
    assert br.search_reports(listing, severity="MAJOR").count() == 15
    assert br.search_reports(listing, cluster_id=0, q="body 1").count() == 5  # 1, 10, 13, 16, 19
    assert br.search_reports(listing, q="%").count() == 60  # no wildcards
    assert br.search_reports(listing, q="100_").count() == 0
    assert br.search_reports(listing).count() == 60


def test_screen_filter_looks_at_ids_and_folded_severity(listing):
    assert br.screen_reports(listing, "def-00007").count() == 1
    assert br.screen_reports(listing, severity="High").count() == 15
    assert br.screen_reports(listing, decision="duplicate").count() == 0


def test_pages(listing):
    ids = [r["defect_id"] for r in br.page_of(listing, 2, 25).orderBy("defect_id").collect()]
    assert ids == [f"DEF-{i:05d}" for i in range(26, 51)]
    assert br.page_of(listing, 3, 25).count() == 10 and br.page_of(listing, 4, 25).count() == 0
    after = [r["defect_id"] for r in br.page_after(listing, "DEF-00050", 25).collect()]
    assert after == [f"DEF-{i:05d}" for i in range(51, 61)]
    assert tuple(br.page_totals(listing, 25).head()) == (60, 3)
    assert br.page_of(listing, 1, 100).count() == 60
    for page, size in ((0, 10), (1, 0), (-1, 5), (1, 101)):
        with pytest.raises(ValueError):
            br.page_of(listing, page, size)


def test_deep_pages_are_the_same(spark, monkeypatch):
    ids = [f"DEF-{i:05d}" for i in range(99_950, 100_050)]
    df = spark.createDataFrame([(i,) for i in ids], "defect_id string").repartition(5)
    monkeypatch.setattr(br, "DEEP_ROWS", 10)
    for page in (1, 3, 4, 8):
        got = sorted((r["defect_id"] for r in br.page_of(df, page, 15).collect()), key=lambda x: (len(x), x))
        assert got == ids[(page - 1) * 15 : page * 15]


def test_deep_pages_keep_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, 1), (None, 2)] + [(f"DEF-{i // 2:05d}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "defect_id string, n int").repartition(3)
    whole = sorted((x or "", n) for x, n in rows)
    for deep in (10_000, 5):
        monkeypatch.setattr(br, "DEEP_ROWS", deep)
        pages = [br.page_of(df, page, 7).collect() for page in range(1, 8)]
        assert [len(p) for p in pages] == [7] * 6 + [0]
        ids = [r["defect_id"] or "" for p in pages for r in p]
        assert ids == [x for x, _ in whole]
    assert sorted((r["defect_id"] or "", r["n"]) for p in pages for r in p) == whole  # numbered rows come once


def test_page_directory(spark, tmp_path):
    from bugsieve.operators.pages import PageDirectory

    rows = [(None, 1, None), (None, 2, "x")] + [(f"DEF-{i // 2:05d}", i, "y") for i in range(99_950 * 2, 99_950 * 2 + 300)]
    df = spark.createDataFrame(rows, "defect_id string, number int, slice string").withColumnsRenamed({"number": "n", "slice": "s"})
    built = PageDirectory.build(df.repartition(4), str(tmp_path / "pages"), slice_rows=50)
    assert built.totals(20) == (302, 16)
    got = [tuple(r) for page in range(1, 17) for r in built.page(page, 20).collect()]
    key = lambda r: (len(r[0] or ""), r[0] or "")
    assert sorted(got, key=str) == sorted(rows, key=str) and got == sorted(got, key=key)
    assert built.page(17, 20).count() == 0
    page = built.page(3, 20)  # rows 41 to 60 lie in two slices
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slice#" in plan and "PushedFilters: [IsNotNull(number), GreaterThanOrEqual(number,41)" in plan
    files = page.sparkSession.read.parquet(str(tmp_path / "pages" / "rows")).filter("slice IN (0, 1)").select("slice").distinct()
    assert files.count() == 2
    with pytest.raises(ValueError):
        built.page(0)


def test_lookup_reaches_the_scan(spark, listing, tmp_path):
    writers.write_records(listing, str(tmp_path / "r"))
    found = br.lookup(spark.read.parquet(str(tmp_path / "r")), "DEF-00042").select("defect_id", "title")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(defect_id,DEF-00042)" in plan
    assert "ReadSchema: struct<defect_id:string,title:string>" in plan


def test_lookup_and_recent(listing):
    assert br.lookup(listing, "DEF-00042").count() == 1 and br.lookup(listing, "DEF-99999").count() == 0
    assert [r["defect_id"] for r in br.recent(listing).collect()] == [f"DEF-{i:05d}" for i in range(1, 6)]


def test_cluster_names(spark):
    df = spark.createDataFrame([(0,), (19,), (20,), (-1,)], "cluster_id int")
    names = {r["cluster_id"]: r["cluster_name"] for r in br.clusters_named(df).collect()}
    assert names[0].startswith("C1:") and names[19].startswith("C20:")
    assert names[20] == "Cluster #20" and names[-1] == "Cluster #-1"
    assert br.clusters_named(df, "MEMORY").count() == 0 and br.clusters_named(df, "cluster #2").count() == 1


def test_chain_links_span_partitions(spark):
    data = [(f"DEF-{i:05d}", 0 if i % 3 else -1) for i in range(1, 301)] + [("DEF-99999", 5)]
    df = spark.createDataFrame(data, "defect_id string, cluster_id int").repartition(7)
    members = [d for d, c in data if c == 0]
    got = {(r["source"], r["target"]) for r in br.chain_links(df).collect()}
    assert got == set(zip(members, members[1:]))


# --- distributions and audits ------------------------------------------------------------


def test_cluster_distribution_places_noise_last(spark):
    df = spark.createDataFrame([(-1,), (1000,), (2,), (2,), (None,)], "cluster_id int")
    assert [tuple(r) for r in di.cluster_distribution(df).collect()] == [(2, 2), (1000, 1), (-1, 2)]
    assert di.cluster_count(df).head()["clusters"] == 2


def test_shares_round_half_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 7)], "k string, n long")
    assert rows(di.with_shares(df), "k", "pct_of_total", "pct_of_max") == [("a", 13, 14), ("b", 88, 100)]


def test_severity_distribution_names_nulls(listing):
    assert dict(rows(di.severity_distribution(listing), "severity", "n")) == {
        "critical": 15, "Major": 15, "unknown": 15, "minor": 15,
    }


def test_keywords(spark):
    data = [(0, f"DEF-{i:05d}", t) for i, t in enumerate(["Created by the (Login)", "page. was slow", "again!! x", "q", "r", "late words"])]
    df = spark.createDataFrame(data, "cluster_id int, defect_id string, title string")
    assert di.cluster_keywords(df).head()["keywords"] == "Login,page,slow"


def test_split_is_ordered_and_disjoint(spark):
    df = spark.createDataFrame([(f"DEF-{i:05d}", "s") for i in range(1, 12)], "defect_id string, severity string").repartition(5)
    out = au.ordered_split(df, 8, 2)
    train, test = out.filter("split = 'train'"), out.filter("split = 'test'")
    assert train.count() == 8 and train.agg(F.max("defect_id")).head()[0] == "DEF-00008"
    assert au.split_overlap(train, test).count() == 0 and au.common_ids(train, test).count() == 0
    assert au.ordered_split(df, 0, 5).filter("split = 'test'").count() == 11
    meta = {(r["split"], r["metric"]): r["value"] for r in au.split_metadata(out).collect()}
    assert meta[("train", "ratio")] == 0.7273 and meta[("test", "size")] == 3


def test_audit_checks(spark):
    df = spark.createDataFrame(
        [("DEF-1", "T", "clean text"), ("DEF-2", "nan", "Upper  text"), ("DEF-3", None, " x\ty <b> a@b.c https://x ")],
        "defect_id string, title string, normalized_text string",
    )
    assert tuple(au.critical_nulls(df).head()) == (3, 0, 2)
    low = au.lowercase_audit(df).head()
    assert (low["with_upper"], low["samples"]) == (1, "DEF-2")
    assert tuple(au.artifact_audit(df).head()) == (3, 1, 1, 1, 1)
    assert tuple(au.whitespace_audit(df).head()) == (3, 1, 1, 1)
    checks = {r["check"]: (r["passed"], r["detail"]) for r in au.zero_checks(au.critical_nulls(df)).collect()}
    assert checks == {"bad_id": (True, 0), "bad_title": (False, 2)}


def test_required_fields_report_absent_columns(spark):
    df = spark.createDataFrame([("DEF-1", "　")], "defect_id string, title string")
    out = {r["field"]: (r["present"], r["populated"]) for r in au.required_field_audit(df).collect()}
    assert out["defect_id"] == (True, 1) and out["title"] == (True, 0) and out["logs"] == (False, 0)


def test_audits_make_the_texts_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = [(f"DEF-{i:05d}", t) for i, t in enumerate(["low", "Up", "also Up", "\u00c9tat", None, "x Y", "z"])]
    df = spark.createDataFrame(rows, "defect_id string, normalized_text string").mapInArrow(count, "defect_id string, normalized_text string")
    assert tuple(au.lowercase_audit(df).head()) == (7, 4, "DEF-00001,DEF-00002,DEF-00003")
    assert ran.value == 7


def test_artifact_patterns_meet_few_texts(spark):
    texts = ["", "plain words", "tab\tand\u2003space\n", "a1", "line\n", "http://", "https://x", "http:/x", "a < b", "a <b>", "<>",
             "x@y.z", "@y.z", "x@y", "at @ at.x", None, "\U0001f600", "caf\u00e9"]
    df = spark.createDataFrame([(t,) for t in texts], "normalized_text string")
    known = [t for t in texts if t is not None]
    want = (len(texts), *(sum(bool(re.search(p, t)) for t in known) for p in (r"[^a-zA-Z\s]", "https?://", "<[^>]+>", r"\S+@\S+\.\S+")))
    found = au.artifact_audit(df)
    assert tuple(found.head()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"Contains(normalized_text#" in plan and probe in plan for probe in (", @)", ", <)", ", ://)"))


def test_vector_audits(spark):
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("x", [float("nan"), 1.0])], "defect_id string, embedding array<double>"
    )
    r = spark.createDataFrame([("a",), ("b",), ("c",)], "defect_id string")
    assert tuple(au.vector_completeness(r, v).head()) == (3, 3, 1, 1, 1, 1)
    assert au.dimension_audit(v, 2).head()["passed"] and not au.dimension_audit(v, 3).head()["passed"]
    assert au.norm_audit(v.filter("defect_id = 'a'")).head()["passed"]
    assert au.index_coverage(r, v, v).head()["passed"] and not au.index_coverage(r, v, r.limit(1)).head()["passed"]
