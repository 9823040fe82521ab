"""Decisions, the batch build and streaming, end to end on a small corpus."""

import pytest
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.operators import triage as tr
from bugsieve.operators.reports import evaluate_once
from bugsieve.plans import build
from bugsieve.sources import readers
from bugsieve.streaming.analysis import ARRIVAL_SCHEMA, read_arrivals, stream_analysis

TOPICS = ["browser tab crashes when printing", "database query returns stale rows",
          "login page rejects valid password", "editor freezes while scrolling code"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    fix = ["Description,Fixing_time,Label,Unnamed: 0"]
    sev = ["Description,Severity"]
    for i in range(40):
        text = f"Bug: {TOPICS[i % 4]} variant {'abcdefghij'[i % 10] * 4} alpha{'xyz'[i % 3]}"
        fix.append(f"{text},{i},1,{i}")
        if i % 5:
            sev.append(f"{text},{['critical', 'major', 'minor'][i % 3]}")
    fix.append("tiny,1,1,99")  # too short to be kept
    (root / "fix.csv").write_text("\n".join(fix) + "\n")
    (root / "sev.csv").write_text("\n".join(sev) + "\n")
    (root / "git").mkdir()
    (root / "git" / "proj_bugs.csv").write_text(
        "Summary,Description,Priority\nGiven title,the scheduler loses queued tasks after restart,P1\n"
    )
    raw = build.load_reports(spark, str(root / "fix.csv"), str(root / "sev.csv"), str(root / "git"))
    out = str(root / "out")
    encoder = build.build_corpus(raw, out, k=4, restarts=2)
    return root, out, encoder


def test_build_writes_whole_records(spark, corpus):
    _, out, encoder = corpus
    records = spark.read.parquet(f"{out}/records")
    assert records.columns == [f.name for f in readers.RECORD_SCHEMA.fields]
    ids = {r["defect_id"] for r in records.select("defect_id").collect()}
    base = {f"DEF-{i:05d}" for i in range(1, 43)}
    assert len(ids) == 41 and ids < base  # one id is a gap: the short report
    last = records.filter("title = 'Given title'").head()
    assert last["defect_id"] == "DEF-00042" and last["severity"] == "P1" and last["fixing_time"] == 0
    assert records.filter("cluster_id not between 0 and 3").count() == 0
    first = records.filter("defect_id = 'DEF-00002'").head()
    assert first["title"].startswith(TOPICS[1]) and "steps" in first["missing_fields"]
    meta = spark.read.json(f"{out}/model").head()
    assert (meta["dimension"], meta["index_size"]) == (encoder.dimension, 41)
    stats = {(r["metric"], r["key"]): r["value"] for r in spark.read.parquet(f"{out}/statistics").collect()}
    assert stats[("total_records", "")] == 41 and stats[("noise_points", "")] == 0
    assert spark.read.parquet(f"{out}/index").count() == 41


def reports(spark):
    rows = [
        ("r1", TOPICS[0] + " variant aaaa alphax", None, None),
        ("r2", "Completely different", "zebra giraffe elephant unknown words only here", "major"),
        ("r3", "short", None, None),
        ("r4", None, "Defect - login page rejects valid password", None),
        ("r5", " ", None, None),
    ]
    df = spark.createDataFrame(rows, "report_id string, title string, description string, severity string")
    blank = F.lit(None).cast("string")
    return df.withColumns({c: blank for c in ("steps", "expected", "actual", "environment", "logs")})


def _tables(spark, out):
    return spark.read.parquet(f"{out}/records"), spark.read.parquet(f"{out}/vectors")


def test_analysis_of_a_batch(spark, corpus):
    _, out, encoder = corpus
    records, vectors = _tables(spark, out)
    got = {r["report_id"]: r for r in tr.analyze(reports(spark), records, vectors, encoder).collect()}
    assert set(got) == {"r1", "r2", "r4"}
    assert got["r1"]["decision"] == "duplicate" and got["r1"]["confidence"] > 0.95
    assert got["r1"]["cluster_id"] == records.filter("defect_id = 'DEF-00001'").head()["cluster_id"]
    assert [m["rank"] for m in got["r1"]["top_matches"]] == [1, 2, 3, 4, 5]
    assert got["r1"]["top_matches"][0]["defect_id"] == "DEF-00001"
    assert "(Similar to DEF-00001: " in got["r1"]["improved_report"]["summary"]
    assert got["r2"]["decision"] == "new_defect" and got["r2"]["cluster_id"] == -1
    assert "severity" not in [m["field"] for m in got["r2"]["missing_fields"]]
    assert got["r4"]["improved_report"]["title"] == "login page rejects valid password"
    links = tr.new_links(
        spark.createDataFrame([("a", "duplicate", "x"), ("b", "new_defect", "y")],
                              "query_id string, decision string, best_match string")
    )
    assert [tuple(r) for r in links.collect()] == [("a", "x")]


def test_enhancement_and_search(spark, corpus):
    _, out, encoder = corpus
    records, vectors = _tables(spark, out)
    got = {r["report_id"]: r for r in tr.enhance(reports(spark), records, vectors, encoder).collect()}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert got["r4"]["title"] == "[ENHANCED] login page rejects valid password"
    asked = spark.createDataFrame([("q1", "stale database rows"), ("q2", "ab")], "query_id string, query string")
    found = tr.search(asked, records, vectors, encoder, k=3).orderBy("rank").collect()
    assert [r["query_id"] for r in found] == ["q1"] * 3
    assert all(TOPICS[1] in r["title"] for r in found)
    assert tr.search(asked, records, vectors, encoder, k=50).count() == 41
    for k in (0, 51):
        with pytest.raises(ValueError):
            tr.search(asked, records, vectors, encoder, k=k)
    turned_away = tr.rejected(tr.admit_for_search(asked)).collect()
    assert [(r["query_id"], r["reasons"]) for r in turned_away] == [("q2", ["Query too short"])]


def test_stream_gives_the_batch_rows(spark, corpus, tmp_path):
    _, out, encoder = corpus
    records, vectors = _tables(spark, out)
    batch = reports(spark).select([f.name for f in ARRIVAL_SCHEMA.fields])
    batch.filter("report_id < 'r3'").write.json(str(tmp_path / "in"))
    args = (records, vectors, encoder, str(tmp_path / "out"), str(tmp_path / "state"))

    def drain():
        stream_analysis(read_arrivals(spark, str(tmp_path / "in")), *args, available_now=True).awaitTermination()

    drain()
    batch.filter("report_id >= 'r3'").write.mode("append").json(str(tmp_path / "in"))
    drain()
    drain()  # nothing new: nothing is analysed twice
    columns = ["report_id", "decision", "confidence", "cluster_id"]
    streamed = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    direct = tr.analyze(reports(spark), records, vectors, encoder).select(*columns).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, direct))


def test_severity_vote_ties_go_to_the_best_rank(spark):
    rows = [(1, 1, "minor"), (1, 2, "major"), (1, 3, "major"), (1, 4, "minor"), (1, 5, None),
            (2, 1, ""), (2, 2, None), (3, 1, "a"), (3, 2, "b"), (3, 3, "b")]
    df = spark.createDataFrame(rows, "query_id int, rank int, severity string")
    assert {r[0]: r[1] for r in tr.vote_severity(df).collect()} == {1: "minor", 3: "b"}


def test_decision_uses_unrounded_score(spark):
    rows = [(1, 1, "d", 0.84999999, 3), (2, 1, "d", 0.85, 3), (2, 2, "e", 0.6, 3), (2, 3, "f", 0.6, 4)]
    df = spark.createDataFrame(rows, "query_id int, rank int, defect_id string, score double, cluster_id int")
    out = {r["query_id"]: r for r in tr.decide_matches(df).collect()}
    assert (out[1]["decision"], out[1]["confidence"]) == ("possible_duplicate", 0.85)
    assert (out[2]["decision"], out[2]["same_cluster"], out[2]["cluster_id"]) == ("duplicate", 2, 3)


def test_overrides_and_accepting_an_enhancement(spark):
    decided = spark.createDataFrame([("a", "new_defect"), ("b", "new_defect")], "query_id string, decision string")
    marked = spark.createDataFrame([("a",), ("a",)], "query_id string")
    assert dict(tr.apply_overrides(decided, marked).collect()) == {"a": "duplicate", "b": "new_defect"}
    forms = spark.createDataFrame([("a", "t", "d", "minor"), ("b", "t2", "d2", "minor")],
                                  "report_id string, title string, description string, severity string")
    improved = spark.createDataFrame([("a", "", "better", "MAJOR")],
                                     "report_id string, title string, summary string, suggested_severity string")
    out = {r["report_id"]: tuple(r)[1:] for r in tr.accept_enhancement(forms, improved).collect()}
    assert out == {"a": ("t", "better", "major"), "b": ("t2", "d2", "minor")}


def test_attach_with_many_matches(spark, monkeypatch):
    from bugsieve.operators import skew

    monkeypatch.setattr(tr, "ALWAYS_COLD", 10)
    monkeypatch.setattr(skew, "ALWAYS_COLD", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    matches = spark.range(200).select(
        F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("defect_id")
    )
    records = matches.select("defect_id").distinct().withColumn("title", F.upper("defect_id"))
    out = tr.attach(matches, records, "title")
    assert out.count() == 200 and out.filter("title != upper(defect_id)").count() == 0


def test_costly_columns_are_computed_once(spark):
    df = evaluate_once(spark.range(3), {"r": F.rand(1), "s": F.col("id") + 1})
    both = df.filter("r >= 0").select("r", F.col("r").alias("again"), "s").collect()
    assert all(x["r"] == x["again"] for x in both) and [x["s"] for x in both] == [1, 2, 3]


def test_thresholds_are_fixed():
    assert (fv.DUPLICATE_THRESHOLD, fv.POSSIBLE_DUPLICATE_THRESHOLD, fv.TOP_MATCHES) == (0.85, 0.5, 5)
