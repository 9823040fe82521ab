"""Every path of the similarity operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugsieve.operators import cells as ce
from bugsieve.operators import similarity as sm
from bugsieve.operators.encoders import TfIdfEncoder, encode_with, unit_vector


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clustered(n, dim=12, centres=6, spread=0.35, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return unit(base[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim)))


def frame(spark, m, key, name=lambda i: i):
    kind = "string" if isinstance(name(0), str) else "long"
    rows = [(name(i), [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{key} {kind}, vector array<double>")


def sparse_frame(spark, m, key, name):
    rows = [
        (name(i), ([int(j) for j in np.nonzero(v)[0]], [float(x) for x in v[np.nonzero(v)[0]]]))
        for i, v in enumerate(m)
    ]
    return spark.createDataFrame(
        rows, f"{key} string, vector struct<indices:array<int>,values:array<double>>"
    )


def doc(i):
    return f"DEF-{i + 1:05d}"


def brute(q, c, k, min_score=None, q_name=lambda i: i, c_name=doc, skip_self=False):
    out = set()
    scores = np.round(q @ c.T, 9)
    for i, row in enumerate(scores):
        order = sorted(range(len(c)), key=lambda j: (-row[j], c_name(j)))
        order = [j for j in order if not (skip_self and i == j) and (min_score is None or row[j] >= min_score)]
        out |= {(q_name(i), c_name(j), r + 1) for r, j in enumerate(order[:k])}
    return out


def pairs(df):
    return {(r["query_id"], r["defect_id"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def dense(spark):
    q, c = clustered(60, seed=1), clustered(300, seed=2)
    return q, c, frame(spark, q, "query_id"), frame(spark, c, "defect_id", doc)


PATHS = {"queries shared": 1 << 20, "corpus shared": None, "batches": 8000}


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("min_score", [None, 0.8, 0.2])
def test_dense_top_k(dense, path, min_score, monkeypatch):
    q, c, qf, cf = dense
    budget = PATHS[path]
    if path == "corpus shared":  # only the side called second fits
        monkeypatch.setattr(sm, "fits", lambda df, b: True)
        budget = 0
    out = sm.top_k_matches(qf, cf, 5, min_score, budget=budget, block_rows=32)
    assert pairs(out) == brute(q, c, 5, min_score)


def test_fewer_rows_than_k(spark, dense):
    q, c, qf, _ = dense
    few = frame(spark, c[:3], "defect_id", doc)
    assert pairs(sm.top_k_matches(qf, few, 5)) == brute(q, c[:3], 5)


def test_empty_sides(spark, dense):
    _, _, qf, cf = dense
    none = cf.filter("defect_id = ''")
    assert sm.top_k_matches(qf, none, 5).count() == 0
    assert sm.top_k_matches(qf.filter("query_id < 0"), cf, 5).count() == 0
    assert sm.top_k_matches(qf, none, 5, 0.5, budget=-1).count() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    c = np.repeat(unit(np.ones((1, 4))), 50, axis=0)
    qf, cf = frame(spark, c[:2], "query_id"), frame(spark, c, "defect_id", doc).repartition(7)
    want = {(i, doc(j), j + 1) for i in range(2) for j in range(5)}
    assert pairs(sm.top_k_matches(qf, cf)) == want
    assert pairs(sm.top_k_matches(qf, cf, budget=100)) == want


def test_sparse_top_k_and_prefix_cells(spark):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((200, 40)) < 0.15, rng.random((200, 40)), 0)
    m[:, 0] += 0.05  # one term in every row
    m = unit(m)
    qf = sparse_frame(spark, m[:50], "query_id", lambda i: f"q{i:03d}")
    cf = sparse_frame(spark, m, "defect_id", doc)
    name = lambda i: f"q{i:03d}"
    assert pairs(sm.top_k_matches(qf, cf)) == brute(m[:50], m, 5, q_name=name)
    for t in (0.3, 0.6, 0.9):
        out = sm.top_k_matches(qf, cf, 5, t, budget=0, block_rows=16)
        assert pairs(out) == brute(m[:50], m, 5, t, q_name=name)


@pytest.mark.parametrize("t", [0.5, 0.9])
def test_near_duplicates_dense_with_a_third_of_copies(spark, t):
    m = clustered(180, seed=9)
    m[::3] = m[0]  # a third of all rows are one report
    m[1::30] = m[1]
    out = sm.near_duplicates(frame(spark, m, "defect_id", doc), t, 4, block_rows=16, exact=True)
    assert pairs(out) == brute(m, m, 4, t, q_name=doc, skip_self=True)


def test_near_duplicates_by_hyperplanes(spark):
    """The default for dense vectors: nearly all pairs are found, and none below the score."""
    m = clustered(600, seed=10)
    m[::3] = m[0]
    df = frame(spark, m, "defect_id", doc)
    exact = pairs(sm.near_duplicates(df, 0.85, 5, block_rows=16, exact=True))
    found = pairs(sm.near_duplicates(df, 0.85, 5, block_rows=16))
    want, got = ({(q, d) for q, d, _ in rows} for rows in (exact, found))
    assert len(want & got) >= 0.95 * len(want)
    scores = (m @ m.T).round(9)
    number = lambda name: int(name.removeprefix("DEF-")) - 1
    assert all(scores[number(q), number(d)] >= 0.85 for q, d in got)


def test_query_batches_are_exact(spark, monkeypatch):
    m = clustered(150, seed=12)
    q, c = frame(spark, m[:60], "query_id"), frame(spark, m, "defect_id", doc)
    whole = pairs(sm.top_k_matches(q, c, 4))
    assert pairs(sm.top_k_matches(q, c, 4, budget=4000)) == whole
    plan = sm.top_k_matches(q, c, 4, budget=4000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_near_duplicates_sparse(spark):
    rng = np.random.default_rng(11)
    m = np.where(rng.random((150, 30)) < 0.2, rng.random((150, 30)), 0)
    m[np.arange(150), rng.integers(0, 30, 150)] += 0.1
    m = unit(m)
    m[::3] = m[0]
    m[100] = 0  # a report without known terms matches nothing
    m[149] = np.eye(30)[29]
    out = sm.near_duplicates(sparse_frame(spark, m, "defect_id", doc), 0.7, 3, block_rows=16)
    assert pairs(out) == brute(m, m, 3, 0.7, q_name=doc, skip_self=True)


def test_hot_keys_take_the_separate_join(spark, monkeypatch):
    from bugsieve.operators import skew

    monkeypatch.setattr(skew, "ALWAYS_COLD", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    m = clustered(120, seed=4)
    m[::3] = m[0]
    out = sm.near_duplicates(frame(spark, m, "defect_id", doc), 0.8, 3, block_rows=16, exact=True)
    assert pairs(out) == brute(m, m, 3, 0.8, q_name=doc, skip_self=True)
    left = spark.range(100).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    sizes = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    joined = skew.join_one_row_per_key(left, sizes, ["k"], "n", 100)
    assert joined.count() == 100 and joined.filter("v != 2 * k").count() == 0


def test_blocks_are_bounded(spark):
    m = np.repeat(clustered(1), 200, axis=0)
    rows = ce.cell_rows(frame(spark, m, "id", doc), None, 0.9, block_rows=20)
    sizes = rows.groupBy("cell", "c_block", "q_block").count().agg(F.max("count")).head()[0]
    assert sizes <= 4 * 20  # two sides, and hashing is uneven


def test_match_profile(dense):
    q, c, qf, cf = dense
    out = {r["query_id"]: (r["n"], round(r["best"], 6)) for r in sm.match_profile(qf, cf, 0.6, block_rows=32).collect()}
    s = q @ c.T
    want = {i: (int((r >= 0.6).sum()), round(float(r.max()), 6)) for i, r in enumerate(s) if (r >= 0.6).any()}
    assert out == want


def test_approximate_search_finds_most(spark):
    q, c = clustered(80, seed=21), clustered(600, seed=21, spread=0.25)
    c[::3] = c[0]
    qf, cf = frame(spark, q, "query_id"), frame(spark, c, "defect_id", doc)
    exact = sm.top_k_matches(qf, cf, 5, 0.6)
    found = sm.lsh_top_k(qf, cf, 0.6, 5, bits=3, block_rows=64)
    row = sm.recall(found, exact).head()
    assert row["expected"] > 50 and row["recall"] > 0.8
    scores = q @ c.T
    for r in found.collect():
        assert abs(r["score"] - scores[r["query_id"], int(r["defect_id"][4:]) - 1]) < 1e-8


def test_projection_keeps_the_main_variance(spark):
    m = clustered(200, seed=8)
    rows = sm.project_2d(frame(spark, m, "defect_id", doc)).select("x", "y").toPandas()
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert np.allclose([rows["x"].var(), rows["y"].var()], values[:2], rtol=1e-6)


def test_unit_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(unit_vector(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_dot_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    assert df.select(sm.dot(F.col("a"), F.col("b")).alias("d")).head()["d"] == 1.0


def test_encoder(spark):
    docs = spark.createDataFrame(
        [("a", ["x", "x", "y"]), ("b", ["y", "z"]), ("c", [])], "defect_id string, tokens array<string>"
    )
    encoder = TfIdfEncoder.fit(docs)
    assert [(r["token"], r["term"]) for r in encoder.terms.orderBy("term").collect()] == [("x", 0), ("y", 1), ("z", 2)]
    assert encoder.dimension == 3 and TfIdfEncoder.fit(docs, size=2).dimension == 2
    out = {r["defect_id"]: r["vector"] for r in encoder.encode(docs).collect()}
    idf = np.log(4 / np.array([2, 3, 2]))
    want = np.array([2, 1, 0]) * idf
    assert out["a"]["indices"] == [0, 1]
    assert np.allclose(out["a"]["values"], (want / np.linalg.norm(want))[:2])
    assert out["c"]["indices"] == [] and out["c"]["values"] == []
    unknown = spark.createDataFrame([("q", ["nope"])], "defect_id string, tokens array<string>")
    assert encoder.encode(unknown).head()["vector"]["indices"] == []


def test_long_rows_are_counted_apart(spark):
    many = [f"w{i % 150}" for i in range(1500)]
    docs = spark.createDataFrame([(1, many), (2, ["w1", "q"])], "defect_id int, tokens array<string>")
    encoder = TfIdfEncoder.fit(docs)
    row = {r["defect_id"]: r["vector"] for r in encoder.encode(docs).collect()}[1]
    assert len(row["indices"]) == 149 and row["indices"] == sorted(row["indices"])  # w1 is in all rows
    assert np.allclose(row["values"], 1 / np.sqrt(149))


def test_copies_of_rare_tokens_are_found(spark):
    """Every token of the corpus counts, however rare it is."""
    rows = [(f"DEF-{i:05d}", [f"common{j}" for j in range(30)] + [f"own{i}"]) for i in range(60)]
    rows += [("DEF-99999", ["seldom", "seen"]), ("DEF-100000", ["seen", "seldom"])]
    docs = spark.createDataFrame(rows, "defect_id string, tokens array<string>")
    vectors = TfIdfEncoder.fit(docs).encode(docs).select("defect_id", "vector")
    found = {(r["query_id"], r["defect_id"]) for r in sm.near_duplicates(vectors, 0.99).collect()}
    assert ("DEF-99999", "DEF-100000") in found and ("DEF-100000", "DEF-99999") in found


def test_ties_go_by_number(spark):
    """Ids pass from five digits to six: the smaller number comes first, not the smaller text."""
    corpus = spark.createDataFrame(
        [(f"DEF-{i:05d}", [1.0, 0.0]) for i in range(99_996, 100_004)], "defect_id string, vector array<double>"
    )
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    found = sm.top_k_matches(asked, corpus, 5).orderBy("rank").collect()
    assert [r["defect_id"] for r in found] == [f"DEF-{i:05d}" for i in range(99_996, 100_001)]


def test_plugged_encoder(spark):
    df = spark.createDataFrame([(i, "ab" * i) for i in range(5)], "i int, normalized_text string")

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    out = encode_with(df, load, batch_size=2).orderBy("i").collect()
    assert [len(r["vector"]) for r in out] == [2] * 5
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-6 for r in out)


def test_seeded_floors_keep_the_rows_of_many_tasks_few(spark):
    import numpy as np
    from pyspark.sql import types as T

    from bugsieve.operators import similarity as sm

    rng = np.random.default_rng(17)
    x = rng.normal(size=(4000, 16))
    corpus = spark.createDataFrame([(f"DEF-{i:05d}", [float(c) for c in v]) for i, v in enumerate(x)], "defect_id string, vector array<double>")
    queries = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x[:20])], "query_id long, vector array<double>")
    schema = sm._match_schema(T.LongType(), T.StringType())

    def scanned(tasks):
        sides = (sm._sided(df, key, "vector") for df, key in ((queries, "query_id"), (corpus.repartition(tasks), "defect_id")))
        return sm._scan_corpus(*sides, 5, None, schema)

    few, many = scanned(sm.SEED_TASKS).count(), scanned(4 * sm.SEED_TASKS).count()
    # Of 4,000 rows, 512 give the floor: some 40 of a query reach it, however the rest is cut.
    assert many < 1.2 * few + 100 and many < 20 * 60 < 20 * 5 * sm.SEED_TASKS
    best = lambda df: sorted((r["query_id"], r["rank"], r["defect_id"]) for r in df.collect())
    one, spread = (sm.top_k_matches(queries, corpus.repartition(n), 5) for n in (1, 2 * sm.SEED_TASKS))
    assert best(one) == best(spread)
