"""Pairs of blocks: every pair once, every row stored once; the kernels against brute force."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from bugsieve.operators import cells as ce
from bugsieve.operators import clustering as cl
from bugsieve.operators import kernels as kn
from bugsieve.operators import similarity as sm
from tests.test_similarity import clustered, doc, frame


def test_every_pair_meets_once(spark):
    rows = frame(spark, clustered(90, dim=4, seed=3), "id", doc)

    def kernel(a, b):
        pairs = list(itertools.product(a["id"].to_pylist(), b["id"].to_pylist()))
        return {"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}

    met = ce.map_pairs(rows, rows, kernel, "a string, b string", block_rows=7)
    assert sorted(map(tuple, met.collect())) == sorted(itertools.product([doc(i) for i in range(90)], repeat=2))


def test_blocks_hold_every_row_once(spark):
    rows = frame(spark, clustered(90, dim=4, seed=3), "id", doc)
    blocks = [pa.ipc.open_stream(r["q"]).read_all() for r in ce._packed(rows, "q", 1 << 20, 7).collect()]
    assert sorted(i for b in blocks for i in b["id"].to_pylist()) == [doc(i) for i in range(90)]
    assert len(blocks) > 5


@pytest.mark.parametrize("run", ["density", "profile", "dense", "sparse"])
def test_no_row_is_copied_per_cell(spark, monkeypatch, run):
    """Rows sent to every cell they may have a partner in filled the disks."""

    def refuse(*_, **__):
        raise AssertionError("rows are dealt to cells")

    monkeypatch.setattr(ce, "cell_rows", refuse)
    rows = frame(spark, clustered(60, dim=4, seed=3), "defect_id", doc)
    if run == "density":
        assert cl.density_labels(rows, 0.1, 3).count() == 60
    elif run == "profile":
        assert sm.match_profile(rows.withColumnRenamed("defect_id", "query_id"), rows, 0.5).count() == 60
    elif run == "dense":
        sm.near_duplicates(rows, 0.9, exact=True).collect()
    else:
        sparse = rows.selectExpr(
            "defect_id", "named_struct('indices', transform(vector, (x, i) -> cast(i AS bigint)), "
            "'values', transform(vector, x -> cast(x AS double))) AS vector"
        )
        sm.near_duplicates(sparse, 0.9).collect()


def sparse_rows(m):
    rows = [{"indices": np.flatnonzero(r).tolist(), "values": r[r != 0].tolist()} for r in m]
    return pa.array(rows, pa.struct([("indices", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]))


@pytest.mark.parametrize("min_score", [None, 0.3])
@pytest.mark.parametrize("often", [1, 4, 1000])
def test_postings_find_what_all_products_find(monkeypatch, min_score, often):
    monkeypatch.setattr(kn.Postings, "OFTEN", often)
    monkeypatch.setattr(kn.Postings, "GATHERED", 50)
    rng = np.random.default_rng(7)
    m = rng.random((140, 60)) * (rng.random((140, 60)) < 0.15 * rng.random(60) * 4)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    m[5:9], m[20] = m[4], 0  # copies, and a row without terms
    q, c = m[:50], m[10:]
    ids = np.arange(len(c))
    best = kn.RunningTopK(len(q), 4, min_score)
    for at in range(0, len(c), 40):
        kn.Postings(sparse_rows(c[at : at + 40])).search(sparse_rows(q), best, ids[at : at + 40])
    got = {}
    for i, j, s in zip(*best.found(np.arange(len(q))).values()):
        got.setdefault(int(i), []).append((int(j), float(s)))
    scores = np.round(q @ c.T, 9)
    want = {}
    for i, row in enumerate(scores):
        top = [(j, row[j]) for j in np.lexsort((ids, -row))[:4] if min_score is None or row[j] >= min_score]
        if top:
            want[i] = top
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [int(j) for j, _ in v] for i, v in want.items()}
    assert all(abs(s - w) < 2e-9 for i in want for (_, s), (_, w) in zip(got[i], want[i]))


def test_every_pair_of_blocks_is_met_in_one_order(spark):
    rows = frame(spark, clustered(90, dim=4, seed=3), "id", doc)

    def kernel(a, b, same):
        assert same == (a["id"].to_pylist() == b["id"].to_pylist())
        pairs = list(itertools.product(a["id"].to_pylist(), b["id"].to_pylist()))
        return {"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}

    met = [tuple(r) for r in ce.map_pairs_once(rows, kernel, "a string, b string", block_rows=7).collect()]
    assert len(met) == len(set(met)) < 90 * 90 * 0.6
    assert {*met, *((y, x) for x, y in met)} == set(itertools.product([doc(i) for i in range(90)], repeat=2))


def test_near_duplicates_of_texts_meet_blocks_once(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("every pair of blocks meets twice")

    monkeypatch.setattr(ce, "map_pairs", refuse)
    m = sparse_matrix(60, np.random.default_rng(3))
    rows = spark.createDataFrame(pa.table({"defect_id": [doc(i) for i in range(60)], "vector": sparse_rows(m)}))
    found = sm.near_duplicates(rows, 0.3, 3, block_rows=7)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    scores = np.round(m @ m.T, 9)
    np.fill_diagonal(scores, -1)
    want = {(doc(i), doc(j)) for i, r in enumerate(scores) for j in np.lexsort((np.arange(60), -r))[:3] if r[j] >= 0.3}
    assert {(r["query_id"], r["defect_id"]) for r in found.collect()} == want


def sparse_matrix(n, rng, dim=60, signs=False):
    m = rng.random((n, dim)) * (rng.random((n, dim)) < 0.6 / (1 + np.arange(dim) / 6))
    if signs:
        m *= rng.choice([-1, 1], size=m.shape)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    m[5:9], m[20] = m[4], 0  # copies, and a row without terms
    return m


@pytest.mark.parametrize("listed", [0, 1, 10**6])
@pytest.mark.parametrize("signs", [False, True])
@pytest.mark.parametrize("least", [0.05, 0.5, 0.85])
def test_rare_postings_find_every_pair_that_reaches_a_score(monkeypatch, listed, signs, least):
    monkeypatch.setattr(kn.RarePostings, "LISTED", listed)
    monkeypatch.setattr(kn.RarePostings, "QUERIES", 17)
    monkeypatch.setattr(kn.RarePostings, "NEAR_POSTINGS", 40)
    monkeypatch.setattr(kn.RarePostings, "QUERY_CELLS", 150)
    m = sparse_matrix(150, np.random.default_rng(11), signs=signs)
    q, c = 1.7 * m[:60], m[40:]  # lengths need not be 1
    found = list(kn.reaching_pairs(sparse_rows(q), sparse_rows(c), np.full(len(q), least)))
    got = {(int(i), int(j)): s for row, col, score in found for i, j, s in zip(row, col, score)}
    scores = np.round(q @ c.T, 9)
    assert set(got) == {(int(i), int(j)) for i, j in np.argwhere(scores >= least)}
    assert all(abs(scores[p] - s) < 2e-9 for p, s in got.items())
    ids = np.array([doc(i) for i in range(150)])
    sides = [pa.table({"id": x, "vector": sparse_rows(y)}) for x, y in ((ids[:60], q), (ids[40:], c))]
    both = kn.mutual_top_k(*sides, False, 4, least)
    apart = [kn.block_top_k(a, b, 4, least) for a, b in (sides, sides[::-1])]
    mutual = sorted(zip(both["query_id"], both["defect_id"], np.round(both["score"], 8)))
    assert mutual == sorted(x for p in apart for x in zip(p["query_id"], p["defect_id"], np.round(p["score"], 8)))


def test_rare_postings_of_empty_blocks():
    some, none = sparse_rows(sparse_matrix(30, np.random.default_rng(1))), sparse_rows(np.zeros((3, 4)))
    for a, b in ((some, none), (none, some), (none, none), (some, some.slice(0, 0)), (some.slice(0, 0), some)):
        assert not sum(len(row) for row, _, _ in kn.reaching_pairs(a, b, np.full(len(a), 0.5)))


def test_spanning_edges_keep_every_component_at_every_level():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 80, (2, 300))
    level = rng.integers(0, 5, 300)
    kept = kn.spanning_edges(a, b, level, 80)

    def parts(edges, most):
        label = list(range(80))
        for x, y, at in edges:
            if at <= most and label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if v == old else v for v in label]
        return label

    assert len(kept) == 80 - len(set(parts(zip(a, b, level), 4)))
    for most in range(5):
        assert parts(zip(a, b, level), most) == parts(zip(a[kept], b[kept], level[kept]), most)


def test_sparse_floors_come_from_postings(monkeypatch):
    """Unfolding sparse rows to dense ones, pair of pieces by pair of pieces, took most of a search's time."""

    def refuse(*_):
        raise AssertionError("sparse rows are unfolded")

    monkeypatch.setattr(kn, "products", refuse)
    m = np.eye(6)[[0, 1, 2, 0, 1]] * 0.8 + np.eye(6)[[5, 5, 5, 4, 4]] * 0.6
    table = pa.table({"id": pa.array(range(5)), "vector": sparse_rows(m)})
    side = sm._SharedSide(table)
    side.seed(sparse_rows(m), 2)
    assert side.floor.tolist() == [0.64, 0.64, 0.36, 0.64, 0.64]


def test_many_queries_are_one_scan_of_the_vectors(spark, tmp_path, monkeypatch):
    """Every batch of queries dealt nearly all postings again."""
    from bugsieve.operators import text_index as ti

    words = [f"w{i}" for i in range(30)]
    docs = [(doc(i), [words[(i * j) % 30] for j in range(1, 6)]) for i in range(60)] + [(doc(60), [])]
    index = ti.build(spark.createDataFrame(docs, "defect_id string, tokens array<string>"), str(tmp_path / "index"))
    assert index.vectors.count() == 61
    queries = spark.createDataFrame([(i, t[:3]) for i, (_, t) in enumerate(docs)] + [(99, ["unknown"])], "query_id long, tokens array<string>")
    want = sorted(map(tuple, ti.top_k(index, queries, 4, few=0).collect()))

    def refuse(*_):
        raise AssertionError("postings are dealt per batch")

    monkeypatch.setattr(ti, "_scan", refuse)
    got = sorted(map(tuple, ti.top_k(index, queries, 4, query_bytes=1 << 10, few=0).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and len(got) == 4 * 62
    assert all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(got, want))


def test_statistics_read_the_records_once(spark):
    from bugsieve.plans.build import corpus_statistics

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i % 3 - 1, "low" if i % 2 else None) for i in range(12)], "cluster_id int, severity string")
    out = {(r["metric"], r["key"]): r["value"] for r in corpus_statistics(rows.mapInArrow(counted, rows.schema), 7).collect()}
    assert seen.value == 12
    assert out[("total_records", "")] == 12 and out[("cluster_distribution", "0")] == 4 and out[("severity_distribution", "unknown")] == 6
