"""Top-k over the impact-ordered index against all products."""

import numpy as np
import pytest

from bugsieve.llm import impact

SCHEMA = "vec_id long, embedding array<float>, score int, place int, x string"


def ranked(rows, every, k):
    """(query, rank, id, score) by all products; rows are (id, vector)."""
    sound = [
        (i, [int(np.floor(256 * float(np.float32(c)))) for c in v])
        for i, v in rows
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    out = []
    for n, (i, q) in enumerate(sound):
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(sound) if m != n]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(others)[:k])]
    return sorted(out)


def found(spark, rows, every=5, k=5):
    given = spark.createDataFrame([(i, v, 1, 2, "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in impact.search(given, every=every, k=k).collect())


def test_spread_and_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    spread = rng.normal(size=(300, 24))
    tight = centres[rng.integers(0, 6, 400)] + 0.05 * rng.normal(size=(400, 24))
    rows = [(i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(np.concatenate([spread, tight]))]
    assert found(spark, rows, every=20) == ranked(rows, 20, 5)


def test_copies_ties_and_repeated_ids(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(120)] + [(5, same), (5, [0.5, 0.5, 0.5]), (10, None)]
    assert found(spark, rows) == ranked(rows, 5, 5)


def test_vectors_that_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, []), (10, [1.0, 2.0, 3.0]), (-5, [-1.0, -1.0])]
    bad = [(None, [1.0, 1.0]), (15, None), (20, [1.0, None]), (25, [float("nan")]), (30, [float("inf"), 0.0])]
    assert found(spark, good + bad) == ranked(good, 5, 5)
    assert found(spark, bad) == [] and found(spark, []) == [] and found(spark, good[:1]) == []


def test_large_components_and_zeros(spark):
    rows = [(i, [float(1 << (i % 17)), 0.0, -3.0 * i]) for i in range(60)] + [(65, [0.0, 0.0, 0.0])]
    assert found(spark, rows) == ranked(rows, 5, 5)


@pytest.mark.parametrize("least", [-np.inf, 0, 6000, 14000, 30000])
def test_members_miss_none(least):
    rng = np.random.default_rng(7)
    x = rng.integers(-130, 130, (500, 16))
    block = impact.Block(impact.indexed_block(np.arange(500), np.arange(500), x))
    for q in x[:20]:
        scores = x @ q
        members = block.members(q, least)
        assert set(np.flatnonzero(scores >= least)) <= set(members)
        assert np.array_equal(block.scores(q, members), scores[members])


def test_processing_stops_on_proof():
    """With a high least score only few vectors are left to score."""
    rng = np.random.default_rng(9)
    x = np.floor(256 * (v := rng.normal(size=(4000, 64))) / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    block = impact.Block(impact.indexed_block(np.arange(4000), np.arange(4000), x))
    assert len(block.members(x[0], 0.6 * 65536)) <= 3 * 4000 / impact.ROUNDS


def test_segments_hold_every_vector_once():
    x = np.random.default_rng(3).integers(-200, 200, (77, 5))
    row = impact.indexed_block(np.arange(77), np.arange(77), x)
    lists = np.frombuffer(row["lists"], np.int32).reshape(5, 77)
    ends = np.frombuffer(row["ends"], np.int32).reshape(5, impact.LEVELS)
    assert (np.sort(lists, 1) == np.arange(77)).all() and (ends[:, -1] == 77).all()
    quantum = int(np.abs(x).max()) // impact.LEVELS + 1
    for t in range(5):
        sizes = np.abs(x[lists[t], t]) // quantum
        assert (np.diff(sizes) <= 0).all()


def test_batches_of_queries(spark):
    from bugsieve.session import scratch_path

    rng = np.random.default_rng(11)
    rows = [(i, [float(c) for c in rng.normal(size=8)]) for i in range(200)]
    given = impact.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    path = scratch_path(spark, "impact-test")
    impact.build(given, path, block_rows=16)
    some = impact.top_k(given, given.filter("vec_id % 5 = 0"), 3, path, seeds=10, batch_bytes=2000)
    assert sorted(tuple(r) for r in some.collect()) == ranked(rows, 5, 3)
