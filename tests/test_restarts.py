"""KMeans with all restarts in one scan against plain Lloyd runs."""

import numpy as np
import pytest

from bugsieve.operators import restarts as rs


def frame(spark, x):
    rows = [(f"DEF-{i:05d}", [float(c) for c in v], -1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "defect_id string, vector array<double>, cluster_id int").repartition(5)


def blobs(n=400, k=6, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    return 3 * rng.normal(size=(k, dims))[rng.integers(0, k, n)] + rng.normal(size=(n, dims))


def lloyd(x, centres, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.stack([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.abs(moved - centres).max() <= 1e-12:
            break
        centres = moved
    return centres, ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_every_run_is_a_plain_run(spark):
    x = blobs()
    runs = rs.fit(frame(spark, x), 6, restarts=4, seed=7)
    table = frame(spark, x)
    from pyspark.sql import functions as F

    order = table.orderBy(F.xxhash64("vector")).select("vector").toPandas()["vector"]
    sample = np.stack([np.array(v) for v in order])
    single = [lloyd(x, rs.starting_centres(sample, 6, 7 + i), 300) for i in range(4)]
    assert np.allclose(runs.costs, [cost for _, cost in single])
    assert all(np.allclose(c, want, atol=1e-9) for c, (want, _) in zip(runs.centres, single))
    assert runs.rounds < sum(3 for _ in single) * 30 and runs.best == int(np.argmin([c for _, c in single]))


def test_a_round_is_one_pass_for_all_runs(spark, monkeypatch):
    passes = []
    whole = rs._round
    monkeypatch.setattr(rs, "_round", lambda p, c, k: passes.append(len(c)) or whole(p, c, k))
    runs = rs.fit(frame(spark, blobs()), 6, restarts=5)
    assert len(passes) == runs.rounds and passes[0] == 30 and passes == sorted(passes, reverse=True)


def test_labels(spark):
    x = blobs()
    got = rs.labels(frame(spark, x), 6, restarts=3)
    assert got.columns == ["defect_id", "vector", "cluster_id"]
    rows = got.collect()
    sizes = np.bincount([r["cluster_id"] for r in rows], minlength=6)
    assert len(rows) == 400 and (np.diff(sizes) <= 0).all()
    means = np.stack([np.mean([r["vector"] for r in rows if r["cluster_id"] == i], axis=0) for i in range(6)])
    for r in rows:
        assert ((means - np.array(r["vector"])) ** 2).sum(1).argmin() == r["cluster_id"]


def test_fewer_distinct_rows_than_centres_and_none(spark):
    same = np.ones((30, 4))
    assert {r["cluster_id"] for r in rs.labels(frame(spark, same), 3, restarts=2).collect()} == {0}
    with pytest.raises(ValueError):
        rs.fit(frame(spark, same).limit(0), 3)
