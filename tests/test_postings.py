"""Best rows by postings: equal to all products, and frequent terms are not added posting by posting."""

import numpy as np
import pyarrow as pa
import pytest

from bugsieve.operators import kernels as kn


def sparse(rng, n, size, terms=400):
    chance = 1 / np.arange(1, terms + 1)
    rows = [np.unique(rng.choice(terms, size, p=chance / chance.sum())) for _ in range(n)]
    weights = [rng.random(len(r)) for r in rows]
    columns = [pa.array([r.tolist() for r in rows], pa.list_(pa.int64())), pa.array([(w / np.linalg.norm(w)).tolist() for w in weights], pa.list_(pa.float64()))]
    return pa.StructArray.from_arrays(columns, ["indices", "values"])


@pytest.mark.parametrize("least", [None, 0.3, 0.9])
@pytest.mark.parametrize("matrix_bytes", [64 << 20, 3000])
def test_best_rows_equal_all_products(monkeypatch, least, matrix_bytes):
    monkeypatch.setattr(kn.Postings, "MATRIX_BYTES", matrix_bytes)
    rng = np.random.default_rng(5)
    rows, queries = sparse(rng, 700, 40), sparse(rng, 60, 12)
    block, added, real = kn.Postings(rows), [], kn.Postings._added
    df = np.diff(block.starts)
    monkeypatch.setattr(kn.Postings, "_added", lambda self, out, row, term, weight: added.extend(term) or real(self, out, row, term, weight))
    best = kn.RunningTopK(60, 5, least)
    ids = np.arange(700)
    block.search(queries, best, ids)
    block.search(queries, best, ids + 700)  # with floors from the first
    found = best.found(np.arange(60))
    scores = np.round(np.tile(kn.to_matrix(queries, block.terms) @ kn.to_matrix(rows, block.terms).T, 2), kn.SCORE_DECIMALS)
    want = []
    for q, s in enumerate(scores):
        order = np.lexsort((np.arange(1400), -s))[:5]
        want += [(q, int(i), s[i]) for i in order if least is None or s[i] >= least]
    got = list(zip(found["query_id"].tolist(), found["defect_id"].tolist(), found["score"].tolist()))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    if matrix_bytes > 10**6:
        assert len(added) and (df[added] * kn.Postings.OFTEN <= 700).all()
