"""Dense products in single precision first: the same best rows, few products in double precision."""

import numpy as np
import pyarrow as pa
import pytest

from bugsieve.operators import kernels as kn


def rows(m):
    return kn.DenseRows(pa.array(m.tolist(), pa.list_(pa.float64())))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e300])
@pytest.mark.parametrize("least", [None, 0.2])
def test_best_rows_equal_all_products(monkeypatch, scale, least):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(600, 8)) * scale
    c[5], c[300] = c[4], c[4]  # ties
    offered, real = [], kn.RunningTopK.offer
    monkeypatch.setattr(kn.RunningTopK, "offer", lambda self, row, s, ids: offered.append(len(row)) or real(self, row, s, ids))
    new, old = kn.RunningTopK(40, 5, least), kn.RunningTopK(40, 5, least)
    made = []
    monkeypatch.setattr(kn.RunningTopK, "add", lambda self, *a: made.append(1) or kn_add(self, *a))
    for at in range(0, 600, 100):
        kn.offer_products(rows(q), rows(c[at : at + 100]), new, np.arange(at, at + 100))
    whole = len(made)
    for at in range(0, 600, 100):
        old.add(0, q @ c[at : at + 100].T, np.arange(at, at + 100))
    a, b = new.found(np.arange(40)), old.found(np.arange(40))
    assert a["query_id"].tolist() == b["query_id"].tolist() and a["defect_id"].tolist() == b["defect_id"].tolist()
    assert a["score"] == pytest.approx(b["score"], rel=1e-12, abs=1e-9)
    assert whole == (6 if scale == 1e300 else 1 if least is None else 0)


kn_add = kn.RunningTopK.add


def test_rows_that_are_no_numbers_are_no_match():
    c = np.ones((30, 3))
    c[7] = np.nan
    best = kn.RunningTopK(2, 3, 0.5)
    kn.offer_products(rows(np.ones((2, 3))), rows(c), best, np.arange(30))
    assert best.found(np.arange(2))["defect_id"].tolist() == [0, 1, 2] * 2
