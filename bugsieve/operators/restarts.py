"""KMeans with all restarts in one scan: a round reads the vectors once, however many runs are left.

The centres of all runs are one matrix.  A task multiplies its vectors with all of them, assigns each
vector once per run, and hands on sums, counts and costs per centre; these are added up by centre, so
what reaches the driver is one row per centre.  Runs that have settled leave the matrix.  Starting
centres are drawn from a bounded sample, far ones more likely (k-means++).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.operators import kernels as kn
from bugsieve.session import cut_lineage, ship_package

SAMPLE_ROWS = 16384  # rows the starting centres are drawn from, those with the smallest hashes
_SUMS = "centre int, n long, cost double, total binary"


@dataclass(frozen=True)
class Runs:
    """Centres and costs of all runs, and how often the vectors were read."""

    centres: np.ndarray  # run, centre, dimension
    costs: np.ndarray
    rounds: int

    @property
    def best(self) -> int:
        return int(np.argmin(self.costs))


def starting_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn with the squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = nearest.sum()
        chosen.append(int(rng.choice(len(sample), p=nearest / total)) if total > 0 else int(rng.integers(len(sample))))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _assigned(x: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each run, and the squared distance to it, per row and run."""
    distance = (centres * centres).sum(1) - 2 * (x @ centres.T) + (x * x).sum(1)[:, None]
    by_run = distance.reshape(len(x), -1, k)
    near = by_run.argmin(2)
    return near, np.maximum(np.take_along_axis(by_run, near[:, :, None], 2)[:, :, 0], 0)


def _round(points: DataFrame, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and costs per centre of one pass over the points."""
    dims = centres.shape[1]
    shared = points.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("centre", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), ("total", pa.binary())])

    def rows(totals: np.ndarray, counts: np.ndarray, costs: np.ndarray) -> pa.RecordBatch:
        hit = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(hit.astype(np.int32)), pa.array(counts[hit]), pa.array(costs[hit]), pa.array([totals[i].tobytes() for i in hit], pa.binary())],
            schema=schema,
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        totals, counts, costs = np.zeros((len(c), dims)), np.zeros(len(c), np.int64), np.zeros(len(c))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = kn.to_matrix(whole["vector"].slice(at, 4096))
                near, apart = _assigned(x, c, k)
                for run in range(near.shape[1]):
                    of = near[:, run] + run * k
                    member = np.zeros((len(c[run * k : (run + 1) * k]), len(x)))
                    member[near[:, run], np.arange(len(x))] = 1
                    totals[run * k : (run + 1) * k] += member @ x
                    counts += np.bincount(of, minlength=len(c))
                    costs += np.bincount(of, apart[:, run], len(c))
        yield rows(totals, counts, costs)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts, costs = np.zeros((len(centres), dims)), np.zeros(len(centres), np.int64), np.zeros(len(centres))
        for batch in batches:
            at = batch["centre"].to_numpy()
            for i, n, cost, total in zip(at, batch["n"].to_numpy(), batch["cost"].to_numpy(), batch["total"].to_pylist()):
                totals[i] += np.frombuffer(total)
                counts[i] += n
                costs[i] += cost
        yield rows(totals, counts, costs)

    found = points.mapInArrow(partial, _SUMS).repartition("centre").mapInArrow(added, _SUMS).toArrow()
    totals, counts, costs = np.zeros((len(centres), dims)), np.zeros(len(centres), np.int64), np.zeros(len(centres))
    at = found["centre"].to_numpy()
    if len(at):
        counts[at], costs[at] = found["n"].to_numpy(), found["cost"].to_numpy()
        totals[at] = np.stack([np.frombuffer(t) for t in found["total"].to_pylist()])
    return totals, counts, costs


def fit(vectors: DataFrame, k: int, restarts: int = 10, max_iter: int = 300, seed: int = 42, vector: str = "vector") -> Runs:
    """All runs until their centres stay where they are, at most ``max_iter`` rounds."""
    ship_package(vectors.sparkSession)
    points = cut_lineage(vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("vector")))
    taken = points.orderBy(F.xxhash64("vector")).limit(SAMPLE_ROWS).toArrow()
    if not taken.num_rows:
        raise ValueError("no vectors to cluster")
    sample = kn.to_matrix(taken["vector"])
    centres = np.stack([starting_centres(sample, k, seed + i) for i in range(restarts)])
    costs, moving, rounds = np.full(restarts, np.inf), np.arange(restarts), 0
    while len(moving) and rounds < max_iter:
        flat = centres[moving].reshape(-1, centres.shape[2])
        totals, counts, per_centre = _round(points, flat, k)
        rounds += 1
        new = np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None], flat)
        costs[moving] = per_centre.reshape(len(moving), k).sum(1)
        settled = np.abs(new - flat).reshape(len(moving), -1).max(1) <= 1e-12
        centres[moving] = new.reshape(len(moving), k, -1)
        moving = moving[~settled]
    return Runs(centres, costs, rounds)


def labels(
    vectors: DataFrame, k: int = fv.N_CLUSTERS, restarts: int = 10, max_iter: int = 300, seed: int = 42, vector: str = "vector"
) -> DataFrame:
    """``cluster_id`` of every row by the run of least cost; numbers are ranks by size."""
    runs = fit(vectors, k, restarts, max_iter, seed, vector)
    best = runs.centres[runs.best]
    shared = vectors.sparkSession.sparkContext.broadcast(best)
    inner = vectors.select(F.transform(vector, lambda x: x.cast("double")).alias("_v"), F.struct(*vectors.columns).alias("_row"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                near = _assigned(kn.to_matrix(part["_v"]), shared.value, k)[0][:, 0]
                yield pa.RecordBatch.from_arrays([part["_row"], pa.array(near.astype(np.int32))], names=["_row", "_near"])

    schema = inner.select("_row", F.lit(0).alias("_near")).schema
    placed = cut_lineage(inner.mapInArrow(assign, schema))
    sizes = {r["_near"]: r["count"] for r in placed.groupBy("_near").count().collect()}
    order = sorted(range(k), key=lambda i: (-sizes.get(i, 0), i))
    rank = F.create_map(*[F.lit(x) for at, i in enumerate(order) for x in (i, at)])
    kept = [c for c in vectors.columns if c != "cluster_id"]
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in kept], rank[F.col("_near")].alias("cluster_id"))
