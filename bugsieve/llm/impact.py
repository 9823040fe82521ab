"""Exact top-k inner products over an impact-ordered index, processed score at a time.

Components are made integers (``floor(scale * x)``).  The index is a table of blocks of
vectors.  In a block every dimension has a posting list of all its vectors, in descending order of
the quantised size of the component, cut into segments of equal quantised size.  A query takes the
segments of all its dimensions in descending *impact*, the product of its own component with
the size of the segment, and adds each posting to the accumulators of its vector: the
score so far, and how much of the squared length of the vector and of the query has been seen.

What is still missing of a score is at most the product of the two lengths not yet seen (Cauchy and
Schwarz).  A vector whose score so far plus this bound stays below the query's least useful
score is no member; processing stops when the possible members left are cheaper to score than the
next segments are to add, and these are then scored exactly over all dimensions.  So stopping
rests on the bound alone and the answer is exact, whatever the data; evenly spread vectors just take
more segments.

Plan: the vectors are checkpointed, the index is written to the shared folder.  Queries grow with
the table, so they come in batches of ``batch_bytes``, and each batch is one scan of the index, which
is neither copied nor shuffled.  The least useful score of a query starts as its k-th best among
``SEEDS`` vectors and rises with every block a task has seen.  A task gives k rows per query at most.

Cases: vectors that are null or hold a null, an infinity or a NaN, and rows without an id, take no
part, neither as query nor as candidate.  Rows of one id are rows of their own: a query is
answered by the other rows of its id as well, and every row of a queried id is a query.  Equal scores go
to the smaller id.  Vectors of different lengths are compared over the dimensions both have; an
empty vector scores 0.  Fewer than k other rows give fewer answers; an empty table gives none.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.session import cut_lineage, scratch_path, ship_package, spread

SCALE = 256
BLOCK_ROWS = 16384
LEVELS = 32  # quantised sizes of a component within a block
ROUNDS = 16  # the bound is looked at after so many shares of the postings
SCORED = 3  # so many shares of the vectors are cheaper to score than further postings are to add
SEEDS = 2048  # vectors that give a query its first least useful score
BATCH_BYTES = 32 << 20

_INDEX = "n int, dims int, width int, ids binary, places binary, dense binary, lists binary, ends binary"
_ANSWER = "place long, query_id long, vec_id long, score long"


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component, null for vectors that take no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def prepared(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(place, vec_id, x)``: the vectors that take part; ``place`` tells rows of one id apart."""
    rows = spread(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), integers(F.col(f"`{vector}`"), scale).alias("x")))
    return cut_lineage(
        rows.filter("vec_id IS NOT NULL AND x IS NOT NULL").select(F.monotonically_increasing_id().alias("place"), "vec_id", "x")
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows of a matrix, the shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    if dims * len(sizes) == len(flat):
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def indexed_block(ids: np.ndarray, places: np.ndarray, x: np.ndarray) -> dict:
    """One row of the index: the vectors of a block, their posting lists and the ends of the segments.

    ``lists[t]`` are the vectors by descending level of component ``t``; the segment of level ``l`` ends
    at ``ends[t, LEVELS - 1 - l]``.
    """
    n, dims = x.shape
    largest = int(np.abs(x).max(initial=0))
    quantum = largest // LEVELS + 1
    levels = (np.abs(x) // quantum).astype(np.int16).T
    lists = np.argsort(-levels, axis=1, kind="stable").astype(np.int32)
    counts = np.stack([(levels == level).sum(1) for level in range(LEVELS - 1, -1, -1)], 1) if dims else np.zeros((0, LEVELS))
    width = next(w for w in (2, 4, 8) if largest < 1 << (8 * w - 1) or w == 8)
    return {
        "n": n, "dims": dims, "width": width, "ids": ids.tobytes(), "places": places.tobytes(),
        "dense": x.astype(f"i{width}").tobytes(), "lists": lists.tobytes(),
        "ends": counts.cumsum(1).astype(np.int32).tobytes(),
    }


# While squared lengths stay below 2^17, a product, the square of a component and that of the query's
# share one number: their sums are exact in 52 bits and are added in one go.
_HALF, _FIELD, _HIGH = float(1 << 17), float(1 << 18), float(1 << 35)


def _pack(values: np.ndarray, squares: np.ndarray, own: float, out: np.ndarray) -> None:
    np.multiply(values, own, out=out)
    out += squares
    out += own * own * _HIGH


def _unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of products, of squares and of the query's squares."""
    rest = sums + _HALF
    high = np.floor(rest / _HIGH)
    rest -= high * _HIGH
    middle = np.floor(rest / _FIELD)
    return rest - middle * _FIELD - _HALF, middle, high


class Block:
    """A row of the index, ready for queries."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.places = np.frombuffer(row["places"], np.int64)
        self.dense = np.frombuffer(row["dense"], f"i{row['width']}").reshape(n, dims)
        lists = np.frombuffer(row["lists"], np.int32).reshape(dims, n)
        self.ends = np.frombuffer(row["ends"], np.int32).reshape(dims, LEVELS)
        self.starts = np.concatenate([np.zeros((dims, 1), np.int32), self.ends[:, :-1]], 1)
        self.counts = (self.ends - self.starts).astype(np.int64)
        #: Postings of a dimension: vectors, components and their squares.
        self.rows = lists.astype(np.intp)
        self.values = np.take_along_axis(self.dense.T, lists, 1).astype(np.float64)
        self.squares = self.values**2 * _FIELD
        self.lengths = (self.dense.astype(np.float64) ** 2).sum(1)
        self.space = np.empty(n * dims, np.intp), np.empty(n * dims)
        largest = int(np.abs(self.dense.astype(np.int64)).max(initial=0))
        tops = np.arange(LEVELS, 0, -1) * (largest // LEVELS + 1) - 1
        self.sizes = np.minimum(tops, largest).astype(np.float64)
        self.first_look = 1  # the share of the postings after which the last query was first near its end

    def members(self, query: np.ndarray, least: float, rounds: int = ROUNDS) -> np.ndarray:
        """Rows of the block that may score ``least`` or more with the query; misses none that does."""
        n, dims = self.dense.shape
        q = np.zeros(dims)
        q[: len(query)] = query[:dims]
        used = np.flatnonzero(q)
        if least == -np.inf or not len(used):
            return np.arange(n)
        impact = np.abs(q[used])[:, None] * self.sizes
        order = np.argsort(-impact, axis=None, kind="stable")
        taken = np.cumsum(self.counts[used].ravel()[order])
        ends = self.ends[used].ravel()
        total_q = (q**2).sum()
        slack = 1 + 1e-9 * np.sqrt(self.lengths * total_q)
        score, seen_x, seen_q = np.zeros(n), np.zeros(n), np.zeros(n)
        packed = max(total_q, self.lengths.max()) < _HALF
        done = np.zeros(len(used), np.int64)
        step = -(-n * len(used) // rounds)
        for r in range(min(self.first_look, rounds), rounds + 1):
            reached = order[: np.searchsorted(taken, min(r * step, taken[-1])) + 1]
            now = done.copy()
            np.maximum.at(now, reached // LEVELS, ends[reached])
            fresh = np.flatnonzero(now > done)
            if len(fresh):
                parts = [(used[i], slice(done[i], now[i])) for i in fresh]
                if packed:
                    sums = self._summed(parts, lambda t, at, out: _pack(self.values[t, at], self.squares[t, at], q[t], out))
                    more = _unpacked(sums)
                else:
                    more = [
                        self._summed(parts, lambda t, at, out: np.multiply(self.values[t, at], q[t], out=out)),
                        self._summed(parts, lambda t, at, out: np.divide(self.squares[t, at], _FIELD, out=out)),
                        self._summed(parts, lambda t, at, out: out.fill(q[t] ** 2)),
                    ]
                score, seen_x, seen_q = score + more[0], seen_x + more[1], seen_q + more[2]
            done = now
            unseen = np.sqrt(np.maximum(self.lengths - seen_x, 0) * np.maximum(total_q - seen_q, 0))
            possible = np.flatnonzero(score + unseen + slack >= least)
            if len(possible) * rounds <= SCORED * n or taken[-1] <= r * step:
                self.first_look = max(1, r - 1)
                break
        return possible

    def _summed(self, parts: list[tuple[int, slice]], weigh: Callable[[int, slice, np.ndarray], None]) -> np.ndarray:
        """Add up the weights of some postings by vector."""
        rows, weights = self.space
        m = 0
        for t, at in parts:
            k = at.stop - at.start
            rows[m : m + k] = self.rows[t, at]
            weigh(t, at, weights[m : m + k])
            m += k
        return np.bincount(rows[:m], weights[:m], len(self.ids))

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        both = min(len(query), self.dense.shape[1])
        return self.dense[rows, :both].astype(np.int64) @ query[:both]


class Best:
    """The k best answers of one query so far: highest score, then smallest id."""

    def __init__(self, k: int, least: float):
        self.k, self.least = k, least
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = max(self.least, float(self.scores[-1]))


def build(rows: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of ``prepared`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def emit(part: pa.Table) -> pa.RecordBatch:
            place, ids = (part[c].to_numpy().astype(np.int64) for c in ("place", "vec_id"))
            return pa.RecordBatch.from_pylist([indexed_block(ids, place, matrix(part["x"]))], schema=schema)

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= block_rows:
                whole = pa.Table.from_batches(held)
                for a in range(0, count - count % block_rows, block_rows):
                    yield emit(whole.slice(a, block_rows))
                rest = whole.slice(count - count % block_rows)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield emit(pa.Table.from_batches(held))

    schema = _arrow(_INDEX)
    rows.mapInArrow(run, _INDEX).write.parquet(path)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _floors(queries: DataFrame, seeds: pa.Table, k: int) -> DataFrame:
    """``queries`` with ``least``, the k-th best score among the seeds: no answer needs less."""
    seed_x = matrix(seeds["x"])
    seed_places = seeds["place"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, places = matrix(batch["x"]), batch["place"].to_numpy()
            both = min(x.shape[1], seed_x.shape[1])
            least = np.full(batch.num_rows, -np.inf)
            for a in range(0, batch.num_rows, 1024):
                mine = x[a : a + 1024, :both]
                scores = (mine @ seed_x[:, :both].T).astype(np.float64)
                scores[places[a : a + 1024, None] == seed_places] = -np.inf
                if scores.shape[1] >= k:
                    least[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return queries.mapInArrow(run, "place long, vec_id long, x array<long>, least double")


def _batch_answers(index: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """Up to k answers of each query of a batch from each task of the index scan."""
    sc = index.sparkSession.sparkContext
    shared = sc.broadcast(tuple(asked[c].to_numpy() for c in ("place", "vec_id", "least")) + (matrix(asked["x"]),))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, ids, least, x = shared.value
        best = [Best(k, f) for f in least]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for i, mine in enumerate(best):
                    rows = block.members(x[i], mine.least)
                    rows = rows[block.places[rows] != places[i]]
                    if len(rows):
                        mine.add(block.ids[rows], block.scores(x[i], rows))
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(places, sizes)),
                    pa.array(np.repeat(ids, sizes)),
                    pa.array(np.concatenate([b.ids for b in best])),
                    pa.array(np.concatenate([b.scores for b in best])),
                ],
                schema=_arrow(_ANSWER),
            )

    return index.mapInArrow(run, _ANSWER)


def top_k(
    rows: DataFrame, queries: DataFrame, k: int, index_path: str, seeds: int = SEEDS, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``rows`` is ``prepared``, ``queries`` some of its rows."""
    spark = rows.sparkSession
    index = spark.read.parquet(index_path)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).head()
    batches = -(-size["n"] * (8 * max(size["dims"] or 0, 1) + 64) // batch_bytes)
    first = rows.orderBy(F.xxhash64("place"), "place").limit(seeds).toArrow()
    found = spark.createDataFrame([], _ANSWER)
    for b in range(batches):
        part = queries.filter(F.pmod(F.xxhash64(F.lit(b"batch"), "place"), F.lit(batches)) == b)
        found = found.unionByName(_batch_answers(index, _floors(part, first, k).toArrow(), k))
    rank = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """Index all vectors and answer those whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = prepared(vectors, vec_id, vector, scale)
    path = scratch_path(spark, "impact-index")
    build(rows, path)
    return top_k(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0), k, path)
