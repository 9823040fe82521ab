"""Cells: an exact partitioning of similarity joins between two large vector tables.

A pair of vectors whose inner product may reach ``min_score`` always meets in a cell, so
a join only has to look inside cells.  Two rules make the cells:

* dense unit vectors - pivots.  A corpus row lives in the cell of its nearest pivot.  A
  query visits each cell whose boundary is close enough: for Euclidean radius ``r``, a
  row of cell *i* within ``r`` of the query can exist only if
  ``(d(q,p_i)^2 - d(q,p_home)^2) / (2 d(p_i,p_home)) <= r``.
* sparse unit vectors - prefix terms.  Terms are ordered rarest first; a row keeps the
  shortest prefix whose remainder has norm below ``min_score``.  Two rows that reach
  ``min_score`` share a prefix term.

Without ``min_score`` every pair may matter and the cells are a plain grid of blocks.
Cells that hold many rows are cut into blocks of at most about ``BLOCK_ROWS`` on either
side and all block pairs are formed, so no task receives an unbounded group; the result
stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bugsieve.operators import kernels as kn
from bugsieve.session import cut_lineage

BLOCK_ROWS = 1024
MAX_PIVOTS = 2048
_SLACK = 1e-7


def vector_is_sparse(df: DataFrame, vector: str = "vector") -> bool:
    return isinstance(df.schema[vector].dataType, T.StructType)


def pivots(corpus: DataFrame, n_rows: int, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """A bounded, repeatable sample of distinct vectors to partition the space by."""
    n = int(min(MAX_PIVOTS, max(1, 2 * n_rows // block_rows)))
    rows = (
        corpus.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(n).collect()
    )
    if not rows:
        return np.zeros((0, 1))
    return np.unique(np.array([r[0] for r in rows], dtype=np.float64), axis=0)


def _pivot_cells(df: DataFrame, p: np.ndarray, radius: float, visit: bool) -> DataFrame:
    """Home cell of every row, or all cells a row must visit."""
    shared = df.sparkSession.sparkContext.broadcast(p)
    schema = T.StructType([T.StructField("cell", T.LongType()), *df.schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        norms = (p * p).sum(1)
        between = np.sqrt(np.maximum(norms[:, None] + norms - 2 * (p @ p.T), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = kn.to_matrix(part["vector"])
                d2 = np.maximum((x * x).sum(1)[:, None] + norms - 2 * (x @ p.T), 0)
                home = d2.argmin(1)
                row, cell = np.arange(len(x)), home
                if visit:
                    gap = d2 - d2[row, home][:, None]
                    row, cell = np.nonzero(gap <= 2 * between[home] * (radius + _SLACK))
                placed = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int64)), *placed.columns], names=schema.names
                )

    return df.mapInArrow(assign, schema)


def _prefix_cells(df: DataFrame, min_score: float) -> DataFrame:
    """One row per prefix term.  Term numbers must be ordered most frequent first and be
    ascending within a row, so the rarest terms of a row are its last."""
    order = F.reverse(
        F.array_sort(F.arrays_zip(F.col("vector.indices").alias("i"), F.col("vector.values").alias("w")))
    )
    # Walk from the rarest term on, keeping terms until the rest has norm < min_score.
    total = F.aggregate("vector.values", F.lit(0.0), lambda a, w: a + w * w)
    start = F.struct(
        total.alias("rest"), F.array().cast("array<bigint>").alias("cells")
    )
    limit = (min_score - _SLACK) ** 2

    def step(acc, t):
        return F.when(acc["rest"] < limit, acc).otherwise(
            F.struct(
                (acc["rest"] - t["w"] * t["w"]).alias("rest"),
                F.concat(acc["cells"], F.array(t["i"].cast("bigint"))).alias("cells"),
            )
        )

    cells = F.aggregate(order, start, step)["cells"]
    # In the cell of the rarest term two rows share, rarer terms add nothing to their
    # product, so they stay behind.  Other cells give such a pair at most its score.
    kept = F.size("vector.indices") - F.col("_at")
    part = F.struct(
        F.slice("vector.indices", F.lit(1), kept).alias("indices"),
        F.slice("vector.values", F.lit(1), kept).alias("values"),
    )
    return df.select(F.posexplode(cells).alias("_at", "cell"), *df.columns).select(
        "cell", *[part.alias(c) if c == "vector" else F.col(c) for c in df.columns]
    )


def hash_cells(df: DataFrame, planes: np.ndarray, tables: int) -> DataFrame:
    """One row per hash table: the bucket named by the signs of products with the planes."""
    shared = df.sparkSession.sparkContext.broadcast(planes)
    schema = T.StructType([T.StructField("cell", T.LongType()), *df.schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = shared.value
        bits = len(planes) // tables
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = kn.to_matrix(batch["vector"]) @ planes.T > 0
            codes = signs.reshape(-1, tables, bits) @ powers
            codes += np.arange(tables, dtype=np.int64) << bits
            placed = batch.take(pa.array(np.repeat(np.arange(len(codes)), tables)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes.ravel()), *placed.columns], names=schema.names
            )

    return df.mapInArrow(assign, schema)


def cell_rows(
    queries: DataFrame,
    corpus: DataFrame | None,
    min_score: float | None,
    block_rows: int = BLOCK_ROWS,
    n_corpus: int | None = None,
) -> DataFrame:
    """Rows of both sides with their block: ``(cell, c_block, q_block, side, ...)``.

    Both inputs have ``id``, ``vector`` and the same further columns; no corpus means that
    the queries are matched with themselves.  ``side`` is 1 for a query, 2 for a corpus
    row and 3 for a row that is both.
    """
    other = queries if corpus is None else corpus
    if min_score is None:
        q, c = (df.withColumn("cell", F.lit(0).cast("bigint")) for df in (queries, other))
    elif vector_is_sparse(other):
        if min_score <= 0:
            raise ValueError("prefix cells need a positive min_score")
        q, c = _prefix_cells(queries, min_score), _prefix_cells(other, min_score)
    else:
        p = pivots(other, other.count() if n_corpus is None else n_corpus, block_rows)
        if not len(p):  # nothing to find; the cells still need a shape
            p = pivots(queries, 1, block_rows)
        radius = float(np.sqrt(max(2 - 2 * min_score, 0)))
        q = _pivot_cells(queries, p, radius, visit=True)
        c = _pivot_cells(other, p, radius, visit=False)
        corpus = other  # a row visits more cells than it lives in

    return block_rows_of(q, c if corpus is not None else None, block_rows)


def block_rows_of(q: DataFrame, c: DataFrame | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that already have a ``cell``, with their blocks; see :func:`cell_rows`."""
    corpus, columns = c, [name for name in q.columns if name != "cell"]
    c = q if c is None else c

    def blocks(n: str):
        return F.ceil(F.col(n) / block_rows).cast("int")

    # One row per cell.  Terms and hash buckets grow with the data, so this is an ordinary join;
    # a cell that holds very many rows is skewed on the rows' side, which adaptive execution splits.
    sizes = c.groupBy("cell").agg(F.count("*").alias("nc"))
    if corpus is None:
        sizes = sizes.filter("nc > 1").withColumn("nq", F.col("nc"))
    else:
        sizes = sizes.join(q.groupBy("cell").agg(F.count("*").alias("nq")), "cell")
    sizes = sizes.select("cell", blocks("nc").alias("c_blocks"), blocks("nq").alias("q_blocks"))

    def placed(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own + "s")).cast("int")
        opposite = F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))
        return df.join(sizes, "cell").select(
            "cell", block.alias(own), opposite.alias(other), F.lit(side).alias("side"),
            *columns,
        )

    q_rows = placed(q, "q_block", "c_block", 1)
    c_rows = placed(c, "c_block", "q_block", 2)
    if corpus is None:  # on the diagonal one copy of the row serves as both
        same = F.col("q_block") == F.col("c_block")
        q_rows = q_rows.withColumn("side", F.when(same, 3).otherwise(1))
        c_rows = c_rows.filter(~same)
    return q_rows.unionByName(c_rows)


Kernel = Callable[[pa.Table, pa.Table], dict]
_OUTPUT_ROWS, _OUTPUT_BLOCKS = 8192, 256
_BLOCK_KEY = ["cell", "c_block", "q_block"]


def map_blocks(rows: DataFrame, kernel: Kernel, schema: str | T.StructType) -> DataFrame:
    """Run ``kernel(query_rows, corpus_rows)`` on every block pair; it returns columns.

    Blocks are bounded, so a task holds one block pair at a time: rows arrive sorted by
    block and are cut where the block changes.
    """
    placed = rows.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(struct)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([kn.numbers(batch[c]).astype(np.int64) for c in _BLOCK_KEY], axis=1)
            cuts = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
            for start, end in zip([0, *cuts], [*cuts, len(key)]):
                here = tuple(key[start])
                if here != held_key:
                    if held:
                        yield pa.Table.from_batches(held)
                    held, held_key = [], here
                held.append(batch.slice(int(start), int(end - start)))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        for block in blocks(batches):
            side = kn.numbers(block["side"])
            if (side == 3).all():
                q = c = block
            else:
                q, c = (block.take(np.nonzero(side & bit)[0]) for bit in (1, 2))
            if not (q.num_rows and c.num_rows):
                continue
            out = kernel(q, c)
            ready.append(
                pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name]).cast(f.type) for f in arrow_schema], schema=arrow_schema
                )
            )
            # Small blocks are many: hand their rows over together.
            if sum(b.num_rows for b in ready) >= _OUTPUT_ROWS or len(ready) >= _OUTPUT_BLOCKS:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return placed.mapInArrow(run, struct)


#: Bytes of a block of queries and of a block of the corpus in :func:`map_pairs`.
PAIR_BYTES = {"dense": (4 << 20, 16 << 20), "sparse": (16 << 20, 32 << 20)}
LEAST_ROWS = 256


def payload_bytes(df: DataFrame, vector: str = "vector") -> Column:
    if vector_is_sparse(df, vector):
        return F.size(f"{vector}.indices") * 12 + 64
    return F.size(vector) * 8 + 64


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    found = df.agg(F.count("*").alias("n"), F.sum(payload_bytes(df)).alias("bytes")).head()
    return found["n"], found["bytes"] or 0


def n_blocks(df: DataFrame, size: tuple[int, int], most: int, block_rows: int | None = None) -> int:
    n, total = size
    if block_rows is not None:
        return max(1, -(-n // block_rows))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(-(-total // most), min(cores, -(-n // LEAST_ROWS)), 1)


def packed(
    df: DataFrame, name: str, most: int, block_rows: int | None = None, size: tuple[int, int] | None = None,
    in_place: bool = False, parts: int | None = None,
) -> DataFrame:
    """One row per block: its rows as an Arrow stream.  Stored, as every other block meets it.

    ``size`` is the number of rows and of their bytes, if known.  With ``in_place`` rows are packed where they lie
    and no vector is shuffled, if their partitions are enough; partitions of more than ``most`` bytes become
    several blocks.  It is for rows that are read from a stored table; the number of partitions of others, such as
    a join's, is given as ``parts``, as asking for it would run the join.
    """
    size = rows_and_bytes(df) if size is None else size
    n, blocks = size[0], n_blocks(df, size, most, block_rows)
    least = 1 if block_rows is not None else LEAST_ROWS
    # Where block_rows is not given, a block may be a third larger than the average before it is cut.
    limit = max(least, -(-n * 4 // (3 * blocks)))

    codec = "zstd" if vector_is_sparse(df) else None  # term numbers shrink, dense values do not

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as stream:
            for b in held:
                stream.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            at = 0
            while in_place and batch.num_rows - at >= limit - rows:
                yield block([*held, batch.slice(at, limit - rows)])
                held, at, rows = [], at + limit - rows, 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                rows += batch.num_rows - at
        if held:
            yield block(held)

    if parts is None:
        parts = df.rdd.getNumPartitions() if in_place else 0
    placed = df.repartition(blocks) if 2 * parts < blocks else df.coalesce(blocks)
    return cut_lineage(placed.mapInArrow(run, f"{name} binary"))


def _packed(df: DataFrame, name: str, most: int, block_rows: int | None) -> DataFrame:
    return packed(df, name, most, block_rows)


def map_pairs(
    queries: DataFrame, corpus: DataFrame, kernel: Kernel, schema: str | T.StructType, block_rows: int | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Run ``kernel(query_rows, corpus_rows)`` on every pair of a block of queries and one of the corpus.

    Each side is packed and stored once, in blocks of bounded size; a task reads one block of either side.
    No row is copied or shuffled per pair, so what is written grows with the rows, not with the pairs.
    Rows that meet themselves are packed once.  For ``in_place`` see :func:`packed`.
    """
    most = PAIR_BYTES["sparse" if vector_is_sparse(corpus) else "dense"]
    if queries is corpus:
        both = packed(corpus, "c", most[1], block_rows, in_place=in_place)
        return map_packed(both, both, kernel, schema)
    q = packed(queries, "q", most[0], block_rows, in_place=in_place)
    c = packed(corpus, "c", most[1], None if block_rows is None else 4 * block_rows, in_place=in_place)
    return map_packed(q, c, kernel, schema)


def map_packed(
    queries: DataFrame, corpus: DataFrame, kernel: Kernel, schema: str | T.StructType, blocks_a_task: int = 1
) -> DataFrame:
    """:func:`map_pairs` of sides that are packed.  Up to ``blocks_a_task`` blocks of the corpus share a task, while
    tasks stay many, so that a sum by query shuffles fewer rows."""
    q, c = (df.select(F.col(df.columns[0]).alias(to)) for df, to in ((queries, "q"), (corpus, "c")))
    if blocks_a_task > 1:
        tasks = 4 * q.sparkSession.sparkContext.defaultParallelism  # at least, where there are as many pairs
        parts, blocks = q.rdd.getNumPartitions(), c.rdd.getNumPartitions()
        c = c.coalesce(min(blocks, max(-(-tasks // max(parts, 1)), -(-blocks // blocks_a_task), 1)))
    # The hint keeps the blocks where they are stored: no side is collected or sent around whole.
    return _on_pairs(q.hint("shuffle_replicate_nl").crossJoin(c), lambda x, y, _: kernel(x, y), schema)


def map_pairs_once(
    rows: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], dict], schema: str | T.StructType, block_rows: int | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Run ``kernel(rows, other_rows, same)`` once on every pair of blocks of a table, in one order; ``same`` says that
    a block meets itself.  Blocks are packed and stored as in :func:`map_pairs`."""
    blocks = packed(rows, "c", PAIR_BYTES["sparse" if vector_is_sparse(rows) else "dense"][1], block_rows, in_place=in_place)
    numbered = blocks.withColumn("number", F.monotonically_increasing_id())  # of stored rows: the same whenever it is asked
    q, c = numbered.select(F.col("c").alias("q"), F.col("number").alias("i")), numbered.select("c", F.col("number").alias("j"))
    # Of every two blocks one order, so that those of each block are spread over its rows and columns.
    even = F.expr("(shiftrightunsigned(i, 33) + shiftrightunsigned(j, 33) + i + j) % 2 = 0")
    met = q.hint("shuffle_replicate_nl").join(c, F.when(F.col("i") < F.col("j"), even).otherwise((F.col("i") == F.col("j")) | ~even))
    return _on_pairs(met.select("q", "c", (F.col("i") == F.col("j")).alias("same")), kernel, schema)


def _on_pairs(pairs: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], dict], schema: str | T.StructType) -> DataFrame:
    """The kernel on pairs of blocks ``(q, c)``; a column ``same`` is handed to it."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_schema = to_arrow_schema(struct)
    marked = "same" in pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, same in zip(batch["q"], batch["c"], batch["same"].to_pylist() if marked else [False] * batch.num_rows):
                sides = [pa.ipc.open_stream(b.as_buffer()).read_all().combine_chunks() for b in (x, y)]
                out = kernel(*sides, same)
                made = pa.RecordBatch.from_arrays([pa.array(out[f.name]).cast(f.type) for f in arrow_schema], schema=arrow_schema)
                for at in range(0, made.num_rows, _OUTPUT_ROWS):
                    yield made.slice(at, _OUTPUT_ROWS)

    return pairs.mapInArrow(run, struct)
