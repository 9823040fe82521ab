"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from bugsieve.operators import kernels as kn
from bugsieve.operators.skew import join_one_row_per_key
from bugsieve.session import cut_lineage

MAX_ROUNDS = 60


def component_labels(edges: DataFrame, group: str = "level") -> DataFrame:
    """Smallest node of each node's component: ``(group, id, label)``.

    Input ``(group, a, b)``.  Alternates the two star operations of Kiveris et al.
    (Connected Components in MapReduce and Beyond, 2014): each round hooks every node's
    larger, then smaller neighbours to its smallest one.  The rounds needed grow with the
    logarithm of the graph; every round ends in a checkpoint.  Edges that travel together
    are linked up before the first round.
    """
    both = edges.select(
        group, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("u != v")
    now = cut_lineage(_contract(both).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        n = state[0]
        if n == 0:
            break
        hooked = cut_lineage(_large_star(now, group, 2 * n))
        now = cut_lineage(_small_star(hooked, group, 2 * n))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(group, F.col("u").alias("id"), F.col("v").alias("label"))
    centres = stars.select(group, F.col("label").alias("id"), "label").distinct()
    return stars.unionByName(centres)


def _contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each Arrow batch by stars: same components, shorter paths.

    A batch is bounded, so this holds no more than some thousand edges at a time.
    """
    names = edges.columns
    schema = to_arrow_schema(edges.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stars = kn.contracted(*(kn.keys(batch[c]) for c in names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c).cast(f.type) for c, f in zip(stars, schema)], schema=schema
            )

    return edges.mapInArrow(run, edges.schema)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free digest of them."""
    digest = F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))
    row = edges.agg(F.count("*").alias("n"), digest.alias("h")).head()
    return row["n"], int(row["h"] or 0)


def _hook(pairs: DataFrame, group: str, n: int) -> DataFrame:
    """Each pair ``(u, v)`` with the smallest node around ``u``, ``u`` included; ``n`` is
    at least the number of pairs."""
    least = pairs.groupBy(group, "u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size")
    )
    return join_one_row_per_key(pairs, least, [group, "u"], "size", n)


def _large_star(edges: DataFrame, group: str, n: int) -> DataFrame:
    flipped = edges.select(group, F.col("v").alias("u"), F.col("u").alias("v"))
    hooked = _hook(edges.unionByName(flipped), group, n)
    return hooked.filter("v > u").select(group, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, group: str, n: int) -> DataFrame:
    hooked = _hook(edges, group, n)  # every edge points from the larger node to the smaller
    to_least = hooked.select(group, F.col("v").alias("u"), F.col("m").alias("v"))
    own = hooked.select(group, "u", F.col("m").alias("v"))
    return to_least.unionByName(own).filter("u != v").distinct()
