"""Conversation prefix trie in balanced parentheses, one sequence per shard.

Every distinct prefix of a conversation is a node.  A prefix is named by its length and a hash that
rolls from turn to turn, so nodes, members and children are plain groups of rows.  Totals over
subtrees come from the shape: nodes are put in preorder, cut into shards by a range exchange, and
each shard writes its part of the tree as balanced parentheses.  ``findclose`` over a range
min-max tree of the excess delimits each subtree, rank over leaf pairs ``()`` counts its leaves, and
cumulative sums give its savings.

A subtree may run on into later shards; those nodes are the spine that shards share.  Such a
subtree ends where its last conversation, in order, adds its last node; sums up to that node, less the sums
before the subtree, merge the shards' parts.  That is one join, however many shards lie between.

Preorder without long keys: a conversation is ordered by the hashes of the nodes where it leaves a
branching node, ranked by a range sort, and a node stands at (rank of its first conversation, depth).
These keys have one entry per branching node on the way, not one per turn.

Plan: texts do not move, 128-bit hashes and word counts do.  Turns are numbered by a range sort and
hashed in two levels, within runs of turns and over the runs, so a conversation that holds a third
of all rows is many groups.  A prefix most conversations share is one row after the partial
aggregation, and children find a parent of very many through a broadcast row.  The ends of a node are read in
order, one after another, by the task that makes their digest; it holds a batch.

Cases: a null role or text is empty; a null turn comes first.  Rows of one turn stand in order of role,
then SHA-256 of the text; repeated rows are turns of their own.  Rows without a conversation id take
no part.  Conversations without turns are members of the root.  An empty table has no nodes, no root
either.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.llm.common import blank_words
from bugsieve.operators.numbering import number_rows
from bugsieve.operators.skew import join_one_row_per_key
from bugsieve.session import cut_lineage, ship_package

RUN = 256
FAMILY = 20  # conversations of one family share the head of its first member
SHARD_NODES = 1 << 18
_POSITION_BITS = 33
_NODE = ["depth", "h1", "h2"]


# --- turns ------------------------------------------------------------------------------------


def placed_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, pos, c1, c2, tokens)``: place from 1, two hashes of role and text, words of the text."""
    said, words = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    bare = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        words.alias("role"),
        F.unhex(F.sha2(said, 256)).alias("h"),
        F.size(blank_words(said)).cast("long").alias("tokens"),
        F.monotonically_increasing_id().alias("_tie"),  # so that a range sort can part equal rows
    ).filter("conv_id IS NOT NULL")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h", "_tie"]
    placed = cut_lineage(
        bare.orderBy(*order).select(
            "conv_id",
            *[F.xxhash64(F.lit(seed), "role", "h").alias(f"c{seed}") for seed in (1, 2)],
            "tokens",
            F.monotonically_increasing_id().alias("at"),
        )
    ).withColumn("_part", F.shiftright("at", _POSITION_BITS))
    pieces = placed.groupBy("conv_id", "_part").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    ahead = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(
        "conv_id", "_part", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1 - F.col("_first")).alias("_start")
    )
    return cut_lineage(
        placed.join(starts, ["conv_id", "_part"]).select("conv_id", (F.col("at") + F.col("_start")).alias("pos"), "c1", "c2", "tokens")
    )


def rebuilt(placed: DataFrame, family: int = FAMILY) -> DataFrame:
    """Conversations that begin with the first h turns of the first of their family, from ``placed_turns``.

    Conversation c belongs to ``c - c % family``; h is the CRC-32 of its id, of four.  Its own turns follow
    after their first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = sizes.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), "n")
    members = cut_lineage(
        sizes.select("conv_id", base.alias("base"), h.alias("h"))
        .join(heads, "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    )
    # Most conversations take all h turns and their own places stay.
    moved = members.filter("taken < h").select("conv_id", (F.col("taken") - F.col("h")).alias("by"))
    own = placed.filter(F.col("pos") > h).join(moved, "conv_id", "left").withColumn(
        "pos", F.col("pos") + F.coalesce("by", F.lit(0))
    )
    opening = placed.filter((F.col("pos") < 4) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    given = members.join(opening, "base").filter(F.col("pos") <= F.col("h"))
    columns = ["conv_id", "pos", "c1", "c2", "tokens"]
    return given.select(*columns).unionByName(own.select(*columns))


def prefixes(placed: DataFrame) -> DataFrame:
    """``(conv_id, depth, h1, h2, t1, t2, tokens)``: the hash up to each turn, and what the turn added."""
    added = placed.select(
        "conv_id", F.col("pos").alias("depth"), F.floor(F.col("pos") / RUN).alias("_run"), "tokens",
        *[F.xxhash64(F.lit(seed), "pos", "c1", "c2").alias(f"t{seed}") for seed in (1, 2)],
    )
    keys = ["conv_id", "_run"]
    inside = W.partitionBy(*keys).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    rolled = added.withColumns({f"r{k}": F.bit_xor(f"t{k}").over(inside) for k in (1, 2)})
    ahead = added.groupBy(*keys).agg(*[F.bit_xor(f"t{k}").alias(f"x{k}") for k in (1, 2)]).select(
        *keys, *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"o{k}") for k in (1, 2)]
    )
    return rolled.join(ahead, keys).select(
        "conv_id", "depth", *[F.col(f"r{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"h{k}") for k in (1, 2)], "t1", "t2", "tokens"
    )


# --- balanced parentheses ---------------------------------------------------------------------


class Parentheses:
    """A sequence of parentheses with a range min tree over blocks of its excess.

    The sequence may be a piece of a longer one: some parentheses have no partner in it.
    """

    BLOCK = 128

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(2 * opens.astype(np.int64) - 1)
        self.rank = np.cumsum(opens)
        blocks = 1
        while blocks * self.BLOCK < len(opens):
            blocks *= 2
        far = np.iinfo(np.int64).max
        self.padded = np.full(blocks * self.BLOCK, far)
        self.padded[: len(opens)] = self.excess
        self.levels = [self.padded.reshape(-1, self.BLOCK).min(1)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(1))

    def _within(self, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place from ``starts`` to the end of its block whose excess is at most ``wanted``, or -1."""
        out = np.full(len(starts), -1)
        for a in range(0, len(starts), 1 << 14):
            s, w = starts[a : a + (1 << 14)], wanted[a : a + (1 << 14)]
            block = s // self.BLOCK * self.BLOCK
            places = block[:, None] + np.arange(self.BLOCK)
            hit = (self.padded[places] <= w[:, None]) & (places >= s[:, None])
            found = hit.any(1)
            out[a : a + (1 << 14)][found] = places[found, hit[found].argmax(1)]
        return out

    def findclose(self, places: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at ``places`` close; -1 if that lies beyond this piece."""
        wanted = self.excess[places] - 1
        out = np.full(len(places), -1)
        start = places + 1
        inner = np.flatnonzero((start < len(self.opens)) & (start % self.BLOCK != 0))
        out[inner] = self._within(start[inner], wanted[inner])
        rest = np.flatnonzero(out < 0)
        # Up from the block, rightwards, to the first whose least excess is low enough; then down to its first.
        block = -(-start[rest] // self.BLOCK)  # the first block not searched yet
        w = wanted[rest]
        level = np.zeros(len(rest), np.int64)
        found = np.zeros(len(rest), bool)
        now = np.arange(len(rest))
        for k, mins in enumerate(self.levels):
            now = now[block[now] < len(mins)]
            # A left child is covered by its parent, looked at one level up.
            looked = now[(block[now] % 2 == 1) | (len(mins) == 1)]
            hit = looked[mins[block[looked]] <= w[looked]]
            found[hit], level[hit] = True, k
            now = now[~found[now]]
            block[now] = (block[now] + 1) // 2
        for k in range(len(self.levels) - 1, 0, -1):
            at = np.flatnonzero(found & (level == k))
            left = block[at] * 2
            block[at] = np.where(self.levels[k - 1][left] <= w[at], left, left + 1)
            level[at] = k - 1
        done = np.flatnonzero(found)
        out[rest[done]] = self._within(block[done] * self.BLOCK, w[done])
        return out


def shard_sums(depth: np.ndarray, childless: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a shard's nodes in preorder: ``(closed, leaves, saved, leaves_upto, saved_upto)``.

    ``leaves`` and ``saved`` are those of the subtree if it closes in the shard; ``..._upto`` are sums from
    the start of the shard, the node included.
    """
    n = len(depth)
    closing = np.zeros(n, np.int64)  # parentheses that close before each node
    closing[1:] = depth[:-1] - depth[1:] + 1
    places = np.arange(n) + np.cumsum(closing)
    opens = np.zeros(n + int(closing.sum()) + int(childless[-1]), bool)
    opens[places] = True
    seq = Parentheses(opens)
    leaf = np.zeros(len(opens), np.int64)
    leaf[:-1] = opens[:-1] & ~opens[1:]
    pairs = np.cumsum(leaf)
    summed = np.concatenate([[0], np.cumsum(gain)])
    close = seq.findclose(places)
    end = np.maximum(close, 0)
    leaves = pairs[end] - pairs[places] + leaf[places]
    saved = summed[seq.rank[end]] - summed[:-1]
    return close >= 0, leaves, saved, pairs[places], summed[1:]


# --- the trie ---------------------------------------------------------------------------------

_SHARD = (
    "depth long, h1 long, h2 long, p1 long, p2 long, conv_id long, n_convs long, n_children long, last_rank long, end_rank long, "
    "shard int, closed boolean, leaves long, saved long, leaf long, gain long, leaves_upto long, saved_upto long"
)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A whole shard, at most some hundred thousand nodes, through its parentheses."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    depth, gain = rows["depth"].to_numpy(), rows["gain"].to_numpy()
    childless = rows["n_children"].to_numpy() == 0
    closed, leaves, saved, leaves_upto, saved_upto = shard_sums(depth, childless, gain)
    made = {
        "closed": pa.array(closed), "leaves": pa.array(leaves), "saved": pa.array(saved), "leaf": pa.array(childless.astype(np.int64)),
        "leaves_upto": pa.array(leaves_upto), "saved_upto": pa.array(saved_upto),
    }
    names = [c.split()[0] for c in _SHARD.split(", ")]
    table = pa.table({c: made[c] if c in made else rows[c] for c in names})
    yield from table.to_batches(max_chunksize=1 << 16)


def _parent_node() -> list[Column]:
    """A node's parent, as a node."""
    return [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]


class Trie(NamedTuple):
    """The nodes and, per node, the conversations that end there."""

    nodes: DataFrame  # depth, h1, h2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    ends: DataFrame  # depth, h1, h2, conv_id


def trie(placed: DataFrame, conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> Trie:
    """The trie of ``(conv_id, pos, c1, c2, tokens)``; ``conversations`` lists all ids, also those without turns."""
    ship_package(placed.sparkSession)
    said = cut_lineage(prefixes(placed))
    convs = cut_lineage(conversations.select("conv_id").distinct())
    last = said.groupBy("conv_id").agg(F.max(F.struct("depth", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    zero = F.lit(0).cast("long")
    ends = cut_lineage(
        convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _NODE])
    )
    shared = cut_lineage(
        said.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.first("tokens").alias("tokens"),
            F.first(F.col("h1").bitwiseXOR(F.col("t1"))).alias("p1"),
            F.first(F.col("h2").bitwiseXOR(F.col("t2"))).alias("p2"),
        )
    )
    children = cut_lineage(shared.groupBy(*_parent_node()).agg(F.count("*").alias("n_children")))
    ranked = _ranked(said, ends, shared, children)
    on_way = said.select("conv_id", *_NODE).join(ranked.select("conv_id", "rank", F.col("depth").alias("_n")), "conv_id")
    ranks = on_way.groupBy(*_NODE).agg(
        F.min("rank").alias("first_rank"),
        F.max("rank").alias("last_rank"),
        F.max(F.when(F.col("depth") == F.col("_n"), F.col("rank"))).alias("end_rank"),
    )
    at_root = F.when(F.col("depth") == 0, F.col("rank"))
    nothing = F.lit(None).cast("long")
    root = (
        convs.select("conv_id", nothing.alias("rank"), nothing.alias("end_rank"))
        .unionByName(ranked.select(nothing.alias("conv_id"), "rank", at_root.alias("end_rank")))
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("conv_id").alias("n_convs"),
            F.min("rank").alias("first_rank"),
            F.max("rank").alias("last_rank"),
            F.max("end_rank").alias("end_rank"),
        )
        .filter("n_convs > 0")
        .select("*", *[zero.alias(c) for c in (*_NODE, "tokens", "p1", "p2")])
    )
    nodes = cut_lineage(
        shared.join(ranks, _NODE).unionByName(root).join(children, _NODE, "left").select(
            *_NODE, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("tokens")).alias("gain"), "first_rank", "last_rank", "end_rank",
        )
    )
    n_nodes = nodes.count()
    cut = nodes.repartitionByRange(-(-n_nodes // shard_nodes) or 1, "first_rank", "depth")
    inside = cut.sortWithinPartitions("first_rank", "depth").withColumn("shard", F.spark_partition_id())
    summed = cut_lineage(inside.mapInArrow(_sharded, _SHARD))
    whole = cut_lineage(_merged(summed))
    parents = whole.filter("n_children > 0").select(*_NODE, F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_size"))
    below = whole.filter("depth > 0").withColumn("_d", F.col("depth") - 1)
    named = join_one_row_per_key(
        below, parents.toDF("_d", "p1", "p2", "parent_conv_id", "_size"), ["_d", "p1", "p2"], "_size", n_nodes
    )
    top = whole.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return Trie(named.select(*columns).unionByName(top.select(*columns)), ends)


def _ranked(said: DataFrame, ends: DataFrame, shared: DataFrame, children: DataFrame) -> DataFrame:
    """``(conv_id, depth, rank)``: one conversation of each distinct sequence, in an order in which the
    members of every node are neighbours and no conversation comes before one it begins with."""
    single = cut_lineage(ends.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id")))
    forks = children.filter("n_children > 1").select(F.col("depth").alias("_d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"))
    turns_off = (
        shared.withColumn("_d", F.col("depth") - 1).join(forks, ["_d", "p1", "p2"], "left_semi").select(*_NODE)
    )
    way = (
        said.select("conv_id", *_NODE)
        .join(single.select("conv_id"), "conv_id", "left_semi")
        .join(turns_off, _NODE, "left_semi")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct(*_NODE))).alias("way"))
    )
    keyed = single.select("conv_id", "depth").join(way, "conv_id", "left")
    none = F.array().cast("array<struct<depth:bigint,h1:bigint,h2:bigint>>")
    return cut_lineage(number_rows(keyed.withColumn("way", F.coalesce("way", none)), "way", "depth", "conv_id", name="rank").drop("way"))


def _merged(summed: DataFrame) -> DataFrame:
    """Totals of all subtrees: those that close in their shard, and those of the spines."""
    totals = summed.groupBy("shard").agg(F.sum("leaf").alias("_l"), F.sum("gain").alias("_g"))
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "shard", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for c, n in (("_l", "_leaves_before"), ("_g", "_saved_before"))]
    )
    # One row per shard; from the start of the whole sequence instead of the shard.
    upto = summed.join(F.broadcast(offsets), "shard").withColumns(
        {"leaves_upto": F.col("leaves_upto") + F.col("_leaves_before"), "saved_upto": F.col("saved_upto") + F.col("_saved_before")}
    )
    ends = upto.filter("end_rank IS NOT NULL").select(
        F.col("end_rank").alias("last_rank"), F.col("leaves_upto").alias("_leaves_end"), F.col("saved_upto").alias("_saved_end")
    )
    columns = [*_NODE, "p1", "p2", "conv_id", "n_convs", "n_children"]
    closed = summed.filter("closed").select(*columns, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    spine = upto.filter("NOT closed").join(ends, "last_rank").select(
        *columns,
        (F.col("_leaves_end") - F.col("leaves_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("_saved_end") - F.col("saved_upto") + F.col("gain")).alias("saved_tokens"),
    )
    return closed.unionByName(spine)


_DIGEST = "depth long, h1 long, h2 long, ends_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        done = []
        for *here, conv_id in zip(*(batch[c].to_pylist() for c in (*_NODE, "conv_id"))):
            if here == node:
                digest.update(b",%d" % conv_id)
                continue
            if digest:
                done.append((*node, digest.hexdigest()))
            node, digest = here, hashlib.sha256(b"%d" % conv_id)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(list(zip(*done)) or [()] * 4, schema)], schema=schema
        )
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, digest.hexdigest()), schema)], schema=schema)


def with_ends(found: Trie) -> DataFrame:
    """The nodes with ``ends_sha256``, the digest of the ids that end there, ascending."""
    ordered = found.ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    digests = ordered.mapInArrow(_digested, _DIGEST)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.nodes.join(digests, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("h1", "h2")


def prefix_trie(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = False, **more
) -> Trie:
    """The trie of the conversations as they are, or as ``rebuilt``."""
    placed = placed_turns(turns, conv_id, turn, role, text)
    return trie(rebuilt(placed) if rebuild else placed, placed, **more)
