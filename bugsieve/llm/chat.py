"""Chat formatting: logged conversations that are prefixes of longer ones are dropped, then rendered.

Logs hold cumulative snapshots: the same conversation after two, four, six turns.  Every turn gets
the hash of the conversation up to it, two 64-bit sums without carry of hashes of position, role and
text, so it rolls from turn to turn.  A conversation is kept if its last hash is no hash of a
longer one's prefix, found by an anti-join of distinct hashes; of equal conversations the
one with the smallest id is kept.  The kept ones are rendered, a template per turn.

Everything up to the anti-join works on hashes; texts are moved once, those of the conversations
that are kept.  Turns are numbered and hashed in two levels: within runs of turns of bounded
range, then over the runs, so a conversation that holds a third of all turns is many small groups.
Only its rendered text comes together, in one row, as it must.

Cases: rows equal in conversation, turn, role and text count once.  Several rows of one turn are
compared in order of role, then hash of the text, and rendered in order of role, then text,
nulls first.  A null role is rendered as ``unknown``, a null text as empty; for comparing, null
differs from empty.  A null turn comes before all others.  Null conversation ids make one
conversation.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugsieve.session import cut_lineage

RUN = 256  # a run is the turns with the same quotient by this number


def _hashes(*columns: str) -> list[Column]:
    """Two hashes of the columns; null and its position count."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _key(conv_id: str) -> Column:
    """The conversation as text that is never null, so that joins and groups share a partitioning."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{conv_id}`").cast("string")), F.lit(""))


def prefixes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, key, turn, role, pos, h1, h2)``: each turn's place from 1 and the hash up to it."""
    named = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        _key(conv_id).alias("key"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.col(f"`{role}`").alias("role"),
        F.col(f"`{text}`").alias("text"),
    )
    c1, c2 = _hashes("text")
    rows = cut_lineage(
        named.select("conv_id", "key", "turn", "role", c1.alias("c1"), c2.alias("c2"))
        .distinct()
        .withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))))
    )
    keys = ["key", "run"]
    inside = W.partitionBy(*keys).orderBy("turn", "role", "c1", "c2").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("key").orderBy("run").rowsBetween(W.unboundedPreceding, -1)

    def with_offsets(df: DataFrame, totals: list[Column], offsets: dict[str, Column]) -> DataFrame:
        """What the runs before a row's run add up to, as columns."""
        ahead = df.groupBy(*keys).agg(*totals).select(*keys, *[c.alias(n) for n, c in offsets.items()])
        return df.join(ahead, keys)

    zero = F.lit(0).cast("long")
    numbered = with_offsets(
        rows.withColumn("own", F.row_number().over(inside)),
        [F.count("*").alias("n")],
        {"skipped": F.coalesce(F.sum("n").over(before), zero)},
    ).withColumn("pos", (F.col("own") + F.col("skipped")).cast("long"))
    h1, h2 = _hashes("pos", "role", "c1", "c2")
    hashed = numbered.withColumns({"t1": h1, "t2": h2}).withColumns(
        {"r1": F.bit_xor("t1").over(inside), "r2": F.bit_xor("t2").over(inside)}
    )
    rolled = with_offsets(
        hashed,
        [F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")],
        {f"o{k}": F.coalesce(F.bit_xor(f"x{k}").over(before), zero) for k in (1, 2)},
    )
    return rolled.select(
        "conv_id", "key", "turn", "role", "pos",
        F.col("r1").bitwiseXOR(F.col("o1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("o2")).alias("h2"),
    )


def maximal(marked: DataFrame) -> DataFrame:
    """``(conv_id, key, n_turns, n_copies)`` of the conversations no longer one begins with, from
    ``prefixes``.  ``n_copies`` counts the conversations equal to it, itself included.
    """
    ends = marked.groupBy("key").agg(
        F.max(F.struct("pos", "h1", "h2")).alias("e"), F.first("conv_id").alias("conv_id")
    ).select("key", "conv_id", "e.*")
    # Distinct before the join: a first turn that a third of all conversations share is one row.
    first = F.struct(F.col("conv_id").isNull(), "conv_id", "key")
    distinct = ends.groupBy("pos", "h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("n_copies"))
    inner = (
        marked.select("key", "pos", "h1", "h2")
        .join(ends.select("key", F.col("pos").alias("_n")), "key")
        .filter("pos < _n")
        .select("pos", "h1", "h2")
        .distinct()
    )
    return distinct.join(inner, ["pos", "h1", "h2"], "left_anti").select(
        "first.conv_id", "first.key", F.col("pos").alias("n_turns"), "n_copies"
    )


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the template."""
    return F.concat(
        F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n")
    )


def snapshots_collapsed(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, n_turns, n_copies, rendered)`` of the maximal conversations."""
    kept = cut_lineage(maximal(cut_lineage(prefixes(turns, conv_id, turn, role, text))))
    said = F.struct(
        F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")
    )
    spoken = turns.select(_key(conv_id).alias("key"), said.alias("said")).join(
        kept.select("key"), "key", "left_semi"
    ).groupBy("key").agg(F.array_sort(F.array_distinct(F.collect_list("said"))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda x: rendered_turn(x["role"], x["text"])), "")
    return spoken.join(kept, "key").select("conv_id", "n_turns", "n_copies", body.alias("rendered"))
