"""Joining a large table to one row per key when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot when it holds more than 1/1000 of the rows ...
ALWAYS_COLD = 100_000  # ... and more rows than this


def join_one_row_per_key(
    left: DataFrame, right: DataFrame, key: list[str], size: str, n_left: int
) -> DataFrame:
    """Inner join of ``left`` to ``right``, which has one row per key and in ``size`` the
    number of left rows with that key.

    At most ``HOT_SHARE`` keys can be hot, so their rows are broadcast and the hot rows
    of ``left`` are not shuffled at all; all other keys take the ordinary join.
    ``left`` is read twice and should be a stored or checkpointed table.
    """
    if n_left <= ALWAYS_COLD:
        return left.join(right.drop(size), key)
    limit = max(n_left // HOT_SHARE, ALWAYS_COLD)
    hot = right.filter(F.col(size) > limit).drop(size)
    cold = right.filter(F.col(size) <= limit).drop(size)
    hot_keys = hot.select(*key)
    return left.join(F.broadcast(hot), key).unionByName(
        left.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key)
    )
