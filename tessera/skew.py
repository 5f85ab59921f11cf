"""Joins of a large side with a table of unique keys when a few keys hold a large share of the rows.

A plain shuffle join sends every row of one key to one task. Here each hot key is spread over several tasks: the
large side takes a salt from its row, the unique side repeats the hot key once for each salt. The list of hot keys is
bounded by construction (at most ``max_hot``), so it may be broadcast whatever the size of the data; keys beyond the
list keep salt 0, which is slower but gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 20_000
_SALT, _SPREAD = "__salt", "__spread"


def hot_keys(dim: DataFrame, key: str, weight: Column, rows_per_task: int, max_hot: int = MAX_HOT_KEYS, max_spread: int = 512) -> DataFrame:
    """The at most ``max_hot`` heaviest keys having more than ``rows_per_task`` rows, with the number of salts of each."""
    spread = F.least(F.lit(max_spread), F.ceil(weight / F.lit(rows_per_task))).cast("int")
    return dim.where(weight > F.lit(rows_per_task)).select(F.col(key), spread.alias(_SPREAD), weight.alias("__w")).orderBy(F.desc("__w"), key).limit(max_hot).drop("__w")


def salted_lookup(facts: DataFrame, dim: DataFrame, key: str, hot: DataFrame, salt_source: Column, how: str = "inner") -> DataFrame:
    """``facts`` joined with ``dim`` (one row per key) on ``key``; null keys join nothing.

    ``hot`` comes from :func:`hot_keys`. ``salt_source`` is hashed to choose a salt and must be a function of the row
    alone, so that a task run again chooses the same. ``how`` is ``inner`` or ``left``. Columns of ``dim`` other than the
    key must not occur in ``facts``.
    """
    h = F.broadcast(hot)
    left = facts.join(h, key, "left").withColumn(_SALT, F.coalesce(F.pmod(F.xxhash64(salt_source), F.col(_SPREAD).cast("bigint")).cast("int"), F.lit(0))).drop(_SPREAD)
    right = dim.join(h, key, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SPREAD), F.lit(1)) - 1))).drop(_SPREAD)
    return left.join(right, [key, _SALT], how).drop(_SALT)
