"""One ranking from several scores of different scale: reciprocal rank fusion.

Positions come from one range-partitioned sort by (group, score), not from a window over each group: a group of any size
lies in several partitions, and one small summary of each partition tells where its first group goes on from the one
before. Each summary is a few numbers, so the driver holds as many rows as there are partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.lineage import cut

#: Added to every rank before it is inverted: the usual constant of the method.
RANK_CONSTANT = 60
NONE = -1


def _local_positions(keys: list[str]):
    """Number the rows of a sorted partition within their group, and find where each run of equal values began."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        before: list | None = None  # keys and value of the last row
        n = start = groups = runs = 0
        for pdf in batches:
            if not len(pdf):
                continue
            columns = [pdf[k].to_numpy() for k in keys] + [pdf["__value"].to_numpy()]
            other = [np.concatenate(([before is None or c[0] != before[j]], c[1:] != c[:-1])) for j, c in enumerate(columns)]
            new_group = np.logical_or.reduce(other[:-1])
            new_run = new_group | other[-1]
            index = np.arange(len(pdf))
            began = np.maximum.accumulate(np.where(new_group, index, -1))
            at = np.where(began < 0, n + index + 1, index - began + 1)
            began = np.maximum.accumulate(np.where(new_run, index, -1))
            begun = np.where(began < 0, start, at[began])
            nth_group, nth_run = groups + np.cumsum(new_group), runs + np.cumsum(new_run)
            pdf["__part"], pdf["__at"], pdf["__begun"], pdf["__fg"], pdf["__fr"] = part, at, begun, nth_group <= 1, nth_run <= 1
            before, n, start, groups, runs = [c[-1] for c in columns], int(at[-1]), int(begun[-1]), int(nth_group[-1]), int(nth_run[-1])
            yield pdf

    return number


def positions(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """``df`` with ``position`` (1, 2, ... within the keys by ``value`` descending, then ``tie``) and ``rank`` (the position of
    the first row with the same value).

    Keys, value and tie must not be null. Nothing is gathered by key: a key holding most of the rows is spread over as many
    partitions as its size needs.
    """
    order = [*[F.col(k).asc() for k in keys], F.col("__value").desc(), *[F.col(t).asc() for t in tie]]
    ranged = df.withColumn("__value", F.col(value).cast("double")).repartitionByRange(*order).sortWithinPartitions(*order)
    extra = [StructField(n, LongType()) for n in ("__part", "__at", "__begun")]
    from pyspark.sql.types import BooleanType

    extra += [StructField("__fg", BooleanType()), StructField("__fr", BooleanType())]
    schema = StructType([*ranged.schema.fields, *extra])
    local = cut(ranged.mapInPandas(_local_positions(keys), schema))
    ends = F.struct("__at", *keys, "__value", "__begun", "__fg", "__fr")
    summary = local.withColumn("__row", F.monotonically_increasing_id()).groupBy("__part").agg(F.min_by(F.struct(*keys, "__value"), "__row").alias("first"), F.max_by(ends, "__row").alias("last"))
    offsets: list[Row] = []
    before = None  # (keys, value, rows of that group so far, global start of its last run)
    for r in sorted(summary.collect(), key=lambda x: x["__part"]):
        first = tuple(r["first"][k] for k in keys)
        same_group = before is not None and before[0] == first
        add = before[2] if same_group else 0
        run_start = before[3] if same_group and before[1] == r["first"]["__value"] else 0
        offsets.append((int(r["__part"]), int(add), int(run_start)))
        last = tuple(r["last"][k] for k in keys)
        shift = add if r["last"]["__fg"] else 0
        begun = run_start if r["last"]["__fr"] and run_start else r["last"]["__begun"] + shift
        before = (last, r["last"]["__value"], r["last"]["__at"] + shift, begun)
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part bigint, __add bigint, __start bigint"))  # one row a partition
    shift = F.when(F.col("__fg"), F.col("__add")).otherwise(F.lit(0))
    rank = F.when(F.col("__fr") & (F.col("__start") > 0), F.col("__start")).otherwise(F.col("__begun") + shift)
    return local.join(table, "__part", "left").select(*df.columns, (F.col("__at") + shift).alias("position"), rank.alias("rank"))


def usable(score):
    """A score that can be ranked: null, NaN and infinite ones count as not given."""
    d = score.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def fuse(results: DataFrame, group: str, item: str, scores: list[str], latest: str | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """group, item, n_scores, fused, position: one ranking of the items of each group.

    Each score ranks the items of its group, higher first, equal scores sharing the better rank; an item's fused value is
    the sum of 1 / (constant + rank) over the scores it has. Positions go by fused value, then item. Of several rows of one
    item in a group the one with the greatest ``latest`` counts, then that with the greater scores; without ``latest`` the
    greatest scores. A score that is null, NaN or infinite gives nothing, and an item with none of them has fused 0 and
    comes last. Rows without group or item are left out. An empty table gives an empty one.
    """
    kept = results.select(F.col(group).alias("g"), F.col(item).alias("i"), *[usable(F.col(s)).alias(f"s{k}") for k, s in enumerate(scores)], (F.col(latest) if latest else F.lit(0)).alias("at"))
    kept = kept.where(F.col("g").isNotNull() & F.col("i").isNotNull())
    names = [f"s{k}" for k in range(len(scores))]
    nothing = F.lit(float("-inf"))
    chosen = F.max_by(F.struct(*names), F.struct(F.coalesce("at", F.lit(None)).alias("at"), *[F.coalesce(F.col(n), nothing).alias(n) for n in names]))
    once = kept.groupBy("g", "i").agg(chosen.alias("b")).select("g", "i", "b.*")
    # one row a score, and one under the number NONE for an item without any, so that nothing has to be joined back
    entries = [F.when(F.col(n).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(n).alias("v"))) for k, n in enumerate(names)]
    without = F.when(F.coalesce(*names).isNull(), F.struct(F.lit(NONE).alias("k"), F.lit(0.0).alias("v")))
    given = once.select("g", "i", F.explode(F.filter(F.array(*entries, without), lambda x: x.isNotNull())).alias("x")).select("g", "i", "x.k", "x.v")
    ranks = positions(given, ["g", "k"], "v", ["i"])
    shares = [F.coalesce(F.sum(F.when(F.col("k") == k, 1.0 / (constant + F.col("rank")))), F.lit(0.0)) for k in range(len(scores))]
    fused = shares[0]
    for share in shares[1:]:
        fused = fused + share
    value = ranks.groupBy("g", "i").agg(F.count_if(F.col("k") != NONE).alias("n_scores"), F.round(fused, 12).alias("fused"))
    return positions(value, ["g"], "fused", ["i"]).select(F.col("g").alias(group), F.col("i").alias(item), "n_scores", "fused", "position")
