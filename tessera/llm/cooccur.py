"""Items that appear together: pair counts by sorting packed pair codes, then odds ratios.

Each item gets a 32-bit number in name order; a pair is one 64-bit code. Tasks collect codes into runs of bounded size,
sort each run and count equal neighbours, so a pair leaves a run once however often it occurs. The runs are shuffled by
code, sorted by Spark's external sorter (which spills sorted runs and merges them), and equal neighbours are added up
in one streaming pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.operators.ingest import dense_ids
from tessera.skew import hot_keys, salted_lookup

RUN_CODES = 1 << 21
LONG_RECORD = 1024
ROWS_PER_TASK = 1_000_000
_RUN = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def normal_name(name: Column) -> Column:
    """Lower case, white space runs made one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def distinct_items(items: Column) -> Column:
    """Normalised names of an array without null, empty and repeated ones; a null array gives an empty one."""
    named = F.transform(F.coalesce(items, F.array().cast("array<string>")), normal_name)
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x != "")))

#: Two item numbers make one 64-bit code.
MAX_ITEMS = 2**32


def count_equal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    if not len(codes):
        return codes, codes
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def _pair_codes(ids: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs within each record; ``ids`` holds the records one after another, ascending in each."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for k in np.unique(lengths):
        if k < 2:
            continue
        where = starts[lengths == k]
        if k > LONG_RECORD:  # one item against all later ones at a time: memory stays linear in the record
            for s in where:
                record = ids[s : s + k]
                for i in range(k - 1):
                    yield (record[i] << 32) | record[i + 1 :]
            continue
        a, b = np.triu_indices(k, 1)
        step = max(1, RUN_CODES // len(a))
        for at in range(0, len(where), step):
            block = ids[where[at : at + step, None] + np.arange(k)]
            yield ((block[:, a] << 32) | block[:, b]).ravel()


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From arrays of ascending item numbers to counted codes, sorted within each run."""
    held: list[np.ndarray] = []
    size = 0

    def run() -> pa.RecordBatch:
        codes, n = count_equal(np.sort(np.concatenate(held)))
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], schema=_RUN)

    for batch in batches:
        lists = batch.column(0)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for codes in _pair_codes(ids, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)):
            held.append(codes)
            size += len(codes)
            if size >= RUN_CODES:
                yield run()
                held, size = [], 0
    if size:
        yield run()


def _merged(min_count: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add up equal neighbours of sorted codes; the last code of a batch waits for the next one."""
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            keys, sums = codes[first], np.add.reduceat(n, first)
            if last is not None:
                if keys[0] == last:
                    sums[0] += total
                else:
                    keys, sums = np.concatenate(([last], keys)), np.concatenate(([total], sums))
            last, total = keys[-1], sums[-1]
            keep = sums[:-1] >= min_count
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][keep]), pa.array(sums[:-1][keep])], schema=_RUN)
        if last is not None and total >= min_count:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total])], schema=_RUN)

    return merge


def cooccurrence(records: DataFrame, record_id: str, kinds: dict[str, str], min_count: int = 1) -> DataFrame:
    """kind, item_a, item_b, n_ab, n_a, n_b, n_rows, lift, odds_ratio for pairs in at least ``min_count`` records.

    ``kinds`` maps a kind to the path of its ``array<string>`` column; ``record_id`` is unique. item_a < item_b in
    code-point order. ``min_count`` also drops rarer items before pairing, which loses no pair that reaches it. n_rows
    counts all records, those with null or empty arrays too. The odds ratio adds 1/2 to each cell of the two-by-two table.
    No records, or none with two items, give no rows; other columns are not read.
    """
    arrays = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), distinct_items(F.col(c)).alias("items")) for k, c in kinds.items()])).alias("k")
    by_kind = records.select(F.col(record_id).alias("record"), arrays).where(F.size("k.items") > 1)
    key = F.struct("kind", "item").alias("key")
    long = by_kind.select("record", F.col("k.kind").alias("kind"), F.explode("k.items").alias("item")).select("record", key)
    singles = records.select(arrays).select(F.col("k.kind").alias("kind"), F.explode("k.items").alias("item")).select(key)
    frequent = singles.groupBy("key").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= min_count)
    names = cut(dense_ids(frequent.select(F.col("key.kind").alias("kind"), F.col("key.item").alias("item"), "key", "n_item"), ["kind", "item"], "item_no").select("key", "n_item", "item_no"))
    if names.count() > MAX_ITEMS:
        raise ValueError("more items than 32 bits can number")
    hot = hot_keys(names, "key", F.col("n_item"), ROWS_PER_TASK)
    numbered = salted_lookup(long, names.select("key", "item_no"), "key", hot, F.col("record"))
    sets = numbered.groupBy("record", F.col("key.kind").alias("kind")).agg(F.sort_array(F.collect_list("item_no")).alias("ids"))  # a record's own items
    runs = sets.where(F.size("ids") > 1).select("ids").mapInArrow(sorted_runs, "code bigint, n bigint")
    pairs = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merged(min_count), "code bigint, n bigint")
    coded = pairs.select(F.shiftrightunsigned("code", 32).alias("no_a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("no_b"), F.col("n").alias("n_ab"))
    heavy = hot.join(names, "key").select("item_no", "__spread")
    side = lambda s: names.select(F.col("item_no").alias(f"no_{s}"), F.col("key").alias(f"key_{s}"), F.col("n_item").alias(f"n_{s}"))
    spread = lambda s: heavy.select(F.col("item_no").alias(f"no_{s}"), "__spread")
    with_a = salted_lookup(coded, side("a"), "no_a", spread("a"), F.col("no_b"))
    both = salted_lookup(with_a, side("b"), "no_b", spread("b"), F.col("no_a"))
    total = F.lit(records.count())
    a, b, ab, n = (c.cast("double") for c in (F.col("n_a"), F.col("n_b"), F.col("n_ab"), total))
    odds = ((ab + 0.5) * (n - a - b + ab + 0.5)) / ((a - ab + 0.5) * (b - ab + 0.5))
    return both.select(
        F.col("key_a.kind").alias("kind"), F.col("key_a.item").alias("item_a"), F.col("key_b.item").alias("item_b"), "n_ab", "n_a", "n_b", total.cast("bigint").alias("n_rows"), (ab * n / (a * b)).alias("lift"), odds.alias("odds_ratio")
    )


def exceeds(n_ab: Column, n_a: Column, n_b: Column, n: Column, factor: Column) -> Column:
    """n_ab * n >= factor * n_a * n_b in exact whole numbers."""
    d = lambda c: c.cast("decimal(19,0)")
    return d(n_ab) * d(n) >= F.lit(1).cast("decimal(1,0)") * (d(n_a) * d(n_b)) * factor.cast("decimal(4,0)")
