"""Filling fixed-capacity containers with texts: bounded-space online best fit.

Each task keeps a fixed number of open containers. An item goes to the open container it fills best; where none has
room and no further one may be opened, the fullest is closed. What stays open at the end of a task is merged in groups of
bounded size, level by level, until one group is left.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut

OPEN_WINDOWS = 64
GROUP = 64
MAX_SPECS = 1000
OUT_ROWS = 50_000
#: In place of a piece: the row tells of a container left open.
OPEN = -1
#: How the vocabulary's tokenizer divides text before merging bytes: fixed value, as published with it.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SCHEMA = pa.schema([("spec_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("container", pa.int64())])
_DDL = "spec_id bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, container bigint"
_encodings: dict[str, object] = {}


def encoding(path: str):
    """A byte-pair tokenizer of a published vocabulary; read once in each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Windows:
    """The open containers of one capacity. ``place`` returns the number of the container an item goes to."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []  # (room left, container), ascending
        self.made = 0

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                self.open.pop(0)  # the fullest is closed
            room, number = self.capacity, self.made
            self.made += 1
        if room > size:
            insort(self.open, (room - size, number))
        return number

    def alone(self) -> int:
        """A container for a piece that fills it."""
        self.made += 1
        return self.made - 1


def _packer(specs: list[tuple[int, int]], vocabulary: str, limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        base = TaskContext.get().partitionId() << 32
        windows = {spec: Windows(capacity, limit) for spec, capacity in specs}
        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(encode(text)) if text else 0
                for spec, capacity in specs:
                    if not size:
                        rows.append((spec, key, 0, 0, 0, None))
                        continue
                    whole, rest = divmod(size, capacity)
                    if not rest:
                        whole, rest = whole - 1, capacity
                    w = windows[spec]
                    for piece in range(whole):
                        rows.append((spec, key, piece, piece * capacity, capacity, base + w.alone()))
                    rows.append((spec, key, whole, whole * capacity, rest, base + w.place(rest)))
                if len(rows) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)
                    rows = []
        for spec, capacity in specs:  # what stays open: a row without document
            rows += [(spec, None, OPEN, 0, capacity - room, base + number) for room, number in windows[spec].open]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_SCHEMA)

    return pack


def _merge(limit: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """Best fit of whole containers, fullest first; the new container takes the name of its first."""
        group = group.sort_values(["fill", "container"], ascending=[False, True])
        windows = Windows(int(group["capacity"].iloc[0]), len(group))
        names: list[int] = []
        target = []
        for fill, container in zip(group["fill"], group["container"], strict=True):
            number = windows.place(int(fill))
            if number == len(names):
                names.append(int(container))
            target.append(names[number])
        out = pd.DataFrame({"spec_id": group["spec_id"], "container": group["container"], "target": target, "fill": group["fill"], "group_no": group["group_no"], "capacity": group["capacity"]})
        total = out.groupby("target")["fill"].transform("sum")
        order = out.assign(total=total).sort_values(["total", "target"])
        still = set(order["target"].drop_duplicates()[:limit])  # the emptiest go on to the next level
        out["open"] = out["target"].isin(still)
        return out

    return merge


def pack(docs: DataFrame, specs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, windows: int = OPEN_WINDOWS, group: int = GROUP) -> DataFrame:
    """spec_id, doc_id, piece, first_token, n_tokens, container for every document and every capacity.

    ``specs`` has spec_id and capacity_tokens (at most 1000 rows, capacities of at least 1). Only a text of more tokens than
    the capacity is split, into full containers and a rest that is placed like any item. Null or empty text has n_tokens 0
    and no container. Rows repeated under one doc_id are separate items. Container numbers are unique within a spec.
    Input partitions must be the same when read again, as those of files are.
    """
    wanted = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").where(F.col("capacity_tokens") >= 1).distinct().orderBy("spec_id").limit(MAX_SPECS + 1).collect()]
    if len(wanted) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body"))
    placed = cut(body.mapInArrow(_packer(wanted, vocabulary, windows), _DDL))
    if not wanted:
        return placed
    capacity = F.create_map(*[F.lit(x) for kv in wanted for x in kv])
    # what each task left open, at most ``windows`` containers: the tasks say so themselves
    level = placed.where(F.col("piece") == OPEN).select("spec_id", "container", F.col("n_tokens").alias("fill"), F.shiftright("container", 32).alias("group_no"), capacity[F.col("spec_id")].alias("capacity"))
    items = placed.where(F.col("piece") != OPEN)
    parts = body.rdd.getNumPartitions()
    moves = None
    while True:
        parts = -(-parts // group)
        grouped = level.withColumn("group_no", F.floor(F.col("group_no") / group).cast("bigint"))
        merged = cut(grouped.groupBy("spec_id", "group_no").applyInPandas(_merge(windows), "spec_id bigint, container bigint, target bigint, fill bigint, group_no bigint, capacity bigint, open boolean"))
        step = merged.select("spec_id", "container", "target")
        if moves is None:
            moves = step
        else:
            onward = step.select("spec_id", F.col("container").alias("target"), F.col("target").alias("further"))
            moves = moves.join(onward, ["spec_id", "target"], "left").select("spec_id", "container", F.coalesce("further", "target").alias("target"))
        if parts <= 1:
            break
        level = merged.where("open").groupBy("spec_id", "target", "group_no", "capacity").agg(F.sum("fill").alias("fill")).select("spec_id", F.col("target").alias("container"), "fill", "group_no", "capacity")
    final = items.join(moves, ["spec_id", "container"], "left")
    return final.select("spec_id", "doc_id", "piece", "first_token", "n_tokens", F.coalesce("target", "container").alias("container"))


def utilisation(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity_tokens, n_items, n_containers, n_tokens, used: share of the containers' room that is filled."""
    per = packed.where(F.col("container").isNotNull()).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("items"))
    total = per.groupBy("spec_id").agg(F.sum("items").alias("n_items"), F.count(F.lit(1)).alias("n_containers"), F.sum("fill").alias("n_tokens"))
    joined = total.join(F.broadcast(specs.select("spec_id", "capacity_tokens").distinct().limit(MAX_SPECS)), "spec_id")
    return joined.select("spec_id", "capacity_tokens", "n_items", "n_containers", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("used"))
