"""Evaluation passages inside training text, by a generalised suffix automaton of the evaluation items.

The items (a stated query set) are collected in blocks of bounded size; each block's automaton goes to the workers and
every corpus document is streamed through it word by word, tracking the longest suffix that occurs in an item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_WORDS = 100_000
CHUNK_CHARS = 8_000_000
_SPACE, _DROP = re.compile(r"\s+"), re.compile("[^a-z0-9 ]+")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("longest", pa.int64()), ("covered", pa.int64()), ("item_words", pa.int64())])


def words(text: str | None) -> list[str]:
    """Lower case, white space runs made one space, all but a-z 0-9 and space deleted, split at spaces."""
    return _DROP.sub("", _SPACE.sub(" ", text.lower())).split() if text else []


class Automaton:
    """All word runs of the items. ``owners[state]`` are the items that hold the state's runs."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.sizes: dict[int, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for item_id, text in items:
            sequence = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            self.sizes[item_id] = len(sequence)
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol, ends)
                ends[last].add(item_id)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        # the state of the shortest run of at least min_words that ends here: its owners share that many words
        self.anchor = list(range(len(self.length)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[up] >= min_words:
                self.anchor[state] = self.anchor[up]
        self.owners = [tuple(sorted(s)) if n >= min_words else () for s, n in zip(ends, self.length, strict=True)]

    def _state(self, length: int, link: int, following: dict[int, int], ends: list[set[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int, ends: list[set[int]]) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q, ends)
        new = self._state(self.length[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q, ends)
        return new

    def matches(self, sequence: list[str], min_words: int) -> Iterator[tuple[int, int, int]]:
        """(end position, state, length) wherever the longest match has at least ``min_words`` words."""
        known, following, link, lengths = self.vocabulary.get, self.next, self.link, self.length
        state = length = 0
        for at, word in enumerate(sequence):
            symbol = known(word)
            if symbol is None:
                state = length = 0
                continue
            to = following[state].get(symbol)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = following[state].get(symbol)
            if to is None:
                length = 0
                continue
            state = to
            length += 1
            if length >= min_words:
                yield at, state, length

    def leaked(self, sequence: list[str], min_words: int) -> dict[int, tuple[int, int]]:
        """item -> (longest shared run, words of the document inside shared runs)."""
        found: dict[int, list[int]] = {}  # item: longest, covered, covered up to
        for at, state, matched in self.matches(sequence, min_words):
            up = state
            first = self.anchor[state]
            seen: set[int] = set()
            while True:  # from the longest run down to the shortest that counts: an item's longest comes first
                n = self.length[up] if up != state else matched
                for item in self.owners[up]:
                    if item not in seen:
                        seen.add(item)
                        entry = found.setdefault(item, [0, 0, -1])
                        entry[0] = max(entry[0], n)
                        entry[1] += at - max(entry[2], at - n)
                        entry[2] = at
                if up == first:
                    break
                up = self.link[up]
        return {item: (longest, covered) for item, (longest, covered, _end) in found.items()}

    def spans(self, sequence: list[str], min_words: int) -> list[tuple[int, int]]:
        """Merged [first, last] word positions of all shared runs."""
        merged: list[list[int]] = []
        for at, _state, length in self.matches(sequence, min_words):
            first = at - length + 1
            if merged and first <= merged[-1][1] + 1:
                merged[-1] = [min(first, merged[-1][0]), at]
            else:
                merged.append([first, at])
        return [(a, b) for a, b in merged]


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The evaluation items by id in blocks of at most ``block_words`` words (an item is never divided), streamed to the driver."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull()).orderBy(item_id, text).toLocalIterator():
        n = len(words(row[1]))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    if block:
        yield block


def shared_blocks(spark: SparkSession, items: DataFrame, shortest: int, block_words: int) -> list[Broadcast[Automaton]]:
    """An automaton of each block of items. Executors read one at a time from their disks, so ``block_words`` bounds what is held."""
    return [spark.sparkContext.broadcast(Automaton(block, shortest)) for block in item_blocks(items, "item_id", "text", block_words)]


def in_turn(blocks: list[Broadcast[Automaton]]) -> Iterator[Automaton]:
    """The automata one after another; of several only one is held."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """(ids, texts) of at most about CHUNK_CHARS characters: so many texts meet each block of items at once, in one scan."""
    keys: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys.append(key)
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 10, min_coverage: float | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, longest, covered, item_words, coverage: documents sharing ``min_words`` words in a row with an item.

    With ``min_coverage`` also items of fewer words count, if that share of their words is covered by runs of at least
    half ``min_words``. Null and empty texts and items give no rows; an item repeated under another id is reported for both;
    rows repeated under one doc_id are merged. Null ids are kept.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body")).where(F.col("body") != "")
    shortest = min_words if min_coverage is None else max(1, min_words // 2)
    schema = "doc_id bigint, item_id bigint, longest bigint, covered bigint, item_words bigint"
    blocks = shared_blocks(spark, items, shortest, block_words)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            sequences = [words(t) for t in texts]
            for automaton in in_turn(blocks):
                rows = []
                for key, sequence in zip(keys, sequences, strict=True):
                    for item, (longest, covered) in automaton.leaked(sequence, shortest).items():
                        rows.append({"doc_id": key, "item_id": item, "longest": longest, "covered": covered, "item_words": automaton.sizes[item]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    out = body.mapInArrow(stream, schema)
    coverage = F.least(F.lit(1.0), F.col("covered") / F.col("item_words"))
    merged = out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"), F.max("item_words").alias("item_words"))
    kept = F.col("longest") >= min_words
    if min_coverage is not None:
        kept |= coverage >= min_coverage
    return merged.withColumn("coverage", coverage).where(kept)


def pieces(text: str) -> list[tuple[int, int, str]]:
    """(start, end with the white space after it, word) of the words of a text."""
    return [(m.start(), m.end(), w) for m in re.finditer(r"\S+\s*", text) if (w := _DROP.sub("", m[0].lower().strip().replace(" ", "")))]


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, removed: every document with the shared runs cut out of its original text.

    A removed word goes with the white space after it. Documents without a shared run are unchanged; null stays null.
    """
    blocks = shared_blocks(docs.sparkSession, items, min_words, block_words)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("removed", pa.int64())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches):
            parts = [pieces(t) if t else [] for t in texts]
            gone: list[set[int]] = [set() for _ in texts]
            for automaton in in_turn(blocks):  # every block is matched against the original text; all is cut out once
                for mine, part in zip(gone, parts, strict=True):
                    for first, last in automaton.spans([p[2] for p in part], min_words):
                        mine.update(range(first, last + 1))
            rows = []
            for key, text, part, mine in zip(keys, texts, parts, gone, strict=True):
                if mine:
                    at, kept = 0, []
                    for k, (start, end, _word) in enumerate(part):
                        if k in mine:
                            kept.append(text[at:start] if k - 1 not in mine else "")
                            at = end
                    text = "".join(kept) + text[at:]
                rows.append({"doc_id": key, "text": text, "removed": len(mine)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return body.mapInArrow(clean, "doc_id bigint, text string, removed bigint")
