"""Texts to vectors through an encoder that the caller gives: any function from a list of texts to a matrix.

A model is loaded by the encoder where it runs, once a task: pass a function without arguments that returns the encoder. The
default needs no model: signed hashing of words and of their letter triples.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import present

Encoder = Callable[[list[str]], np.ndarray]
#: Characters of a text that are encoded, and texts that are encoded at a time.
TEXT_LIMIT, TEXTS_AT_ONCE = 2000, 256
_WORD = re.compile(r"[^\W_]+")


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """Counts of words and letter triples, each added to or taken from one of ``dimensions`` numbers chosen by its hash."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in _WORD.findall(text.lower()):
                padded = f"<{word}>"
                for part in (padded, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                    h = xxhash.xxh64_intdigest(part)
                    row[(h >> 1) % dimensions] += 1 if h & 1 else -1
        return out

    return encode


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row of zeros stays."""
    m = np.asarray(matrix, np.float64)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1)


def embed(docs: DataFrame, encoder: Callable[[], Encoder] = hashing_encoder, doc_id: str = "doc_id", text: str = "rich_text", limit: int = TEXT_LIMIT) -> DataFrame:
    """doc_id, embedding of unit length, of the first ``limit`` characters; rows with absent text give none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                vectors = unit(encode(part.column(1).to_pylist())).astype(np.float32)
                flat = pa.array(vectors.reshape(-1))
                offsets = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "embedding"])

    kept = docs.where(present(text).isNotNull() & F.col(doc_id).isNotNull())
    return kept.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.substring(text, 1, limit).alias("body")).mapInArrow(run, "doc_id bigint, embedding array<float>")


def encode_query(query: str, encoder: Callable[[], Encoder] = hashing_encoder) -> tuple[float, ...]:
    """The unit vector of one query text, on the driver."""
    return tuple(float(x) for x in unit(encoder()([query]))[0])
