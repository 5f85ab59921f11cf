"""The language of texts and of their sentences, with hyperdimensional profiles.

Every symbol has a random vector of +1 and -1. A run of three symbols is bound by multiplying the vectors of its symbols,
permuted by their place; a text is the bundle (sum) of its runs. Language prototypes are bundles of the sample sentences,
retrained on them; a sentence goes to the prototype with the highest cosine. As bundling is a sum, the product of a text
with a prototype is the sum of its runs' products, so those are computed once for every run of symbols and a text needs
table look-ups only. The length of a bundle of n runs is taken as sqrt(n * dimensions), that of nearly orthogonal vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import labelled_sample, sentence_spans, snippets

DIMENSIONS = 2048
SEED = 20240229
EPOCHS, RATE, MOMENTUM, SHARPNESS = 80, 0.05, 0.9, 24.0
#: Documents of each label that join the clean snippets for fitting, and sentences used of each language at most.
ROWS_PER_LABEL, SENTENCES_PER_LANGUAGE = 60, 900
CHUNK_CHARS = 300_000
#: A sentence speaks another language than its text's main one if its score is this much higher there, in logits.
SWITCH_MARGIN = 3.5
#: Runs of symbols, and words, that a sentence needs to speak for itself.
MIN_RUNS, MIN_WORDS = 10, 3
# Letters beyond a-z in Western European languages: fixed values.
LETTERS = "áàâäãåçéèêëíìîïñóòôöõúùûüßœæýÿ"
# Codes of the languages and their spellings as labels: fixed values.
CODES = {
    "en": ("en", "eng", "english"), "es": ("es", "spa", "spanish", "castilian"), "fr": ("fr", "fra", "fre", "french"), "de": ("de", "deu", "ger", "german"),
    "it": ("it", "ita", "italian"), "pt": ("pt", "por", "portuguese"),
}
_SPELLINGS = {spelling: code for code, spellings in CODES.items() for spelling in spellings}
_INNER_NAME = re.compile("(?<=[\\w,;’'»”)] )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ][\\w’'-]*")
_BITS = 6
_APOSTROPHE, _DIGIT, _FOREIGN = 58, 59, 60
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("main", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("first", pa.int64()), ("last", pa.int64()), ("sentences", pa.int64())])
_DDL = "doc_id bigint, main string, lang string, confidence double, first bigint, last bigint, sentences bigint"


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    table[0x370:0x2000] = _FOREIGN
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 27 + k
        if len(c.upper()) == 1:
            table[ord(c.upper())] = 27 + k
    table[ord("'")] = table[ord("’")] = _APOSTROPHE
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[0x2000:0x3000] = 0
    table[ord("’")] = _APOSTROPHE
    return table


_SYMBOLS = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """One number of six bits for each character; case is folded, all but letters, digits and apostrophes is a gap."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _SYMBOLS[np.minimum(points, 0x2FFF)]


def without_names(text: str) -> str:
    """Capitalised words inside a sentence blanked out, so that names speak for no language; positions stay."""
    return _INNER_NAME.sub(lambda m: " " * len(m[0]), text)


def runs(text: str) -> np.ndarray:
    """Codes of the runs of three symbols, names left out."""
    s = symbols(without_names(text)).astype(np.int32)
    return (s[:-2] << 2 * _BITS) | (s[1:-1] << _BITS) | s[2:] if len(s) > 2 else np.zeros(0, np.int32)


class Space:
    """Random vectors of the symbols at the three places of a run (a place is a rotation)."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], np.int8), (1 << _BITS, dimensions))
        self.dimensions = dimensions
        self.places = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self.places
        mask = (1 << _BITS) - 1
        return a[codes >> 2 * _BITS] * b[(codes >> _BITS) & mask] * c[codes & mask]

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the runs' vectors over its length."""
        if not len(codes):
            return np.zeros(self.dimensions, np.float32)
        kinds, n = np.unique(codes, return_counts=True)
        return (n.astype(np.float32) @ self.vectors(kinds).astype(np.float32)) / np.float32(np.sqrt(len(codes) * self.dimensions))

    def products(self, prototypes: np.ndarray) -> np.ndarray:
        """The product of every possible run with every prototype (rows: codes)."""
        a, b, c = (p.astype(np.float32) for p in self.places)
        out = np.empty((1 << 3 * _BITS, len(prototypes)), np.float32)
        size = 1 << _BITS
        for first in range(size):
            for_pair = (a[first] * b)[:, None, :] * prototypes[None]  # second symbol, prototype, dimension
            out[first * size * size : (first + 1) * size * size] = np.einsum("bld,cd->bcl", for_pair, c, optimize=True).reshape(size * size, -1)
        return out


class Identifier:
    """Tables of a fitted model; small enough to send to every worker whatever the corpus."""

    def __init__(self, languages: list[str], products: np.ndarray, dimensions: int) -> None:
        self.languages, self.products, self.dimensions = languages, products, dimensions

    def cosines(self, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each span with each prototype, and the runs of each span that hold a letter."""
        codes = runs(text)
        if not len(codes) or not spans:
            return np.zeros((len(spans), len(self.languages))), np.zeros(len(spans), int)
        totals = np.zeros((len(codes) + 1, len(self.languages)))
        np.cumsum(self.products[codes], axis=0, out=totals[1:], dtype=np.float64)
        middle = (codes >> _BITS) & ((1 << _BITS) - 1)
        speaks = np.concatenate(([0], np.cumsum((middle > 0) & (middle < _APOSTROPHE))))
        a = np.minimum([s[0] for s in spans], len(codes))
        b = np.clip([s[1] - 2 for s in spans], a, len(codes))
        n = b - a
        return (totals[b] - totals[a]) / np.sqrt(np.maximum(n, 1) * self.dimensions)[:, None], speaks[b] - speaks[a]


def fit(samples: list[tuple[str, str]], more: list[tuple[str, str]] = (), space: Space | None = None) -> tuple[Identifier, float]:
    """A model from clean snippets, and from further texts whose labels are mostly right: of those, sentences that the snippets'
    model gives another language are left out. Returns the share of held-out snippets given their language, too."""
    space = space or Space()
    languages = sorted({label for label, _ in samples})
    pick = {label: k for k, label in enumerate(languages)}
    clean = [(pick[label], runs(t[a:b])) for label, t in samples for a, b in sentence_spans(t) if b - a > 12]
    held_out = clean[::5]

    def train(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
        x = np.empty((len(rows), space.dimensions), np.float32)
        for k, (_, r) in enumerate(rows):
            x[k] = space.bundle(r)
        y = np.zeros((len(rows), len(languages)), np.float32)
        y[np.arange(len(rows)), [k for k, _ in rows]] = 1
        weight = (1 / y.sum(0)) @ y.T / len(languages)  # every language counts the same
        w, speed = y.T @ x, 0.0
        for _ in range(EPOCHS):
            length = np.linalg.norm(w, axis=1, keepdims=True)
            p = w / length
            z = SHARPNESS * x @ p.T
            z = np.exp(z - z.max(1, keepdims=True))
            pull = ((z / z.sum(1, keepdims=True) - y) * weight[:, None]).T @ x * SHARPNESS
            pull -= (pull * p).sum(1, keepdims=True) * p
            speed = MOMENTUM * speed - RATE * pull
            w = (p + speed).astype(np.float32)
        return w / np.linalg.norm(w, axis=1, keepdims=True)

    def right(p: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
        return np.array([int(np.argmax(p @ space.bundle(r))) == k for k, r in rows])

    first = train([r for k, r in enumerate(clean) if k % 5])
    accuracy = float(right(first, held_out).mean()) if held_out else 1.0
    extra: dict[int, list[np.ndarray]] = {}
    for label, t in more:
        for a, b in sentence_spans(t):
            if label in pick and b - a > 12 and len(extra.setdefault(pick[label], [])) < SENTENCES_PER_LANGUAGE:
                r = runs(t[a:b])
                if int(np.argmax(first @ space.bundle(r))) == pick[label]:
                    extra[pick[label]].append(r)
    final = train(clean + [(k, r) for k, rs in sorted(extra.items()) for r in rs])
    return Identifier(languages, space.products(final), space.dimensions), accuracy


def canonical(label: str | None) -> str | None:
    """The two-letter code of a label in any usual spelling (case, region, three letters, English name); None if it names none of these."""
    if not label:
        return None
    return _SPELLINGS.get(label.strip().replace("_", "-").split("-")[0].strip().lower())


def canonical_expression(label):
    """The same inside the JVM."""
    base = F.lower(F.trim(F.split(F.regexp_replace(F.trim(label), "_", "-"), "-")[0]))
    table = F.create_map(*[F.lit(x) for kv in _SPELLINGS.items() for x in kv])
    return F.try_element_at(table, base)


def sentence_languages(text: str, model: Identifier) -> tuple[int, list[tuple[int, int, int, float]]]:
    """(main language, stretches): stretches of (language, start, end, confidence), neighbours of one language joined."""
    spans = sentence_spans(text)
    cosine, n = model.cosines(text, spans)
    if not len(spans) or not n.sum():
        return -1, []
    logits = SHARPNESS * cosine
    weight = np.minimum(n, 60) / 60.0
    main = int(np.argmax((logits * weight[:, None]).sum(0)))
    best = logits.argmax(1)
    other = (best != main) & (logits.max(1) - logits[:, main] > SWITCH_MARGIN) & (n >= MIN_RUNS)
    for k in np.flatnonzero(other):
        other[k] = len(text[spans[k][0] : spans[k][1]].split()) >= MIN_WORDS
    chosen = np.where(other, best, main)
    e = np.exp(logits - logits.max(1, keepdims=True))
    sure = (e / e.sum(1, keepdims=True))[np.arange(len(spans)), chosen]
    out: list[tuple[int, int, int, float, float]] = []
    for (a, b), k, c, w in zip(spans, chosen.tolist(), sure.tolist(), weight.tolist(), strict=True):
        if out and out[-1][0] == k:
            _, a0, _, s0, w0 = out[-1]
            out[-1] = (k, a0, b, s0 + c * w, w0 + w)
        else:
            out.append((k, a, b, c * w, w))
    return main, [(k, a, b, s / w if w else 0.0) for k, a, b, s, w in out]


def identify(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, main, lang, confidence, first, last, sentences: one row for each stretch of one language in a text.

    ``first`` and ``last`` are character positions [first, last). ``main`` is the language of most of the text. Null and empty
    texts, and texts without letters, give no rows; rows repeated under one doc_id give the rows of each. ``samples`` has lang
    and text. The model is fitted on them and on a bounded sample of documents (ROWS_PER_LABEL of each label).
    """
    clean = snippets(samples)
    languages = sorted({label for label, _ in clean})
    model, _ = fit(clean, labelled_sample(docs, languages, rows=ROWS_PER_LABEL))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                main, stretches = sentence_languages(body, m)
                rows += [(key, m.languages[main], m.languages[k], round(c, 4), a, b, len(sentence_spans(body[a:b])) if len(stretches) > 1 else 0) for k, a, b, c in stretches]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    return body.mapInArrow(run, _DDL)


def relabel(docs: DataFrame, samples: DataFrame, label: str = "lang") -> DataFrame:
    """doc_id, label, lang, confidence: for rows whose label is missing, wrong, or one of several languages of the text, one row
    for each language of the text. A right label in another spelling is no case."""
    stretches = identify(docs, samples)
    languages = stretches.groupBy("doc_id", "lang").agg(F.max("confidence").alias("confidence"))
    per_row = languages.groupBy("doc_id").agg(F.collect_list(F.struct("lang", "confidence")).alias("found"))  # at most one entry a language
    labels = docs.select("doc_id", F.col(label).alias("label"), canonical_expression(F.col(label)).alias("code"))
    joined = labels.join(per_row, "doc_id")
    right = F.col("code").isNotNull() & (F.size("found") == 1) & (F.col("found")[0]["lang"] == F.col("code"))
    return joined.where(~right).select("doc_id", "label", F.explode("found").alias("f")).select("doc_id", "label", F.col("f.lang").alias("lang"), F.col("f.confidence").alias("confidence")).distinct()
