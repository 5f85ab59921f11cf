"""Text cut off by field limits: endings that the corpus hardly ever ends with.

From all sentences of all texts come a vocabulary trie (known words and their prefixes) and, for the last one to three words
before every position, how often a further word, a closing mark, or an unmarked end follows. A text that ends without a
closing mark, or with a mark of omission, is cut off if its last token is an unknown proper prefix of known words, or if
its last words mostly go on (or, without a mark, mostly go on or close with one). Texts cut within the same word end alike, so
an end that others share is one only if it is no rare way on from the words before it: a beginning of known words that hardly ever
follows them is cut off, however many texts stop there. Lengths that gather at a source's limit lower the bar. Names and numbers
are one word each in contexts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.llm.encoding import STEPS, any_suspect, apply, places
from tessera.skew import hot_keys, salted_lookup

#: Other occurrences a context needs, and the share of them that must go on, without and with length evidence.
MIN_SUPPORT, UNFINISHED, UNFINISHED_AT_LIMIT = 3, 0.5, 0.25
#: A beginning of longer words is a rare way on if it follows the words before it in less than this share of the cases; where no word
#: stands before it, if the longer words have more than so many times as many rows as it (and as texts that stop there).
RARE, LONGER_TIMES = 0.01, 20
#: Rows a word needs to be known.
KNOWN_ROWS = 3
#: A source has a limit wherever at least so many texts have lengths in a window of at most this many characters (or bytes).
LIMIT_ROWS, LIMIT_BAND = 5, 16
#: The lengths on either side of a window that say how many texts it would hold without a limit, how many times as many it must
#: hold, and how far from chance that must be (log-likelihood ratio of Poisson counts).
LIMIT_REACH, LIMIT_TIMES, LIMIT_GAIN = 64, 2, 16
#: Bytes by which a text cut at a byte limit may be shorter, as its last character did not fit.
SPLIT_CHARACTER = 3
BATCH_TOKENS = 400_000
HELD_WORDS = 300_000
TAIL = 80
ROWS_PER_TASK = 1_000_000

_TOKEN = re.compile("[^\\W\\d_]+(?:['’][^\\W\\d_]+)*|\\d+|[.!?…\n]+|[\U0001F000-\U0001FAFF☀-➿]+|[:;]-?[)(]|<3")
#: Marks that say text was left out, and marks that close a sentence: fixed values.
OMISSION = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|(?:\.\.\.|…)\s*\((?:more|read more|mehr|más|mais|suite|continua)\)|\((?:more|read more)\)|(?:\.\.\.|…)\s*(?:[Rr]ead more|[Mm]ehr lesen|[Ll]eer más|[Ll]ire la suite|[Ll]eia mais|[Ll]eggi tutto)|\.\.\.|…))+\s*$")
CLOSED = re.compile("(?:[.!?]|[\\U0001F000-\\U0001FAFF☀-➿]|[:;]-?[)(DP]|<3)[\"”’»)\\]]*\\s*$")
_NAME, _NUMBER, _START, _MARK, _END = (xxhash.xxh64_intdigest(x) >> 1 for x in ("\x00name", "\x00number", "\x00start", "\x00mark", "\x00end"))
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("h", pa.int64()), ("goes_on", pa.int64()), ("closes", pa.int64()), ("stops", pa.int64()), ("doc_id", pa.int64()), ("h2", pa.int64()), ("h1", pa.int64()), ("word", pa.string()), ("omitted", pa.bool_()), ("p2", pa.int64()), ("p1", pa.int64())]
)
_LIMITS = pa.schema([("s", pa.string()), ("unit", pa.string()), ("length", pa.int64()), ("n", pa.int64())])
_DDL = "kind int, h bigint, goes_on bigint, closes bigint, stops bigint, doc_id bigint, h2 bigint, h1 bigint, word string, omitted boolean, p2 bigint, p1 bigint"


def mended(text: str) -> str:
    """The text with its last characters read in their right encoding where they form UTF-8, so that marks and words there count."""
    tail = text[-TAIL:]
    if tail.isascii() or not any_suspect().search(tail):
        return text
    for _ in range(2):  # garbled twice at most
        for step in STEPS:
            changes = [c for c in places(tail, step) if step[1] == "utf_8" and all(x < "ɐ" or "\u2010" <= x <= "\u20ac" or x > "\U0001f000" for x in c[2])]
            if changes:
                tail = apply(tail, changes)
                break
        else:
            break
    return text[:-TAIL] + tail


class _Words:
    """token -> number; arrays of each number's hash as a word, whether it looks like a name, whether it is a mark."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens: list[str] = []
        self.hashes: list[int] = []
        self.named: list[bool] = []
        self.marks: list[bool] = []

    def add(self, token: str) -> int:
        k = self.number[token] = len(self.hashes)
        self.tokens.append(token)
        first = token[0]
        mark = not (first.isalpha() or first.isdigit())
        self.hashes.append(_MARK if mark else _NUMBER if first.isdigit() else xxhash.xxh64_intdigest(token.lower()) >> 1)
        self.named.append(first.isupper() and len(token) > 1 and not token.isupper())
        self.marks.append(mark)
        return k

    def numbers(self, tokens: list[str]) -> list[int]:
        found = list(map(self.number.get, tokens))
        if None in found:
            number, add = self.number, self.add
            found = [number[t] if t in number else add(t) for t in tokens]
        return found


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(1)).astype(np.int64)


def _contexts(numbers: np.ndarray, firsts: np.ndarray, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the last 1, 2, 3 words at each position, what follows (0 a word, 1 a mark, 2 an unmarked end), and which positions are words."""
    h = np.asarray(words.hashes, np.int64)[numbers]
    mark = np.asarray(words.marks, bool)[numbers]
    start = firsts | np.concatenate(([True], mark[:-1]))
    name = np.asarray(words.named, bool)[numbers] & ~start
    h[name] = _NAME
    one = np.concatenate(([_START], h[:-1]))
    one[start] = _START
    two = np.concatenate(([_START], one[:-1]))
    two[start] = _START
    h2 = _mix(h, one)
    h3 = _mix(h2, two)
    last = np.concatenate((firsts[1:], [True]))
    after_mark = np.concatenate((mark[1:], [False]))
    follows = np.where(last, 2, np.where(after_mark, 1, 0))
    return _mix(h, np.full_like(h, 7)), h2, h3, follows, ~mark


def _counted(hashes: np.ndarray, follows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(hashes, kind="stable")
    hashes, follows = hashes[order], follows[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    n = len(first)
    sums = [pa.array(np.add.reduceat((follows == k).astype(np.int64), first)) for k in range(3)]
    empty = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(hashes[first]), *sums, empty(pa.int64()), empty(pa.int64()), empty(pa.int64()), empty(pa.string()), empty(pa.bool_()), empty(pa.int64()), empty(pa.int64())], schema=_SCHEMA)


def ending(text: str) -> tuple[str, bool] | None:
    """(text without the mark of omission, whether there was one) where the end is not closed; None where it is."""
    body = text.rstrip()
    at = max(0, len(body) - TAIL)  # marks are short; only the end is searched for them
    m = OMISSION.search(body, at)
    if m and m.start() > 0:
        return body[: m.start()].rstrip(), True
    return None if CLOSED.search(body, at) else (body, False)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: counts of context h; 1: an open ending of doc_id with its contexts and, as p1 and p2, those of the word before it in the sentence; 2: rows (goes_on) that hold a word."""
    words = _Words()
    rows_with: Counter[int] = Counter()  # by the word's number
    held: list[int] = []
    firsts: list[int] = []
    open_ends: list[tuple[int, int, str, bool]] = []  # position of the last token, doc_id, last token, omitted

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal words
        if held:
            numbers = np.asarray(held, np.int64)
            first = np.zeros(len(numbers), bool)
            first[firsts] = True
            h1, h2, h3, follows, is_word = _contexts(numbers, first, words)
            yield _counted(np.concatenate((h1[is_word], h2[is_word], h3[is_word])), np.tile(follows[is_word], 3))
            if open_ends:
                at = np.asarray([x[0] for x in open_ends])
                n = len(at)
                none = pa.nulls(n, pa.int64())
                stop = pa.array((follows[at] == 2).astype(np.int64))
                opens = first[at] | ~is_word[at - 1]  # nothing stands before it in its sentence
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(n, np.int32)), pa.array(h3[at]), none, pa.array((follows[at] == 1).astype(np.int64)), stop, pa.array([x[1] for x in open_ends], pa.int64()), pa.array(h2[at]), pa.array(h1[at]), pa.array([x[2] for x in open_ends]), pa.array([x[3] for x in open_ends]), pa.array(h2[at - 1], mask=opens), pa.array(h1[at - 1], mask=opens)],
                    schema=_SCHEMA,
                )
        held.clear()
        firsts.clear()
        open_ends.clear()
        if len(words.hashes) > HELD_WORDS:
            yield vocabulary()
            words = _Words()

    def vocabulary() -> pa.RecordBatch:
        lowered: Counter[str] = Counter()
        for k, n in rows_with.items():
            if words.tokens[k][0].isalpha():
                lowered[words.tokens[k].lower()] += n
        rows_with.clear()
        n = len(lowered)
        none = lambda t=pa.int64(): pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), none(), pa.array(list(lowered.values()), pa.int64()), none(), none(), none(), none(), none(), pa.array(list(lowered), pa.string()), none(pa.bool_()), none(), none()], schema=_SCHEMA)

    for batch in batches:
        for key, text, case in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text or text.isspace():
                continue
            text = mended(text)
            tail = ending(text)
            tokens = _TOKEN.findall(text)
            if not tokens:
                continue
            firsts.append(len(held))
            if tail is not None:
                kept = len(_TOKEN.findall(tail[0]))
                if kept and case:
                    open_ends.append((len(held) + kept - 1, key, tokens[kept - 1], tail[1]))
                    if not tail[1]:
                        tokens = tokens[:kept]
            numbers = words.numbers(tokens)
            held += numbers
            rows_with.update(set(numbers if tail is None or tail[1] else numbers[:-1]))
            if len(held) >= BATCH_TOKENS:
                yield from flush()
    yield from flush()
    if rows_with:
        yield vocabulary()


def _spike(lengths: np.ndarray, texts: np.ndarray) -> tuple[float, int, int]:
    """(gain, lowest length, highest length) of the window that stands out most from the lengths around it; gain 0 if none does."""
    lengths, place = np.unique(lengths, return_inverse=True)
    total = np.concatenate(([0], np.cumsum(np.bincount(place, texts))))
    upto = lambda x: total[np.searchsorted(lengths, x, "right")]
    here, above, best = upto(lengths), upto(lengths + LIMIT_REACH), (0.0, 0, 0)
    for width in range(1, LIMIT_BAND + 1):
        under = upto(lengths - width)
        near = here - under
        usual = width * (above - here + under - upto(lengths - width - LIMIT_REACH) + 1) / (2 * LIMIT_REACH)
        gain = np.where((near >= LIMIT_ROWS) & (near >= LIMIT_TIMES * usual), near * np.log(near / usual) - near + usual, 0)
        k = int(gain.argmax())
        if gain[k] >= LIMIT_GAIN and gain[k] > best[0]:
            best = (float(gain[k]), int(lengths[k]) - width + 1, int(lengths[k]))
    return best


def limits(sizes: pa.Table) -> pa.Table:
    """s, unit, length, n: the lengths at a limit of one source, with its rows there, from its rows by (chars, bytes).

    The clearest spike of both histograms is taken first and its rows are set aside, so that one limit does not count in both units.
    """
    found: list[dict] = []
    if sizes.num_rows == 0:
        return pa.Table.from_pylist(found, schema=_LIMITS)
    source = sizes.column("s")[0].as_py()
    left = {c: sizes.column(c).to_numpy() for c in ("chars", "bytes", "texts", "n")}
    while len(left["n"]):
        gain, low, high, unit = max(((*_spike(left[u], left["texts"]), u) for u in ("chars", "bytes")), key=lambda x: x[0])
        if not gain:
            break
        low -= SPLIT_CHARACTER * (unit == "bytes")
        inside = (left[unit] >= low) & (left[unit] <= high)
        n = np.bincount(left[unit][inside] - low, left["n"][inside])
        found += [{"s": source, "unit": unit, "length": low + k, "n": int(x)} for k, x in enumerate(n) if x]
        left = {c: x[~inside] for c, x in left.items()}
    return pa.Table.from_pylist(found, schema=_LIMITS)


def at_limit(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id of the rows whose length lies at a length limit of their source, in characters or in bytes, longer rows or not."""
    # a few numbers a row, read several times below: kept, so that the texts are read once
    sized = cut(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.length(text).cast("bigint").alias("chars"), F.octet_length(text).cast("bigint").alias("bytes"), F.xxhash64(text).alias("same")).where(F.col("chars") > 0))
    # one row a source and size, not a row of the corpus; copies of a text say nothing about a limit and count once
    sizes = sized.groupBy("s", "chars", "bytes").agg(F.count_distinct("same").alias("texts"), F.count(F.lit(1)).alias("n"))
    lens = cut(sizes.groupBy("s").applyInArrow(limits, "s string, unit string, length bigint, n bigint"))
    found = None
    for unit in ("chars", "bytes"):
        key = F.struct("s", F.col(unit).alias("length")).alias("key")
        own = lens.where(F.col("unit") == unit).groupBy(F.struct("s", "length").alias("key")).agg(F.sum("n").alias("n"))
        rows = salted_lookup(sized.select("doc_id", key), own.select("key"), "key", hot_keys(own, "key", F.col("n"), ROWS_PER_TASK), F.col("doc_id")).select("doc_id")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def find_truncated(docs: DataFrame, doc_id: str = "doc_id", text: str = "rich_text", source: str = "source", cases: Column | None = None) -> DataFrame:
    """doc_id, unfinished, support, words, unknown_prefix, at_limit for rows that stop before their last sentence or word ended.

    ``unfinished`` is the share of the other occurrences of the last ``words`` words that go on (or close with a mark that is
    missing here), ``support`` their number. Null, empty and blank texts, and texts without a word, are no cases. Rows
    repeated under one doc_id are judged together: one row if any is cut off. The contexts of all texts are counted, combined
    in each task before the shuffle; contexts looked up by very many rows are spread over several tasks. Rows for which ``cases``
    is false or null are counted as the others but are no cases themselves.
    """
    case = F.lit(True) if cases is None else F.coalesce(cases, F.lit(False))
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"), case.alias("case"))
    evidence = cut(body.mapInArrow(_evidence, _DDL))
    counts = evidence.where("kind = 0").groupBy("h").agg(F.sum("goes_on").alias("goes_on"), F.sum("closes").alias("closes"), F.sum("stops").alias("stops"))
    ends = evidence.where("kind = 1").select("doc_id", F.col("h").alias("h3"), "h2", "h1", F.lower("word").alias("word"), "omitted", F.col("closes").alias("own_close"), F.col("stops").alias("own_stop"), "p2", "p1")
    own = ["doc_id", "h3", "p1", "omitted", "own_close", "own_stop"]
    long = ends.select(*own, F.explode(F.array(*[F.struct(F.lit(k).alias("words"), F.col(c).alias("h")) for k, c in ((1, "h1"), (2, "h2"), (3, "h3"), (-1, "p1"), (-2, "p2"))])).alias("c"))
    asked = long.select(*own, F.col("c.words").alias("words"), F.col("c.h").alias("h")).where("h is not null")
    hot = hot_keys(asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", F.col("n"), ROWS_PER_TASK)
    met = salted_lookup(asked, counts, "h", hot, F.col("doc_id"))
    every = F.col("goes_on") + F.col("closes") + F.col("stops")
    others = every - F.col("own_close") - F.col("own_stop")
    open_count = F.when(F.col("omitted"), F.col("goes_on")).otherwise(F.col("goes_on") + F.col("closes") - F.col("own_close"))
    usable = met.select("doc_id", "h3", "p1", "words", every.alias("every"), F.col("goes_on").alias("ways"), F.when(F.col("words") > 0, others).alias("support"), (open_count / F.greatest(others, F.lit(1))).alias("unfinished"))
    enough = F.when(F.col("support") >= MIN_SUPPORT, F.col("words"))
    of = lambda k, c: F.max(F.when(F.col("words") == k, F.col(c)))
    each = usable.groupBy("doc_id", "h3", "p1").agg(F.max_by(F.struct("words", "support", "unfinished"), enough).alias("b"), F.max("support").alias("seen"), of(3, "every").alias("n3"), of(2, "every").alias("n2"), of(-2, "ways").alias("on2"), of(-1, "ways").alias("on1"))
    rare = F.when(F.col("b.words") == 3, F.col("n3") < RARE * F.col("on2")).when(F.col("b.words") > 0, F.col("n2") < RARE * F.col("on1"))
    best = each.groupBy("doc_id").agg(F.max_by("b", "b.words").alias("b"), F.max("seen").alias("seen"), F.max(F.coalesce(rare, F.lit(False))).alias("rare"), F.max(F.col("p1").isNull()).alias("opens"))
    vocabulary = evidence.where("kind = 2").groupBy("word").agg(F.sum("goes_on").alias("n")).where(F.col("n") >= KNOWN_ROWS)
    # the trie as a table of its nodes: every proper prefix of every known word
    nodes = vocabulary.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.struct(F.substring(F.col("word"), F.lit(1), k).alias("p"), (k == F.length("word")).alias("whole")))).alias("x")).groupBy(F.col("x.p").alias("word")).agg(F.sum(F.when(F.col("x.whole"), F.col("n"))).alias("alone"), F.sum(F.when(~F.col("x.whole"), F.col("n"))).alias("longer"))
    common = hot_keys(ends.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word", F.col("n"), ROWS_PER_TASK)
    prefixes = nodes.where("longer > 0")
    tails = salted_lookup(ends.select("doc_id", "word"), prefixes, "word", common, F.col("doc_id")).groupBy("doc_id").agg(F.max(F.col("alone").isNull()).alias("unknown_prefix"), F.max("longer").alias("longer"), F.max("alone").alias("alone"))
    limited = at_limit(docs, doc_id, text, source).withColumn("at_limit", F.lit(True))
    letters = F.when(F.col("word").rlike(r"^\p{L}+$"), F.length("word")).otherwise(0)
    open_rows = ends.groupBy("doc_id").agg(F.min("omitted").alias("omitted"), F.min(letters).alias("letters"))
    judged = open_rows.join(best, "doc_id", "left").join(tails, "doc_id", "left").join(limited, "doc_id", "left").na.fill(False, ["unknown_prefix", "at_limit", "rare", "opens"])
    bar = F.when(F.col("at_limit"), F.lit(UNFINISHED_AT_LIMIT)).otherwise(F.lit(UNFINISHED))
    shown = judged.select("doc_id", F.col("b.unfinished").alias("unfinished"), F.coalesce("b.support", F.lit(0)).alias("support"), F.coalesce("b.words", F.lit(0)).alias("words"), F.coalesce("seen", F.lit(0)).alias("seen"), "unknown_prefix", "at_limit", "omitted", "letters", bar.alias("bar"), "rare", "opens", "longer", "alone")
    unseen = F.col("unfinished").isNull() & (F.col("at_limit") | (~F.col("omitted") & (F.col("seen") == 0)))  # a last word found nowhere else
    letter = (F.col("letters") == 1) & (F.col("words") <= 1)  # one letter, and no context that texts end with
    # others that stop alike were cut alike: the last word begins longer words, and hardly ever stands there
    alike = F.col("longer").isNotNull() & (F.col("rare") | (F.col("opens") & (F.col("at_limit") | (F.col("longer") > LONGER_TIMES * F.greatest("support", "alone")))))
    cut_off = (F.col("unfinished") > F.col("bar")) | F.col("unknown_prefix") | unseen | letter | alike
    return shown.where(cut_off).drop("bar", "omitted", "letters", "seen", "rare", "opens", "longer", "alone")


def rates(docs: DataFrame, truncated: DataFrame, source: str = "source") -> DataFrame:
    """source, n_rows, n_truncated, share; the null source is a group of its own."""
    marked = docs.select("doc_id", source).join(truncated.select("doc_id").distinct().withColumn("hit", F.lit(1)), "doc_id", "left")
    return marked.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_truncated")).withColumn("share", F.round(F.col("n_truncated") / F.col("n_rows"), 6))
