"""Garbled text from a wrong character encoding: the shortest description among candidate decodings.

Places that could be bytes read with a wrong code page are found by the code pages themselves. For each code page, all
such places of a text are decoded, and the text around them is compressed before and after with a zstandard dictionary
of each language. The change of the shortest description wins if it saves more than the change itself costs; it is tried
again on the result, so that text garbled twice is restored in two steps. Lost characters are reported, not guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.samples import labelled_sample, sentences, snippets

#: Code pages that text is commonly read in by mistake, and those whose letters are then taken for others: fixed values.
WRONG_FOR_UTF8 = ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r")
WRONG_FOR_LATIN = ("cp1251", "koi8_r", "cp1253", "mac_roman", "cp437", "cp850")
LATIN = "cp1252"
DICTIONARY_BYTES = 24_000
LEVEL = 9
CONTEXT = 24
#: Bytes that a step of the chain costs; bytes that it takes to describe, if a text is left as it is, that what stands there has the
#: form of UTF-8, and that letters of another alphabet stand among Latin ones. And the longest chain of steps.
STEP_COST, UTF8_FORM, MIXED_LETTERS = 1, 3, 1
MAX_STEPS = 3
#: Bytes for a place decoded to a single character that the samples do not hold.
NEW_CHARACTER_COST = 7
#: A question mark inside a word is a lost letter unless a mark is this much shorter; at a word's end a letter must save 2.
INSIDE_MARGIN, END_MARGIN = 1, -2
LOST = re.compile("�")
_QUESTION = re.compile(r"(?<=[^\W\d_])\?(?=[a-zß-ÿ])|(?<=[^\W\d_])\?(?= [a-zß-ÿ])|(?<= )\?(?= [a-zß-ÿ])")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("chain", pa.string()), ("places", pa.int64()), ("lost", pa.int64()), ("restored", pa.string()), ("saved", pa.int64())])


@cache
def code_page(name: str) -> tuple[dict[str, int], str]:
    """char -> byte of the upper half, and the 128 characters in byte order; undefined bytes are read as controls."""
    chars = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(0x80, 0x100))
    return {c: 0x80 + k for k, c in enumerate(chars)}, chars


@cache
def utf8_run(name: str) -> re.Pattern[str]:
    """Runs of characters whose bytes in this code page have the form of UTF-8 sequences."""
    _, chars = code_page(name)
    part = lambda a, b: "[" + "".join(map(re.escape, chars[a - 0x80 : b - 0x80])) + "]"
    tail = part(0x80, 0xC0)
    return re.compile(f"(?:{part(0xC2, 0xE0)}{tail}|{part(0xE0, 0xF0)}{tail}{{2}}|{part(0xF0, 0xF5)}{tail}{{3}})+")


@cache
def any_suspect() -> re.Pattern[str]:
    """Fast first look: a lead followed by a tail in any code page, letters of two scripts side by side, or a capital after a small letter.

    It covers all that places() can find, so a capital counts at a word's end too, and so does every capital of the pages.
    """
    pairs = set()
    capitals = "".join(sorted({c for name in WRONG_FOR_LATIN for c in code_page(name)[1] if c.isupper() and not "Ͱ" <= c <= "ԯ"}))
    for name in WRONG_FOR_UTF8:
        _, chars = code_page(name)
        pairs.add("[" + "".join(map(re.escape, chars[0x42:0x75])) + "][" + "".join(map(re.escape, chars[:0x40])) + "]")
    foreign = "Ͱ-ԯ∀-◿"
    return re.compile("|".join(sorted(pairs)) + f"|[A-Za-zÀ-ɏ][{foreign}]|[{foreign}][A-Za-zÀ-ɏ]|[a-zß-öø-ɏ][{capitals}]|[a-zß-ÿ][†-™][a-zß-ÿ]|[Ͱ-ԯ](?<![^\\W\\d_].)(?![^\\W\\d_])")


_MIXED = re.compile("(?<![^\\W\\d_])[^\\W\\d_]*[^\\W\\d_\\x00-\\x7f][^\\W\\d_]*")


def _latin_word(word: str, page: dict[str, int]) -> str | None:
    """The word with this code page's odd letters read as Latin ones, if it mixes scripts or cases as no word does."""
    out, odd = [], False
    for k, c in enumerate(word):
        if ord(c) < 0x80:
            out.append(c)
            continue
        inner_capital = c.isupper() and k and word[k - 1].islower()
        foreign = "Ͱ" <= c <= "ԯ" or "∀" <= c <= "◿"
        if not (inner_capital or foreign):
            out.append(c)
            continue
        byte = page.get(c)
        if byte is None:
            return None
        new = bytes([byte]).decode(LATIN, "ignore")
        if not new.isalpha():
            return None
        odd = True
        out.append(new)
    latin = any("a" <= c.lower() <= "z" for c in word)
    return "".join(out) if odd and (latin or len(word) == 1) else None


def places(text: str, step: tuple[str, str]) -> list[tuple[int, int, str]]:
    """(start, end, decoded) of what one decoding step would change."""
    wrong, right = step
    page, _ = code_page(wrong)
    found = []
    if right == "utf_8":
        for m in utf8_run(wrong).finditer(text):
            try:
                found.append((m.start(), m.end(), bytes(page[c] for c in m[0]).decode()))
            except UnicodeDecodeError:
                continue
    else:
        for m in _MIXED.finditer(text):
            if any(utf8_run(w).search(text, m.start(), m.end() + 1) for w in WRONG_FOR_UTF8[:2]):
                continue  # bytes of UTF-8, not letters
            new = _latin_word(m[0], page)
            if new is not None and new != m[0]:
                found.append((m.start(), m.end(), new))
    return found


STEPS = tuple((w, "utf_8") for w in WRONG_FOR_UTF8) + tuple((w, LATIN) for w in WRONG_FOR_LATIN)


class Describer:
    """Length of a text under the best language dictionary, in bytes."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: str = "") -> None:
        self.alphabet = frozenset(alphabet)
        self.compressors = []
        for _, raw in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def size(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        return min((len(c.compress(data)) for c in self.compressors), default=len(data))

    def of_language(self, text: str) -> Describer:
        """One that knows only the language which describes this text best."""
        data = text.encode("utf-8", "surrogatepass")
        one = Describer({})
        one.alphabet = self.alphabet
        one.compressors = [min(self.compressors, key=lambda c: len(c.compress(data)))] if self.compressors else []
        return one

    def new_characters(self, changes: list[tuple[int, int, str]]) -> int:
        return sum(len(decoded) == 1 and decoded not in self.alphabet for _, _, decoded in changes)


def _windows(text: str, changes: list[tuple[int, int, str]]) -> tuple[str, str]:
    """The surroundings of the places, before and after; places near each other share one window."""
    old, new = [], []
    at = 0
    while at < len(changes):
        a = max(0, changes[at][0] - CONTEXT)
        parts, end = [], a
        while True:
            s, e, decoded = changes[at]
            parts += [text[end:s], decoded]
            end = e
            at += 1
            if at == len(changes) or changes[at][0] > end + 2 * CONTEXT:
                break
        b = min(len(text), end + CONTEXT)
        old.append(text[a:b])
        new.append("".join(parts) + text[end:b])
    return "\n".join(old), "\n".join(new)


def apply(text: str, changes: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, decoded in changes:
        out += [text[at:s], decoded]
        at = e
    return "".join(out) + text[at:]


def restore(text: str, describer: Describer) -> tuple[str, list[str], int, int]:
    """(text, steps taken, places changed in the first steps, bytes saved)."""
    chain: list[str] = []
    changed = saved_all = 0
    for _ in range(MAX_STEPS):
        if text.isascii() or not any_suspect().search(text):
            break
        best = None
        for step in STEPS:
            if step[1] != "utf_8" and best is not None and best[0] >= 0:
                break  # letters are taken for others only where no UTF-8 explains the text
            changes = places(text, step)
            if not changes:
                continue
            old, new = _windows(text, changes)
            as_is = describer.size(old) + (UTF8_FORM if step[1] == "utf_8" else MIXED_LETTERS)
            saved = as_is - describer.size(new) - STEP_COST - NEW_CHARACTER_COST * describer.new_characters(changes)
            if best is None or saved > best[0]:
                best = (saved, step, changes)
        if best is None or best[0] < 0:
            break
        text = apply(text, best[2])
        chain.append(f"{best[1][0]}>{best[1][1]}")
        changed += len(best[2])
        saved_all += best[0]
    return text, chain, changed, saved_all


#: Letters that may stand where a question mark took the place of one: fixed values.
ACCENTED = "áàâãäçéèêëíìîïñóòôõöúùûüßœ"


def lost_characters(text: str, describer: Describer) -> int:
    """Replacement characters, and question marks that are shorter to describe as a lost letter than as a mark."""
    n = len(LOST.findall(text))
    if _QUESTION.search(text):
        describer = describer.of_language(text)
    for m in _QUESTION.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        before, after = text[a : m.start()], text[m.end() : b]
        inside = after[:1].isalpha() and before[-1:].isalpha()
        as_letter = min(describer.size(before + c + after) for c in ACCENTED)
        as_mark = min(describer.size(before + "?" + after), describer.size(before + "? " + after))
        n += as_letter - as_mark <= (INSIDE_MARGIN if inside else END_MARGIN)
    return n


def alphabet_of(samples: list[tuple[str, str]]) -> str:
    """Characters of the samples' sentences without garbled ones, with the letters and marks of Western European text."""
    seen = set(ACCENTED + ACCENTED.upper() + "’‘“”„…–—«»€£°©®™½¼¾×¿¡§·•\u00a0")
    for _, text in samples:
        for s in sentences(text):
            if s.isascii() or not (any_suspect().search(s) or LOST.search(s)):
                seen |= set(s)
    return "".join(sorted(seen))


def train_dictionaries(samples: list[tuple[str, str]]) -> dict[str, bytes]:
    """A dictionary for each language out of its sample sentences without garbled ones; too few samples serve as they are."""
    by: dict[str, list[bytes]] = {}
    for label, text in samples:
        by.setdefault(label, []).extend(s.encode() for s in sentences(text) if s.isascii() or not (any_suspect().search(s) or LOST.search(s)))
    out = {}
    for label, parts in by.items():
        try:
            out[label] = zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            out[label] = b"\n".join(parts)[-DICTIONARY_BYTES:]
    return out


def repair(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, chain, places, lost, restored, saved for the rows with garbled or lost characters.

    ``samples`` has lang and text: clean snippets of each language; a bounded sample of the documents with the same labels
    joins them for the dictionaries. ``chain`` names the steps undone, ``''`` if nothing can be; ``lost`` counts characters
    that are gone. Other rows are not returned: null, empty and clean texts stay as they are. Every text is read whole.
    """
    clean = snippets(samples)
    languages = sorted({label for label, _ in clean})
    known = clean + labelled_sample(docs, languages)
    shared = docs.sparkSession.sparkContext.broadcast((train_dictionaries(known), alphabet_of(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(*shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or (text.isascii() and "?" not in text):
                    continue
                new, chain, n, saved = restore(text, describer)
                lost = lost_characters(new, describer) if "?" in new or "�" in new else 0
                if chain or lost:
                    rows.append({"doc_id": key, "chain": ",".join(chain), "places": n, "lost": lost, "restored": new, "saved": saved})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body"))
    return body.mapInArrow(run, "doc_id bigint, chain string, places bigint, lost bigint, restored string, saved bigint")
