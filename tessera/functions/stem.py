"""The published Snowball English stemmer (Porter 2), applied to a vocabulary rather than to running text.

Written from the algorithm's public description. Suffix lists and exceptional forms are fixed values.
"""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less",
    "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = m.end() if (m := _REGION.search(word)) else len(word)
    r2 = m.end() if (m := _REGION.search(word, r1)) else len(word)
    return r1, r2


def _short_syllable_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _strip_plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        return w[:-1]
    return w


def _strip_past(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if not any(c in VOWELS for c in stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(DOUBLES):
                return stem[:-1]
            return stem + "e" if r1 >= len(stem) and _short_syllable_end(stem) else stem
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own stem."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    for suffix in ("'s'", "'s", "'"):
        if w.endswith(suffix):
            w = w[: -len(suffix)]
            break
    w = _strip_plural(w)
    if w in KEPT_AFTER_1A:
        return w
    w = _strip_past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for suffix, new in STEP_2.items():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple(LI_ENDINGS)):
                w = w[:at] + new
            break
    for suffix, new in STEP_3.items():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + new
            break
    for suffix in STEP_4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def stemmer(language: str) -> Callable[[str], str]:
    """The stemming function of a language: english or spanish."""
    if language == "spanish":
        from tessera.functions.stem_es import stem as spanish

        return spanish
    if language == "english":
        return stem
    raise ValueError("language must be english or spanish")


def stem_vocabulary(postings: DataFrame, language: str = "english") -> DataFrame:
    """term, stem for each distinct term: the only Python work, done once a term and not once a token."""
    one = stemmer(language)

    def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in words:
            yield s.map(lambda w: one(w) if isinstance(w, str) else None)

    return postings.select("term").distinct().select("term", F.pandas_udf(stems, StringType())("term").alias("stem"))


def stem_postings(postings: DataFrame, language: str = "english") -> DataFrame:
    """Postings with stems as terms; counts of terms with one stem add up."""
    stems = stem_vocabulary(postings, language)
    return postings.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))
