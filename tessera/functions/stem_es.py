"""The published Snowball Spanish stemmer, written from the algorithm's public description. Suffix lists are fixed values."""

from __future__ import annotations

import re

VOWELS = "aeiouáéíóúü"
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
#: Verb forms before an attached pronoun, and what each becomes without its accent.
GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
ATTACHED = ("ando", "iendo", "ar", "er", "ir")
STANDARD = {
    "": ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion",
    "log": "logía logías",
    "u": "ución uciones ucion",
    "ente": "encia encias",
}
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
EN_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás"
    " iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido"
    " ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos"
    " íamos imos áramos iéramos iésemos ásemos"
).split()
_PLAIN = str.maketrans("áéíóú", "aeiou")
_AFTER_VOWEL = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    r1 = m.end() if (m := _AFTER_VOWEL.search(w)) else len(w)
    r2 = m.end() if (m := _AFTER_VOWEL.search(w, r1)) else len(w)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
        elif w[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _longest(w: str, suffixes, start: int = 0) -> str:
    """The longest of the suffixes with which the word ends from ``start`` on, else ''."""
    return max((s for s in suffixes if w.endswith(s) and len(w) - len(s) >= start), key=len, default="")


def _without_pronoun(w: str, rv: int) -> str:
    pronoun = _longest(w, PRONOUNS)
    if not pronoun:
        return w
    body = w[: -len(pronoun)]
    verb = _longest(body, GERUNDS, rv)
    if verb:
        return body[: -len(verb)] + GERUNDS[verb]
    if _longest(body, ATTACHED, rv) or (body.endswith("uyendo") and len(body) - 5 >= rv):
        return body
    return w


def _drop(w: str, suffixes, start: int) -> str:
    found = _longest(w, suffixes, start)
    return w[: len(w) - len(found)] if found else w


def _standard(w: str, r1: int, r2: int) -> str | None:
    """The word after the step of standard suffixes; None where none is taken off."""
    kinds = {s: kind for kind, listed in STANDARD.items() for s in listed.split()} | {"amente": "amente", "mente": "mente", "idad": "idad", "idades": "idad", "iva": "iv", "ivo": "iv", "ivas": "iv", "ivos": "iv"}
    found = _longest(w, kinds)
    if not found:
        return None
    at, kind = len(w) - len(found), kinds[found]
    if kind == "amente":
        if at < r1:
            return None
        w = w[:at]
        if w.endswith("iv") and len(w) - 2 >= r2:
            return _drop(w[:-2], ("at",), r2)
        return _drop(w, ("os", "ic", "ad"), r2)
    if at < r2:
        return None
    body = w[:at]
    if kind in ("", "ic"):
        return _drop(body, ("ic",), r2) if kind == "ic" else body
    if kind in ("log", "u", "ente"):
        return body + kind
    return _drop(body, {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "iv": ("at",)}[kind], r2)


def stem(word: str) -> str:
    """The stem of a lower-case word, accents dropped."""
    rv, r1, r2 = _regions(word)
    w = _without_pronoun(word, rv)
    after = _standard(w, r1, r2)
    if after is not None:
        w = after
    else:
        found = _longest(w, Y_VERBS, rv)
        if found and w[: -len(found)].endswith("u"):
            w = w[: -len(found)]
        elif found := _longest(w, [*VERBS, *EN_VERBS], rv):
            w = w[: -len(found)]
            if found in EN_VERBS and w.endswith("gu"):
                w = w[:-1]
    if found := _longest(w, ("os", "a", "o", "á", "í", "ó"), rv):
        w = w[: -len(found)]
    elif (w.endswith(("e", "é"))) and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)
