"""Template residue, filler and error pages in place of content.

Texts are cut into sentences and each sentence into a frame: its words, with numbers, names and placeholder tokens as
slots. Frames align the sentences made from one template across all records. A slot that still holds a variable name is
residue; one that holds a default (``null``) or nothing is residue if the same frame is seen filled elsewhere. Pages whose whole
run of frames is repeated across records, while their sentences hardly occur in other texts, are error templates whatever their
wording and whatever their slots hold; so is a text that holds a sentence of such a page. What no second record shows is recognised by the syntax of template
languages and by the wording of notices and fillers.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from re import _constants as ops

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.skew import hot_keys, salted_lookup

HELD_FRAMES = 400_000
ROWS_PER_TASK = 1_000_000
#: A page is a repeated template if so many records have it and its sentences are at least this share inside such pages.
MIN_PAGES, PAGE_SHARE = 3, 0.5
#: Records that must hold a frame with its slots filled before a default or a blank in it counts.
MIN_FILLED = 2

# Placeholder syntax of template languages and form letters: fixed values.
PLACEHOLDERS = (
    r"\{\{[^{}]*\}\}",
    r"\$\{[^{}]*\}",
    r"\{%[^{}]*%\}",
    r"\{(?:[A-Za-z_]\w{0,60}(?:\.\w{1,40}){0,4}|\d{0,3})\}",
    r"%\([A-Za-z_]\w*\)[sdif]",
    r"%[A-ZÀ-Þ_]{3,}%",
    r"(?<![\w%])%[sd]\b",
    r"<%.{0,200}?%>",
    r"@@\w+@@",
    r"##?[A-Z][A-Z_\d]{2,60}#{1,2}",
    r"__[A-Z_]{3,}__",
    r"\[\[\w+\]\]",
    r"(?i:\[(?:[^\]\[\n]{0,40}\b)?(?:insert|add|enter|your|placeholder|here|text|ajouter|insérer|texte|ici|insertar|añadir|texto|aquí|inserir|adicionar|aqui|einfügen|hier|inserire|aggiungere|testo|qui)\b[^\]\[\n]{0,60}\])",
    r"\[[A-Z]+(?:_[A-Z\d]+)+\]",
    r"\$[A-Z][A-Z_]+\$",
    r"\b[A-Z]+_HERE\b",
    r"\?[a-z]+(?:_[a-z0-9]+)+\?",
    r"<[a-z]+(?:_[a-z]+)+>",
    r"\[object Object\]",
)
PLACEHOLDER = re.compile("|".join(PLACEHOLDERS))
# Values that programs print where a value is missing: fixed values.
SURE_DEFAULT = re.compile(r"\bNaN\b|\bnull\b[^.]{0,40}\bnull\b|\bNone\b[^.]{0,40}\bNone\b|(?<![Aa]n )(?<![Tt]he )(?<!remains )(?<!left )\bundefined\b|\bTBD\b\W+\bTBD\b")
MAYBE_DEFAULT = re.compile(r"\bnull\b|\bNone\b|\bN/A\b|\bTBD\b|\bTBA\b|\bnil\b|\bunknown\b|(?<=\w)\s+,|\(\s*\)|(?:(?<=\bby)|(?<=\bfrom)|(?<=\bin)|(?<=\bof)|(?<=\bvon)|(?<=\bde)|(?<=\bdi)|(?<=\bpar))\s+(?=[.,;])")
# Wording of filler and of notices in six languages: fixed values.
FILLER = (
    r"lorem ipsum|dolor sit amet",
    r"(?:\bbla\b[\s,]*){3,}",
    r"\b(x)\1{2,}\b(?:\s+x{2,}\b)+",
    r"\basdf\b|\bqwer\b.*\bqwer\b|\bqwerty\b",
    r"\b(?:dummy|sample|placeholder|filler)\s+(?:content|text)\b",
    r"\btext goes here\b|\bgoes here,? your\b|\byour text here\b",
    r"\b(?:description|synopsis|overview|review|text|content)\s+(?:is\s+)?(?:coming soon|to follow|to be (?:written|added|announced)|pending)\b",
    r"(?-i:\bTODO)(?:\s*:|\s+(?:editor|ask|add|write|fix|insert|replace)\b)",
    r"(?:\btest\b\s*){3,}",
    r"\breplace this (?:paragraph|text|sentence|line)\b|\bbefore publishing\b",
    r"^\W*enter (?:a |the |your )?(?:\w+ )?(?:summary|text|synopsis|description|review)\b|\(max\.? \d+ char",
    r"\btexto de (?:ejemplo|exemplo|relleno)\b|\btexte d.exemple\b|\btesto (?:segnaposto|di esempio)\b|\b(?:platzhalter|blind|beispiel)text\b",
    r"\b(?:sinopsis|sinopse|descripción|descrição|trama|résumé|beschreibung)\b.{0,12}\b(?:pendiente|pendente|próximamente|em breve|in arrivo|à venir|bientôt|folgt)\b",
)
NOTICES = (
    r"\b(?:enable|activate|switch on|turn on|allow|needs?|requires?|because)\b.{0,30}\b(?:javascript|scripts|cookies)\b",
    r"\b(?:javascript|scripts|cookies)\b.{0,24}\b(?:disabled|required|enabled|blocked|must be)\b",
    r"\bplease (?:reload|refresh|try again|log in|sign in|enable)\b|\bpress refresh\b|\band reload\b|, please reload\b",
    r"\byour (?:browser|session|connection)\b.{0,40}\b(?:expired|checked|outdated|supported|lost|timed)\b|\bsettings of your browser\b|\brequests from your address\b|\bin this browser\b",
    r"\b(?:page|record|listing|site|service|film|content|review)\b (?:was |is |could |has been |temporarily )*(?:not (?:be )?(?:found|available|loaded)|unavailable|withdrawn|removed)\W*$",
    r"\bpage you (?:were|are) looking for\b|\bgo back to the (?:start|home) ?page\b|\bwhy do i see this page\b|^\W*page not found\W*$",
    r"\binternal server error\b|\bbad gateway\b|\bgateway time-?out\b|\bservice unavailable\b|\b(?:request|connection|gateway) timed out\b",
    r"\b(?:error|erreur|fehler|errore|erro)\s?:?\s?[345]\d\d\b|^\W*[45]\d\d (?:[A-Z]|\w+ (?:error|gateway|found))|\bHTTP/\d|\bretry-after\b",
    r"\baccess denied\s*(?::|\W*$)|\b403 forbidden\b|\bdo not have permission\b|\bautomated traffic\b|\bnot a robot\b|\bcaptcha\b|\btoo many requests\b",
    r"\band try again\W*$|^\W*(?:please )?try again(?: later| in .{0,20})?\W*$|\bwait \d+ (?:seconds|minutes)\b",
    r"\bdown for maintenance\W*$|\bunder maintenance\W*$|\bwe will be back (?:shortly|soon)\b|\bthank you for your patience\b",
    r"\bseem to be offline\b|\bcheck (?:the|your) (?:internet )?connection\b|\bincident\b.{0,20}\blogged\b|^\W*reference [0-9a-f]{6,}",
    r"\b(?:could not|cannot|can't|failed to) (?:be )?load(?:ed)?\b|\bwhile (?:loading|fetching)\b.{0,20}\b(?:review|page|film|record|text)|\bbody missing\b",
    r"\b\w+(?:Exception|Error)\b(?::|\s+at\b)|\bTraceback \(most|\bcannot read propert|\bat \w+\.\w+ line \d",
    r"\"(?:code|error|message|trace|status)\"\s*:|</?(?:html|head|body|title|div|script|span|iframe)\b[^>]{0,400}>",
    r"\bactiv\w*\b.{0,20}\b(?:javascript|scripts|cookies)\b|\bative\b.{0,20}\b(?:javascript|scripts|cookies)\b|\battiva\w*\b.{0,20}\b(?:javascript|script|cookie)",
    r"\baktivieren\b.{0,20}\bjavascript\b|\bjavascript\b.{0,30}\b(?:aktivier|navegador|navigateur|browser|seite neu|leer|ler|lire|leggere)",
    r"\bno se ha encontrado la página\b|\bpágina no encontrada\b|\bpágina não encontrada\b|\bpage introuvable\b|\bseite (?:wurde )?nicht gefunden\b|\bpagina non trovata\b",
    r"\bservicio no disponible\b|\bserviço indisponível\b|\bservice (?:temporairement )?indisponible\b|\bservizio (?:temporaneamente )?non disponibile\b|\bdienst nicht verfügbar\b|\bwartungsarbeiten\b.{0,40}(?:seite|erreichbar|\W*$)|\bin kürze wieder (?:erreichbar|verfügbar|da)\b|\btravaux de maintenance\b|\bem manutenção\W*$|\bin manutenzione\W*$|\ben mantenimiento\W*$",
    r"^\W*(?:acceso denegado|acesso negado|accès refusé|accesso negato|zugriff verweigert)\W*$",
    r"\bvuelva a la (?:portada|página)|\bvolte ao início\b|\bvuelva a intentarlo\b|\binténtelo\b|\btente (?:novamente|mais tarde|outra vez)\b|\briprova(?:re)?\b.{0,24}\b(?:minuto|minuti|tardi)|\bveuillez (?:réessayer|recharger|activer|patienter)\b|\bversuchen sie es (?:später|erneut)\b|\bladen sie die seite\b",
    r"\berrore del server\b|\berror del servidor\b|\berro do servidor\b|\berreur (?:du )?serveur\b|\bserverfehler\b|\ble serveur a rencontré\b|\bcódigo do incidente\b|\bcodice [0-9a-f]{6,}",
    r"\bn.a pas pu être chargée?s?\b|\bno se (?:ha podido|pudo) cargar\b|\bnão (?:foi possível|pôde) carregar\b|\bkonnte nicht geladen\b|\bnon è stato possibile caricare\b|\bvisualizzare il contenuto\b.{0,20}\boccorre\b",
    r"\bsesión (?:ha )?(?:expirado|caducado)\b|\bsessão expir|\bsession (?:a|has|est)\b.{0,6}\bexpir|\bsitzung\b.{0,20}\babgelaufen\b|\bsessione scaduta\b",
)
_NOTICE = re.compile("|".join(FILLER + NOTICES), re.IGNORECASE)
_EDGE, _CASED = "\x00", "\x01"  # in stems: a word's edge, and a character whose case counts
_MAX_STRINGS, _MAX_CHOICES = 300, 16


def _weight(strings: list[str]) -> tuple[int, int]:
    """How rarely a text holds one of the strings, by the length of the shortest; digits are rarer than letters."""
    return min(sum(4 if c.isdigit() else c not in (_EDGE, _CASED) for c in x) for x in strings), -len(strings)


def _needed(parsed: Iterable, cased: bool = False) -> tuple[list[str] | None, list[str]]:
    """(all strings that a parsed pattern matches, None if they are too many; strings of which every match holds one)."""
    options: list[list[str]] = []
    run, whole = [""], True
    for kind, arg in parsed:
        part: list[str] | None = None
        need = [""]
        if kind is ops.LITERAL:
            part = [_CASED + chr(arg) if cased else chr(arg).lower()]
        elif kind is ops.AT:
            part = [_EDGE if arg is ops.AT_BOUNDARY else ""]
        elif kind in (ops.ASSERT, ops.ASSERT_NOT):
            part = [""]
        elif kind is ops.IN and arg[0][0] is not ops.NEGATE:
            chars: list[str] = []
            for what, x in arg:
                chars += [chr(x)] if what is ops.LITERAL else map(chr, range(x[0], x[1] + 1)) if what is ops.RANGE else "0123456789" if x is ops.CATEGORY_DIGIT else [""] * (_MAX_CHOICES + 1)
            part = None if len(chars) > _MAX_CHOICES else [_CASED + c if cased else c.lower() for c in chars]
        elif kind is ops.SUBPATTERN:
            part, need = _needed(arg[3], (cased or bool(arg[2] & re.IGNORECASE)) and not arg[1] & re.IGNORECASE)
        elif kind is ops.BRANCH:
            ways = [_needed(x, cased) for x in arg[1]]
            part = None if any(x is None for x, _ in ways) else [x for w, _ in ways for x in w]
            need = [x for _, n in ways for x in n]
        elif kind in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, inner = arg
            all_of, one_of = _needed(inner, cased)
            if all_of is not None and most == 1:
                part = all_of if least else ["", *all_of]
            elif least and all_of is not None and len(run) * len(all_of) <= _MAX_STRINGS:
                need = [x + y * least for x in run for y in all_of]
            elif least:
                need = one_of
        if part is not None and len(run) * len(part) <= _MAX_STRINGS:
            run = [x + y for x in run for y in part]
        else:
            whole = False
            options += [run, need if part is None else part]
            run = [""]
    options.append(run)
    return (list(dict.fromkeys(run)) if whole else None), list(dict.fromkeys(max(options, key=_weight)))


#: Strings of which every match of the patterns above holds one, taken from the patterns themselves: only sentences holding one
#: are looked at closely.
STEMS = tuple(_needed(re._parser.parse(_NOTICE.pattern, re.IGNORECASE))[1])
#: Characters that the patterns take for others (letters of no other case, digits of other scripts): texts with them are looked at in full.
_ODD = "ıſ" + "".join(c for c in map(chr, range(0x80, sys.maxunicode)) if c.isdecimal())
_SYNTAX = re.compile(r"[{}<>$%#\[\]@]|__|\?[a-z]+_|_HERE\b")
#: Bits of text of which a default or blank needs one. Fixed values.
_DEFAULT_BITS = ("null", "undefined", "NaN", "None", "N/A", "TBD", "TBA", "nil", "unknown", " ,", " .", " ;", "()", "( )")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|\n+")
_FILLED = r"\d[\da-f]*|(?<=[\s(“\"'’])[A-ZÀ-ÞΑ-Я][\w’'-]*"
_PLAIN_SLOT = re.compile(_FILLED)
_SLOT = re.compile("|".join(PLACEHOLDERS) + "|" + _FILLED)
#: A token made like a variable's name: word characters with marks of syntax at both ends, at one end twice, or joined by underscores.
_VARIABLE = re.compile(r"(?<!\S)[(\[\"“]?(?:[{}<>\[\]$%#@_&~^|]+\w[\w.:/ -]{0,60}[{}<>\[\]$%#@_&~^|]+|[{}$%#@_~^|]{2,}\w+|[A-Za-z]\w*_\w+)(?=[)\]\"”.,:;!?]*(?:\s|$))")
_ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("reason", pa.string()), ("made_of", pa.list_(pa.int64()))])
_DDL = "kind int, doc_id bigint, a bigint, n bigint, reason string, made_of array<bigint>"


def _stems() -> ahocorasick.Automaton:
    """Each stem's letters in small, with what else must hold: (length, as written or None, edge before, edge after)."""
    by: dict[str, list[tuple[int, str | None, bool, bool]]] = {}
    for s in STEMS:
        written = s.replace(_EDGE, "").replace(_CASED, "")
        word = lambda c: c.isalnum() or c == "_"
        edges = s[0] == _EDGE and word(written[0]), s[-1] == _EDGE and word(written[-1])
        by.setdefault(written.lower(), []).append((len(written), written if s.count(_CASED) == len(written) else None, *edges))
    a = ahocorasick.Automaton()
    for letters, forms in by.items():
        a.add_word(letters, forms)
    for c in _ODD:
        a.add_word(c, None)
    a.make_automaton()
    return a


def _stands(text: str, end: int, form: tuple[int, str | None, bool, bool]) -> bool:
    """Does a stem found up to a position stand there in its case and at its words' edges?"""
    n, written, before, after = form
    start = end - n + 1
    if written is not None and text[start : end + 1] != written:
        return False
    if before and start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        return False
    return not (after and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"))


_automaton = None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def frame(sentence: str) -> str:
    """The sentence with its slots (placeholders, numbers, names after the first word) masked and closing marks dropped."""
    slot = _SLOT if _SYNTAX.search(sentence) else _PLAIN_SLOT
    return slot.sub("\x00", sentence).rstrip(" .!?…:)(\"”’»").lower()


def _may_hold_default(text: str) -> bool:
    return any(bit in text for bit in _DEFAULT_BITS)


def with_defaults_masked(sentence: str) -> str:
    return re.sub(" +", " ", frame(MAYBE_DEFAULT.sub(" \x00", sentence)))


def with_variables_masked(sentence: str) -> str:
    return frame(_VARIABLE.sub("\x00", sentence))


def _notice(text: str) -> bool:
    """Does a sentence that holds one of the stems read like a notice or filler?"""
    global _automaton
    if _automaton is None:
        _automaton = _stems()
    lowered = text.lower()
    found = list(_automaton.iter(lowered))
    if len(lowered) != len(text) or any(forms is None for _, forms in found):  # a letter grew: positions do not carry over
        return any(_NOTICE.search(s.strip()) for s in _SPLIT.split(text))
    hits = [end for end, forms in found if any(_stands(text, end, f) for f in forms)]
    if not hits:
        return False
    start, at = 0, 0
    for m in _SPLIT.finditer(text + "\n"):
        inside = False
        while at < len(hits) and hits[at] < m.end():
            inside = True
            at += 1
        if inside and _NOTICE.search(text[start : m.end()].strip()):
            return True
        if at == len(hits):
            return False
        start = m.end()
    return False


def text_reason(text: str) -> str | None:
    """Why a text is residue by its own words: a variable name in a slot, a sure default, or a notice or filler."""
    if _SYNTAX.search(text) and PLACEHOLDER.search(text):
        return "placeholder"
    if _may_hold_default(text) and any(SURE_DEFAULT.search(s) for s in _SPLIT.split(text)):
        return "default"
    return "notice" if _notice(text) else None


def _evidence(wording: bool):
    """kind 0: frame a in n records; 1: a sentence of doc_id whose frame is a once its defaults (reason default) or its variables
    (placeholder) are masked; 2: doc_id is the page a, made of frames; 3: doc_id is residue by its words, for a reason."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)

    def pages_of(ids: list[int | None], pages: list[int], made_of: list[int], ends: list[int]) -> pa.RecordBatch:
        n = len(ids)
        none = pa.nulls(n, pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made_of, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([2] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(pages, pa.int64()), none, pa.nulls(n, pa.string()), lists], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames: Counter[int] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(0, None, f, n, None, None) for f, n in frames.items()]
            frames.clear()
            return batch_of(rows)

        for batch in batches:
            rows: list[tuple] = []
            ids, pages, made_of, ends = [], [], [], [0]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                if wording and (reason := text_reason(text)):
                    rows.append((3, key, None, None, reason, None))
                page: dict[int, None] = {}
                defaults, syntax = _may_hold_default(text), _SYNTAX.search(text) is not None or "_" in text
                for s in _SPLIT.split(text):
                    if not s or s.isspace():
                        continue
                    if defaults and MAYBE_DEFAULT.search(s):
                        rows.append((1, key, _hash(with_defaults_masked(s)), None, "default", None))
                    if syntax and _VARIABLE.search(s):
                        rows.append((1, key, _hash(with_variables_masked(s)), None, "placeholder", None))
                        page[_hash(with_variables_masked(s) + "\x01")] = None  # not a filled sentence
                    else:
                        page[_hash(frame(s))] = None
                frames.update(page.keys())
                if page:
                    ids.append(key)
                    pages.append(_hash(",".join(map(str, page))))
                    made_of += page
                    ends.append(len(made_of))
                if len(frames) > HELD_FRAMES:
                    yield flush()
            if rows:
                yield batch_of(rows)
            if ids:
                yield pages_of(ids, pages, made_of, ends)
        if frames:
            yield flush()

    return run


def find_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wording: bool = True) -> DataFrame:
    """doc_id, reason for rows where residue stands in place of content: placeholder, default, notice (with filler) or page.

    Alignment: a sentence with a default, a blank or a variable's name is residue if other records fill the same slots of the same
    frame; pages of several records that are made of the same frames, with slots or without, are error templates if those frames
    hardly stand in other texts, and so is any text that holds one of those frames. With ``wording``, further texts are found by
    the syntax of template languages and by the wording of notices and fillers. Contents that several records repeat whole, and
    whose sentences no other text has, cannot be told from an error page.

    One row per doc_id and reason; null and empty texts give none. Rows repeated under one doc_id give one. The frames of all
    sentences of all rows are counted; tasks combine equal frames before the shuffle, so a common frame sends one row a task, and
    a page or frame that very many records have is looked up in several tasks.
    """
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    evidence = cut(body.mapInArrow(_evidence(wording), _DDL))
    n = F.count(F.lit(1)).alias("n")
    direct = evidence.where("kind = 3").select("doc_id", "reason")
    frames = evidence.where("kind = 0").groupBy(F.col("a").alias("frame")).agg(F.sum("n").alias("n_all"))
    weak = evidence.where("kind = 1").select("doc_id", F.col("a").alias("frame"), "reason")
    filled = frames.where(F.col("n_all") >= MIN_FILLED).select("frame")
    hot = hot_keys(weak.groupBy("frame").agg(n), "frame", F.col("n"), ROWS_PER_TASK)
    aligned = salted_lookup(weak, filled, "frame", hot, F.col("doc_id")).select("doc_id", "reason")
    pages = evidence.where("kind = 2").select("doc_id", F.col("a").alias("page"), "made_of")
    repeated = pages.groupBy("page").agg(n, F.min("made_of").alias("made_of")).where(F.col("n") >= MIN_PAGES)
    # one row a page and frame, however many records have the page
    inside = repeated.select("page", "n", F.explode("made_of").alias("frame"))
    share = inside.groupBy("frame").agg(F.sum("n").alias("n_inside")).join(frames, "frame").select("frame", (F.col("n_inside") >= PAGE_SHARE * F.col("n_all")).alias("own"))
    templates = inside.join(share, "frame").groupBy("page").agg(F.min("own").alias("own")).where("own").select("page")  # no sentence that other texts use
    own = inside.join(templates, "page", "left_semi").select("frame").distinct()
    holding = pages.select("doc_id", F.explode("made_of").alias("frame"))
    common = hot_keys(frames.join(own, "frame", "left_semi"), "frame", F.col("n_all"), ROWS_PER_TASK)
    by_page = salted_lookup(holding, own, "frame", common, F.col("doc_id"))
    return direct.unionByName(aligned).unionByName(by_page.select("doc_id", F.lit("page").alias("reason"))).distinct()
