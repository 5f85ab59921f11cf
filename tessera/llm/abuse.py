"""Abusive, hateful and sexually explicit language: a linear-chain conditional random field over the words of a sentence.

Two labels, toxic and not. The sample labels snippets, not words, so the labels of words are latent: a snippet labelled abusive
has at least one toxic word and a clean one none, and the field is fitted to the probability of exactly that, which the forward
recursion gives (one less the weight of the path without a toxic word over the sum of all paths). Marginals of the words give
the spans, the probability that a sentence has a toxic word its score, and the worst sentence the document's.

A word has few features, all with learned weights:

* the evidence of its form (or, where the sample lacks the form, of its first letters): the share of a form's rows in the whole corpus that abuse can explain, ``prior * P(form | abusive
  snippets) / P(form | documents)``, in steps of a logit. Documents are unlabelled, and this is the posterior of learning from
  positive and unlabelled rows; the prior is read off the forms that stand in abusive snippets only;
* whether it is written in disguise (spelled with gaps, digits or signs for letters, or masked), and whether other rows of the
  corpus write the same word in disguise, which people do to words that filters stop;
* whether a general dictionary (parameter ``lexicon``, which may be empty) has it, under which head, unless the sample or the corpus
  speak against the word: one in clean snippets, or in more rows than abuse can explain, is no mark;
* how much evidence and which of these marks the words around it have.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import cut
from tessera.llm.samples import hashed_texts

SEED = 7
EPOCHS, RATE, DECAY = 160, 0.08, 0.00001
#: Chances that, while fitting, the evidence of a word and of a whole snippet is hidden, so that the other marks carry what they
#: can: a kind of abuse that the sample lacks shows nothing else.
HIDE, HIDE_SNIPPET = 0.2, 0.6
#: The logit at which evidence begins to count, the most that the words around may bring, and from where a word is evident.
LOW, MOST, EVIDENT, GATE = 2.0, 5.0, 1.5, 1.6
#: Letters of a beginning, and what its evidence is worth beside that of a form.
STEM, STEM_SHARE = 5, 0.6
#: The share of a word's rows that must write it in disguise for the word itself to be a mark.
HIDDEN_SHARE = 0.2
#: A coarse word says nothing if it is in more rows than so many times what abuse can explain, or if its evidence is below the second.
COMMON, DOUBTED = 2.0, 0.7
#: A document whose worst sentence reaches this counts as abusive; kinds of abuse that the sample lacks score little.
THRESHOLD = 0.15
#: Bounds on what is fitted: labelled snippets, unlabelled documents taken as clean (and characters of each). The last: how many words
#: written in disguise, the most frequent, every task holds; each document brings those of the others that it has.
MAX_SAMPLE, BACKGROUND_ROWS, BACKGROUND_CHARS, MAX_DISGUISED = 20_000, 1_000, 2_000, 20_000
#: Words on either side that count as around.
REACH = 8
NEVER = -30.0
#: Bits of the filter that says which words may be among the others.
FILTER_BITS = 1 << 24
CHUNK_WORDS = 120_000
HELD_WORDS = 400_000

#: Coarse words, and words that turn on persons, by head in the six languages, accents dropped; "-" after a beginning: any ending.
#: Vocabulary written by hand: fixed values.
LEXICON = {
    "insult": "idiot- imbecil- moron- cretin- stupid- retard- bastard- asshole- bitch- whore- slut- cunt- dickhead- wanker- scum- loser- pathetic worthless disgusting filthy shit- estupid- gilipoll- puta puto mierda- zorra- connard- salop- pute merde- encul- abruti- arschl- wichser- schlamp- scheiss- vadia- merda- stronz- coglion- troia- puttan-",
    "beast": "vermin- verme- parasit- rat rats ratas ratten ratti ape apes monkeys breed breeds subhuman- filth- ungeziefer abschaum escoria racaille inferior- disease-",
    "violence": "kill- murder- smash- beat break- burn- stab- shoot- drown- skull- blood- bones mueras muere morra morrer romper- crever- creve- casser frapper- toten umbringen verreck- brechen knochen quebrar- ammazz- crepa- spacca- uccid- brul-",
    "sexual": "fuck- tits nipple- dick- pussy porn- horny orgy- orgas- moan- naked strip- lick- thrust- thigh- folla- polla tetas desnud- gemi- geme- baise- deshabill- fick- titten schwanz nackt- stohn- fode- scopa- cazzo- tette spogli-",
    "address": "you your te tu ti vosotros os toi tes vous votre du dich dir dein- euch ihr voce voces seu sua teu voi tuo",
    "wish": "should must deserve- wish let ojala habria deberia- faudrait devraient qu'on sollte- gehoren soll tomara devia- deve- dovrebbe- vanno devi",
    "group": "women immigrants foreigners muslims jews gays blacks refugees people mujeres inmigrantes judios femmes etrangers juifs arabes frauen auslander juden mulheres imigrantes estrangeiros donne stranieri ebrei",
}
HEADS = tuple(LEXICON)
MARKS = ("disguised", "hidden elsewhere", "evident", "shouted", *HEADS)
_BIT = {name: 1 << k for k, name in enumerate(MARKS)}
_SIGNS = str.maketrans("013457@$", "oieastas")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$'’-]*[\w*@$])?|(?<![*@$])[*@$]++\w+")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|\n+")
_SPACED = re.compile(r"(?<![\w.])(?:[^\W\d_][ .·_-]){3,}[^\W\d_](?![\w])")
_ODD = re.compile(r"[*@$]|[^\W\d_]\d|\d[^\W\d_]|(?<![^\W_])[^\W_][ .·_-][^\W_][ .·_-][^\W_](?![^\W_])")
_SIGNED = re.compile(r"[@$]|[^\W\d_]\d|\d[^\W\d_]")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64())))])
_DDL = "doc_id bigint, score double, sentences bigint, spans array<array<bigint>>"
_COUNTED = re.compile(r"\W*\d+\w{0,3}|\$\d.*|([@$]+)\w+\1")


def tokens(sentence: str) -> list[tuple[str, int, int]]:
    """(word, start, end); letters spelled with gaps between them are one word, marked."""
    out: list[tuple[str, int, int]] = []
    gaps = [(m.start(), m.end()) for m in _SPACED.finditer(sentence)] if _ODD.search(sentence) else []
    at = 0
    for a, b in [*gaps, (len(sentence), len(sentence))]:
        out += [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(sentence, at, a)]
        if b > a:
            out.append(("\x01" + re.sub(r"[ .·_-]", "", sentence[a:b]), a, b))
        at = b
    return out


def folded(word: str) -> str:
    word = word.lower()
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def plain(raw: str) -> tuple[str, str]:
    """(form without accents, capitals and signs for letters; how it is disguised: gaps, signs, mask or '')."""
    if raw[0] == "\x01":
        return folded(raw[1:].translate(_SIGNS)), "gaps"
    if "*" in raw.strip("*"):
        return raw.lower(), "mask"
    if _SIGNED.search(raw) and not _COUNTED.fullmatch(raw) and any(c.isalpha() for c in raw):
        return folded(raw.translate(_SIGNS)), "signs"
    return folded(raw), ""


def with_stems(forms: set[str]) -> set[str]:
    return forms | {"^" + f[:STEM] for f in forms if len(f) > STEM}


def named(raw: str) -> bool:
    return raw[0].isupper() and not raw.isupper() and len(raw) > 1


class Evidence:
    """What is known of forms: how many abusive and clean snippets and how many documents have each, and which are disguised elsewhere."""

    def __init__(self, snippets: list[tuple[list[set[str]], int]], documents: dict[str, int], n_documents: int, disguised: set[str], lexicon: dict[str, str]) -> None:
        self.abusive: Counter[str] = Counter()
        self.clean: Counter[str] = Counter()
        for forms, label in snippets:
            (self.abusive if label else self.clean).update(forms)
        self.n_abusive = max(1, sum(label for _, label in snippets))
        self.documents, self.n_documents, self.disguised = documents, max(1, n_documents), disguised
        self.prior = self._prior()
        self.words: dict[str, int] = {}
        self.beginnings: dict[str, int] = {}
        for head, listed in lexicon.items():
            for w in listed.split():
                if self.telling(w.rstrip("-")):
                    (self.beginnings if w.endswith("-") else self.words)[w.rstrip("-")] = _BIT[head]

    def _prior(self) -> float:
        """The share of documents that abuse of the sampled kinds can explain: forms that only abusive snippets have are hardly anywhere else."""
        pure = sorted((self.documents.get(w, 0) + 1) / self.n_documents / (n / self.n_abusive) for w, n in self.abusive.items() if n >= 3 and not self.clean[w])
        return pure[len(pure) // 2] if pure else 0.02

    def telling(self, form: str) -> bool:
        """May a listed word be a mark? Not if more rows have it than abuse can explain, or the sample has it in clean snippets: the corpus overrules the list."""
        if self.documents.get(form, 0) > COMMON * self.prior * self.n_documents or (self.clean[form] and not self.abusive[form]):
            return False
        return not (self.abusive[form] > 1 and self.value(form) < DOUBTED)

    def value(self, form: str, less: int = 0) -> float:
        """0 without evidence, 1 where a row with the form is as likely abusive as one in three, up to 3; ``less`` takes out the snippet looked at."""
        a = self.abusive[form] - less
        if a <= 0:
            return 0.0
        other = max(self.documents.get(form, 0) / self.n_documents, self.clean[form] * self.prior / self.n_abusive)
        r = min(0.98, self.prior * (a + 0.5) / self.n_abusive / (other + 1 / self.n_documents))
        return float(np.clip((np.log(r / (1 - r)) + LOW) / 2, 0, 3))

    def marks(self, raw: str, form: str, how: str) -> int:
        if how == "signs" and not (form in self.disguised or form in self.abusive):
            how = ""
        mask = self.words.get(form, 0)
        for n in range(3, len(form) + 1):
            mask |= self.beginnings.get(form[:n], 0)
        if mask and not self.telling(form):
            mask = 0
        mask |= _BIT["disguised"] if how else _BIT["hidden elsewhere"] if form in self.disguised else 0
        if raw.isupper() and len(raw) > 2 and raw[0] != "\x01":
            mask |= _BIT["shouted"]
        return mask


def words_of(raws: list[str], evidence: Evidence, own: set[str] | None = None) -> list[tuple[list[str], int, float]]:
    """(names of the word's own features, bits, evidence); ``own``: forms of the abusive snippet the words come from, taken out of the evidence."""
    out = []
    for raw in raws:
        form, how = plain(raw)
        value = evidence.value(form, int(own is not None and form in own) + named(raw))  # a name of one snippet says nothing
        mask = evidence.marks(raw, form, how)
        if form.isdigit():
            out.append((["number"], 0, 0.0))
        elif named(raw) and not value and form not in evidence.disguised:  # nobody disguises a name; German writes all nouns like names
            out.append((["name"], mask & _BIT["disguised"], 0.0))
        else:
            if not value and len(form) > STEM:
                value = STEM_SHARE * evidence.value("^" + form[:STEM], int(own is not None and "^" + form[:STEM] in own))
            if value >= EVIDENT:
                mask |= _BIT["evident"]
            out.append(([f"how {how}"] if mask & _BIT["disguised"] else ["word"], mask, value))
    return out


def own_names(names: list[str], mask: int) -> list[str]:
    return names + [f"own {h}" for h in MARKS if mask & _BIT[h]]


def around_names(mask: int, others: int) -> list[str]:
    near = [h for h in MARKS if others & _BIT[h]]
    return [f"near {h}" for h in near] + [f"{a} near {b}" for a in MARKS if mask & _BIT[a] for b in near]


def window_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The evidence of the words within REACH in the same sentence, without the word's own, at most MOST."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = ends - np.repeat(lengths, lengths)
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(len(values))
    return np.minimum(MOST, total[np.minimum(at + REACH + 1, ends)] - total[np.maximum(at - REACH, starts)] - values)


def scores_of(marks: np.ndarray, values: np.ndarray, weights: np.ndarray, lengths: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The words' scores from those of their marks and their evidence. A word without a mark or more than GATE of evidence in reach is not toxic."""
    near = window_sums(values, lengths)
    return np.where(marked | (values + near > GATE), marks + weights[0] * values + weights[1] * near, NEVER)


def around(masks: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The bits of the words within REACH in the same sentence, without the word's own."""
    out = np.zeros(len(masks), np.int64)
    at = np.flatnonzero(masks)
    for d in [*range(-REACH, 0), *range(1, REACH + 1)]:
        to = at + d
        ok = (to >= 0) & (to < len(masks))
        a, b = at[ok], to[ok]
        same = sentence[a] == sentence[b]
        out[b[same]] |= masks[a[same]]  # targets of one distance differ from each other
    return out


def recursion(scores: np.ndarray, lengths: np.ndarray, turn: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of every word, log of (sum of all paths / the path without a toxic word) of every sentence).

    Sentences stand one after another in ``scores``; forward-backward in odds, many sentences of like length at a time.
    """
    out, logs = np.empty(len(scores)), np.zeros(len(lengths))
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    t = np.exp(turn)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        group = order[at : at + max(64, 200_000 // max(1, int(lengths[order[at]])))]
        longest = int(lengths[group[-1]])
        if longest > 2 * lengths[group[0]] + 8:  # keep sentences of a group alike in length
            group = group[: int(np.searchsorted(lengths[group], 2 * lengths[group[0]] + 8, side="right"))]
            longest = int(lengths[group[-1]])
        at += len(group)
        n, where = lengths[group], firsts[group]
        e = np.zeros((longest, len(group)))
        inside = np.arange(longest)[:, None] < n[None]
        index = where[None] + np.arange(longest)[:, None]
        e[inside] = scores[index[inside]]
        e = np.exp(np.clip(e, -30, 30))
        f = np.empty_like(e)
        f[0] = e[0] * np.exp(start)
        total = np.zeros(len(group))
        for k in range(1, longest):
            stay = t[0, 0] + f[k - 1] * t[1, 0]
            f[k] = e[k] * (t[0, 1] + f[k - 1] * t[1, 1]) / stay
            total += np.where(inside[k], np.log(stay) - turn[0, 0], 0)
        logs[group] = total + np.log1p(f[n - 1, np.arange(len(group))])
        b = np.ones(len(group))
        for k in range(longest - 1, -1, -1):
            odds = f[k] * b
            here = inside[k]
            out[index[k][here]] = (odds / (1 + odds))[here]
            if k:
                x = e[k] * b
                before = (t[1, 0] + x * t[1, 1]) / (t[0, 0] + x * t[0, 1])
                b = np.where(here, before, b)
    return out, logs


class Field:
    """A fitted field: weights by the name of a feature, what turning from label to label costs, and the evidence."""

    def __init__(self, weights: dict[str, float], turn: np.ndarray, start: float, evidence: Evidence) -> None:
        self.weights, self.turn, self.start, self.evidence = weights, turn, start, evidence
        self.evidence_weights = np.array([weights["evidence"], weights["evidence around"]])

    def total(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)


def fit(snippets: list[tuple[str, int]], background: list[str], documents: dict[str, int], n_documents: int, disguised: set[str], lexicon: dict[str, str] = LEXICON) -> Field:
    """From snippets labelled 1 (abusive) or 0, unlabelled texts taken as clean, and what the corpus says of forms."""
    rng = np.random.default_rng(SEED)
    bags: list[tuple[int, list[list[str]]]] = []  # label, sentences
    for text, label in [*snippets, *((t, 0) for t in background)]:
        cut = [[w for w, _, _ in tokens(s)] for s in _SPLIT.split(text)]
        bags.append((label, [s for s in cut if s]))
    forms = [(with_stems({plain(w)[0] for s in sentences for w in s}), label) for label, sentences in bags[: len(snippets)]]
    evidence = Evidence(forms, documents, n_documents, disguised, lexicon)
    number: dict[str, int] = {}
    get = lambda names: [number.setdefault(n, len(number)) for n in names]
    lengths, bag_of, rows, cols, values, marked = [], [], [], [], [], []
    row = 0
    for k, (label, sentences) in enumerate(bags):
        own = forms[k][0] if label else None
        for s in sentences:
            words = words_of(s, evidence, own)
            masks = np.array([x[1] for x in words])
            near = around(masks, np.zeros(len(masks), np.int64))
            v = np.array([x[2] for x in words])
            if not (((masks | near) & ~_BIT["shouted"]).any() or (v + window_sums(v, np.array([len(v)])) > GATE).any()):
                continue  # no word of it can be toxic, whatever the weights
            marked += ((masks | near) & ~_BIT["shouted"] > 0).tolist()
            for (names, mask, value), other in zip(words, near.tolist(), strict=True):
                ids = get(own_names(names, mask) + around_names(mask, other) + ["bias"])
                rows += [row] * len(ids)
                cols += ids
                values.append(value)
                row += 1
            lengths.append(len(s))
            bag_of.append(k)
    seen = get(["evidence", "evidence around"])
    n, m, marked = row, len(number), np.array(marked, bool)
    rows, cols, values, lengths, bag_of = np.array(rows, np.int64), np.array(cols, np.int64), np.array(values), np.array(lengths), np.array(bag_of)
    labels = np.array([b[0] for b in bags])
    weight = np.where(labels > 0, max(1.0, (len(snippets) - labels.sum()) / max(1, labels.sum())), 1.0)
    base = weight
    w = np.zeros(m)
    w[number["bias"]] = -3.0
    turn, start = np.array([[0.0, -1.0], [-1.0, 0.5]]), 0.0
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inner = np.ones(n, bool)
    inner[first] = False
    pairs = np.flatnonzero(inner)
    sentence_of = np.repeat(np.arange(len(lengths)), lengths)
    g2, gt2, gs2 = np.full(m, 1e-8), np.full((2, 2), 1e-8), 1e-8
    free = np.ones(m)
    free[number["bias"]] = 0
    unlabelled = np.arange(len(bags)) >= len(snippets)
    for epoch in range(EPOCHS):
        if epoch in (EPOCHS // 3, 2 * EPOCHS // 3):  # unlabelled texts that look abusive by now are no clean examples
            e = scores_of(np.bincount(rows, w[cols], n), values, w[seen], lengths, marked)
            toxic = -np.expm1(-np.bincount(bag_of, recursion(e, lengths, turn, start)[1], len(bags)))
            doubtful = np.argsort(-np.where(unlabelled, toxic, -1.0), kind="stable")[: round(evidence.prior * unlabelled.sum())]
            weight = base.copy()
            weight[doubtful] = 0.0
        v = np.where(((rng.random(len(bags)) < HIDE_SNIPPET)[bag_of][sentence_of]) | (rng.random(n) < HIDE), 0.0, values)
        around_v = window_sums(v, lengths)
        e = scores_of(np.bincount(rows, w[cols], n), v, w[seen], lengths, marked)
        p, logs = recursion(e, lengths, turn, start)
        by_bag = np.bincount(bag_of, logs, len(bags))
        # clean: each toxic path costs; abusive: the path without a toxic word costs
        pull = np.where(labels > 0, -1.0 / np.maximum(np.expm1(np.minimum(by_bag, 50)), 1e-6), 1.0) * weight
        c = pull[bag_of][sentence_of] / len(bags)
        grad = np.bincount(cols, (p * c)[rows], m) + DECAY * w * free
        grad[seen] += np.dot(p * c, v), np.dot(p * c, around_v)
        g2 = 0.97 * g2 + 0.03 * grad**2
        w -= RATE * grad / (np.sqrt(g2) + 1e-6)
        a, b = p[pairs - 1], p[pairs]
        both = _joint(a, b, np.exp(turn[0, 0] + turn[1, 1] - turn[0, 1] - turn[1, 0]))
        cp = c[pairs]
        gt = np.array([[0.0, np.sum((b - both) * cp)], [np.sum((a - both) * cp), np.sum(both * cp)]]) + 1e-3 * turn
        gt2 = 0.97 * gt2 + 0.03 * gt**2
        turn = np.clip(turn - 0.3 * RATE * gt / (np.sqrt(gt2) + 1e-6), -3, 3)
        turn[0, 0] = 0.0
    return Field({k: float(w[i]) for k, i in number.items()}, turn, start, evidence)


def _joint(a: np.ndarray, b: np.ndarray, k: float) -> np.ndarray:
    """P(both) from two marginals and their odds ratio k."""
    if abs(k - 1) < 1e-9:
        return a * b
    s = 1 + (a + b) * (k - 1)
    return (s - np.sqrt(np.maximum(0.0, s * s - 4 * k * (k - 1) * a * b))) / (2 * (k - 1))


class Either:
    """Whether one of two sets has a word."""

    def __init__(self, a: set[str], b: set[str]) -> None:
        self.a, self.b = a, b

    def __contains__(self, word: str) -> bool:
        return word in self.a or word in self.b


class Tagger:
    """Applies a field to many sentences at a time; words seen before are looked up."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.brought: set[str] = set()  # words written in disguise elsewhere that the field does not hold and the texts bring
        self.evidence = copy(field.evidence)
        self.evidence.disguised = Either(field.evidence.disguised, self.brought)
        self.pairs: dict[tuple[int, int], float] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.empty((1024, 2))
        self.masks = np.empty(1024, np.int64)

    def add(self, raw: str) -> int:
        self.number[raw] = k = len(self.number)
        if k == len(self.masks):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
            self.masks = np.concatenate((self.masks, np.empty_like(self.masks)))
        self.masks[k], *self.table[k] = max((self.reading(x) for x in {raw, self.undisguised(raw)}), key=lambda x: x[1] + self.field.evidence_weights[0] * x[2])
        return k

    def reading(self, raw: str) -> tuple[int, float, float]:
        ((names, mask, value),) = words_of([raw], self.evidence)
        return mask, self.field.total([*own_names(names, mask), "bias"]), value

    def undisguised(self, raw: str) -> str:
        """The word in plain letters where the corpus writes it both ways: a disguise makes no word milder. Others as they are."""
        form, how = plain(raw)
        return form if how and form in self.evidence.disguised else raw

    def score(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(P(a toxic word) of each sentence, P(toxic) of all words)."""
        number, add = self.number, self.add
        ids: list[int] = []
        for words in sentences:
            found = list(map(number.get, words))
            if None in found:
                found = [number[x] if x in number else add(x) for x in words]
            ids += found
        lengths = np.array([len(s) for s in sentences])
        k = np.array(ids)
        e = self.table[k, 0]
        masks = self.masks[k]
        near = around(masks, np.repeat(np.arange(len(lengths)), lengths))
        at = np.flatnonzero(near)
        if len(at):
            both, which = np.unique(masks[at] << len(MARKS) | near[at], return_inverse=True)
            for x in both.tolist():
                if x not in self.pairs:
                    self.pairs[x] = self.field.total(around_names(x >> len(MARKS), x & (1 << len(MARKS)) - 1))
            e[at] += np.array([self.pairs[x] for x in both.tolist()])[which]
        e = scores_of(e, self.table[k, 1], self.field.evidence_weights, lengths, (masks | near) & ~_BIT["shouted"] > 0)
        p, logs = recursion(e, lengths, self.field.turn, self.field.start)
        return -np.expm1(-logs), p


def sentences_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of the sentences."""
    out, start = [], 0
    for m in _SPLIT.finditer(text):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    return out


def _forms(wanted: set[str]):
    """Counts the rows of every form, plain and disguised: (form, rows, rows in disguise, whether it is wanted); '' counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, str, bool]] = {}
        whole: Counter[str] = Counter()
        masked: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            names = list(whole | masked)
            rows = [pa.array(names), pa.array([whole[x] for x in names], pa.int64()), pa.array([masked[x] for x in names], pa.int64()), pa.array([x in wanted for x in names])]
            whole.clear()
            masked.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(rows, names=["form", "n", "d", "wanted"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                whole[""] += 1
                raws = {w for w, _, _ in tokens(text)} if _ODD.search(text) else set(_TOKEN.findall(text))
                here: set[str] = set()
                hidden: set[str] = set()
                for raw in raws:
                    known = seen.get(raw)
                    if known is None:
                        form, how = plain(raw)
                        stem = "^" + form[:STEM] if len(form) > STEM else ""
                        known = seen[raw] = form, how, stem if stem in wanted else ""
                    form, how, stem = known
                    if how == "":
                        here.add(form)
                        here.add(stem)
                    elif how != "mask":
                        hidden.add(form)
                here.discard("")
                hidden.discard("")
                whole.update(here)
                masked.update(hidden)
            if len(whole) + len(seen) > HELD_WORDS:
                yield flush()
        if whole or masked:
            yield flush()

    return run


def counted_forms(docs: DataFrame, text: str, wanted: set[str]) -> tuple[dict[str, int], int, DataFrame]:
    """(rows of each wanted form, rows with text, form and d of the words that other rows write in disguise).

    All rows are counted, combined in each task before the shuffle. Collected are the wanted forms only, as many as the sample has.
    """
    asked = docs.sparkSession.sparkContext.broadcast(wanted)
    counted = docs.select(F.col(text).alias("body")).mapInArrow(lambda b: _forms(asked.value)(b), "form string, n bigint, d bigint, wanted boolean")
    total = cut(counted.groupBy("form").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("wanted").alias("wanted")).where((F.col("form") == "") | F.col("wanted") | ((F.col("d") > 0) & (F.col("n") > 0))))
    rows = {r["form"]: r["n"] for r in total.where((F.col("form") == "") | F.col("wanted")).collect()}
    hidden = total.where((F.col("n") > 0) & (F.col("d") >= HIDDEN_SHARE * (F.col("n") + F.col("d"))) & (F.length("form") > 2))
    return rows, rows.pop("", 0), hidden.select("form", "d")


def most_hidden(hidden: DataFrame) -> tuple[set[str], DataFrame | None]:
    """The MAX_DISGUISED words that most rows disguise, and a table of all the others, None if there are none."""
    first = hidden.orderBy(F.desc("d"), "form").limit(MAX_DISGUISED + 1).collect()
    if len(first) <= MAX_DISGUISED:
        return {r["form"] for r in first}, None
    after = first.pop()
    rest = (F.col("d") < after["d"]) | ((F.col("d") == after["d"]) & (F.col("form") >= after["form"]))
    return {r["form"] for r in first}, hidden.where(rest).select("form")


def corpus_forms(docs: DataFrame, text: str, wanted: set[str]) -> tuple[dict[str, int], int, set[str]]:
    """(rows of each wanted form, rows with text, the words that most other rows write in disguise: see most_hidden)."""
    rows, n, hidden = counted_forms(docs, text, wanted)
    return rows, n, most_hidden(hidden)[0]


def with_hidden(body: DataFrame, rest: DataFrame) -> DataFrame:
    """``body`` (doc_id, body) with the words of each text that are in ``rest`` (form), which may be of any size.

    A filter of FILTER_BITS bits lets through little more than the pairs of a text and such a word; a join decides. A word of ``rest`` is
    in few rows: at most 1 / HIDDEN_SHARE times those that disguise it.
    """
    bit = F.pmod(F.xxhash64("form"), F.lit(FILTER_BITS))
    filled = rest.select(bit.alias("b")).groupBy(F.shiftright("b", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(b & 7 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    shared = body.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        for batch in batches:
            keys, forms = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raws = {w for w, _, _ in tokens(text)} if _ODD.search(text) else set(_TOKEN.findall(text))
                for form in {plain(raw)[0] for raw in raws}:
                    b = xxhash.xxh64_intdigest(form, seed=42) % FILTER_BITS  # as xxhash64 has it
                    if kept[b >> 3] >> (b & 7) & 1:
                        keys.append(key)
                        forms.append(form)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(forms, pa.string())], names=["same", "form"])

    keyed = body.where(F.length("body") > 0).withColumn("same", F.xxhash64("body"))  # equal texts have equal words
    met = keyed.select("same", "body").mapInArrow(run, "same bigint, form string").join(rest, "form").groupBy("same").agg(F.collect_set("form").alias("hidden"))
    return keyed.join(met, "same", "left").select("doc_id", "body", "hidden")


def fitted_with_rest(docs: DataFrame, samples: DataFrame, clean: DataFrame | None, doc_id: str, text: str, lexicon: dict[str, str]) -> tuple[Field, DataFrame | None]:
    """The field, and the words written in disguise that it does not hold (see most_hidden)."""
    known = [(r[0], int(r[1])) for r in samples.where("text is not null and abusive is not null").select("text", "abusive").orderBy("abusive", "text").limit(MAX_SAMPLE).collect()]
    if clean is not None:
        known += [(r[0], 0) for r in clean.where("text is not null").select("text").orderBy("text").limit(MAX_SAMPLE).collect()]
    wanted = with_stems({plain(w)[0] for t, _ in known for w, _, _ in tokens(t)})
    rows, n, hidden = counted_forms(docs, text, wanted)
    background = hashed_texts(docs, doc_id, text, BACKGROUND_ROWS, n, BACKGROUND_CHARS)
    disguised, rest = most_hidden(hidden)
    if rest is not None:  # those of the texts it is fitted to
        met = sorted({plain(w)[0] for t in [*(t for t, _ in known), *background] for w, _, _ in tokens(t)})
        disguised |= {r["form"] for r in rest.join(docs.sparkSession.createDataFrame([(x,) for x in met], "form string"), "form", "left_semi").collect()}
    return fit(known, background, rows, n, disguised, lexicon), rest


def fitted(docs: DataFrame, samples: DataFrame, clean: DataFrame | None, doc_id: str, text: str, lexicon: dict[str, str] = LEXICON) -> Field:
    """A field fitted to the labelled snippets and to what all documents say of their words."""
    return fitted_with_rest(docs, samples, clean, doc_id, text, lexicon)[0]


def tag(docs: DataFrame, samples: DataFrame, clean: DataFrame | None = None, doc_id: str = "doc_id", text: str = "rich_text", threshold: float = THRESHOLD, lexicon: dict[str, str] = LEXICON) -> DataFrame:
    """doc_id, score, sentences, spans for every document with words: the worst sentence's score, how many sentences reach the
    threshold, and the [start, end) characters of the toxic words' stretches in those.

    Null texts, and texts without words, give no rows. Rows repeated under one doc_id are scored one by one. ``samples`` has
    text and abusive (0 or 1); rows with a null in either are left out, and at most MAX_SAMPLE are used. ``clean`` may give
    further snippets (text) that are known to be clean, as many again. ``lexicon`` gives words by head (see LEXICON; {} for none). The
    field is fitted when this is called.
    """
    field, rest = fitted_with_rest(docs, samples, clean, doc_id, text, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        pending: list[tuple[int, str, int]] = []  # doc_id, text, sentences held
        held: list[list[str]] = []
        bounds: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            scores, p = tagger.score(held)
            rows, at = [], 0
            ends = np.cumsum([len(s) for s in held])
            for key, body, n in pending:
                mine = scores[at : at + n]
                hits = np.flatnonzero(mine >= threshold)
                spans: list[list[int]] = []
                for h in hits.tolist():
                    a, b = bounds[at + h]
                    base = int(ends[at + h]) - len(held[at + h])
                    own = p[base : base + len(held[at + h])]
                    least = min(threshold, float(own.max()))  # the likeliest word at least
                    run_of: list[int] = []
                    for i, (_, s, e) in enumerate(tokens(body[a:b])):
                        if own[i] >= least:
                            run_of = [run_of[0] if run_of else a + s, a + e]
                        elif run_of:
                            spans.append(run_of)
                            run_of = []
                    if run_of:
                        spans.append(run_of)
                rows.append({"doc_id": key, "score": round(float(mine.max()), 6), "sentences": len(hits), "spans": spans})
                at += n
            pending.clear()
            held.clear()
            bounds.clear()
            if len(tagger.number) > HELD_WORDS:
                tagger.reset()
                tagger.brought.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

        for batch in batches:
            for key, body, hidden in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not body:
                    continue
                tagger.brought.update(hidden or ())
                odd = _ODD.search(body) is not None
                n = 0
                for a, b in sentences_of(body):
                    part = body[a:b]
                    words = [w for w, _, _ in tokens(part)] if odd else _TOKEN.findall(part)
                    if words:
                        held.append(words)
                        bounds.append((a, b))
                        size += len(words)
                        n += 1
                if n:
                    pending.append((key, body, n))
                if size >= CHUNK_WORDS:
                    yield flush()
                    size = 0
        if pending:
            yield flush()

    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    none = F.lit(None).cast("array<string>")
    return (body.withColumn("hidden", none) if rest is None else with_hidden(body, rest)).mapInArrow(run, _DDL)


def rates(docs: DataFrame, tagged: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """source, n_rows, n_abusive, share; the null source is a group of its own. Partial aggregation: a large source is no bottleneck."""
    hit = tagged.where(F.col("score") >= threshold).select("doc_id").distinct().withColumn("hit", F.lit(1))
    joined = docs.select("doc_id", source).join(hit, "doc_id", "left")
    return joined.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_abusive")).withColumn("share", F.round(F.col("n_abusive") / F.col("n_rows"), 6))
