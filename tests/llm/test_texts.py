"""Leaks, encodings, languages, residue, truncation and abuse: edge cases, brute force and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import abuse, encoding, language, leaks, residue, samples, truncation

DOC = "doc_id bigint, text string, rich_text string, lang string, source string, score double"


def docs(spark, *texts, **more):
    return spark.createDataFrame([(i, t, t, "en", "s", 0.0) for i, t in enumerate(texts)], DOC)


WORDS = st.lists(st.sampled_from("abcd"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), WORDS, st.integers(1, 4))
def test_automaton_equals_brute_force(items, sequence, least):
    a = leaks.Automaton([(k, " ".join(w)) for k, w in enumerate(items)], least)

    def longest(w):
        best = 0
        for i in range(len(sequence)):
            for j in range(len(w)):
                n = 0
                while i + n < len(sequence) and j + n < len(w) and sequence[i + n] == w[j + n]:
                    n += 1
                best = max(best, n)
        return best

    want = {k: n for k, w in enumerate(items) if (n := longest(w)) >= least}
    assert {k: v[0] for k, v in a.leaked(sequence, least).items()} == want
    covered = set()
    for w in items:
        for i in range(len(sequence) - least + 1):
            if any(sequence[i : i + least] == w[j : j + least] for j in range(len(w) - least + 1)):
                covered |= set(range(i, i + least))
    assert {p for x, y in a.spans(sequence, least) for p in range(x, y + 1)} == covered


def test_leaks_through_case_marks_and_spaces_and_in_blocks(spark):
    passage = "The old mill, in its tenth year, burned twice before the naïve clerk came home"
    items = spark.createDataFrame([(1, passage), (2, passage + " again"), (3, "too short to count"), (4, None)], "item_id bigint, text string")
    d = docs(spark, f"Intro. {passage.upper()}!", "the old mill in its tenth\nyear burned twice before", "the old mill in its tenth year burned", None, "")
    for words_in_block in (100_000, 3):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, items, block_words=words_in_block).collect()}
        assert got == {(0, 1), (0, 2), (1, 1), (1, 2)}
    cleaned = {r["doc_id"]: (r["text"], r["removed"]) for r in leaks.without_leaks(d, items).collect()}
    assert cleaned[0] == ("Intro. ", 15) and cleaned[1] == ("", 10) and cleaned[2][1] == 0 and cleaned[3] == (None, 0)
    assert leaks.leaks(d, items.limit(0)).count() == 0 and leaks.leaks(d.limit(0), items).count() == 0


def test_blocks_of_items_are_cut_from_the_original_text(spark):
    w = [f"word{chr(97 + k)}" for k in range(20)]
    items = spark.createDataFrame([(1, " ".join(w[:12])), (2, " ".join(w[6:18])), (3, " ".join(w[2:14]))], "item_id bigint, text string")
    d = docs(spark, "Intro. " + " ".join(w) + " End.", "nothing here", None)
    for words_in_block in (100_000, 24, 3):
        got = {r["doc_id"]: (r["text"], r["removed"]) for r in leaks.without_leaks(d, items, block_words=words_in_block).collect()}
        assert got == {0: ("Intro. words wordt End.", 18), 1: ("nothing here", 0), 2: (None, 0)}


SNIPPETS = [
    ("es", "La segunda mitad se hace larga, aunque la música la salva. Salí del cine sin saber qué pensar. No esperaba que el año fuera así."),
    ("fr", "La seconde moitié traîne un peu, pourtant la musique la sauve. Je suis sorti de la salle sans savoir quoi en penser. C’est très beau à voir."),
    ("de", "Die zweite Hälfte zieht sich, doch die Musik rettet sie. Ich ging aus dem Kino und wusste nicht, was ich denken sollte. Das ist schön für alle."),
    ("pt", "A segunda metade é longa, porém a música salva tudo. Saí da sessão sem saber o que pensar. Não é para todos, mas é impressionante."),
    ("it", "La seconda metà è lunga, però la musica la salva. Sono uscito dalla sala senza sapere che cosa pensare. Non è per tutti, perché è triste."),
    ("en", "The second half drags a little, yet the music keeps it alive. I left the hall and did not know what to think. It is not for everyone."),
]


@pytest.fixture(scope="module")
def describer():
    return encoding.Describer(encoding.train_dictionaries(SNIPPETS), encoding.alphabet_of(SNIPPETS))


def garbled(text, wrong, right="utf-8"):
    page, chars = encoding.code_page(wrong)
    return "".join(chr(b) if b < 0x80 else chars[b - 0x80] for b in text.encode(right))


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437"])
def test_garbled_text_round_trip(describer, wrong):
    clean = "El año pasado salí del cine sin saber qué pensar, y también está bien. Así fue la última canción."
    assert encoding.restore(garbled(clean, wrong), describer)[0] == clean
    twice = garbled(garbled(clean, "cp1252"), "cp1252")
    assert encoding.restore(twice, describer)[0] == clean


def test_letters_taken_for_others(describer):
    assert encoding.restore("tambйm й bom, mas nгo tкm razгo", describer)[0] == "também é bom, mas não têm razão"


def test_fast_look_covers_letters_at_word_ends(describer):
    for right, wrong in (("un café", "mac_roman"), ("um café", "cp850"), ("é assim", "cp1251"), ("más", "mac_roman")):
        text = garbled(right, wrong, "latin_1")
        if any(encoding.places(text, s) for s in encoding.STEPS):
            assert encoding.any_suspect().search(text), text
    for text in ("cafÈ", "cafÚ", "un cafÈ.", "cafÈ, cafÚ", "“й”", "й!", "cafŸ"):
        assert any(encoding.places(text, s) for s in encoding.STEPS) and encoding.any_suspect().search(text), text
    assert encoding.restore("El sábado está bien en el cafÈ", describer)[0] == "El sábado está bien en el café"


@pytest.mark.parametrize("text", ["«Тихий берег» steht da, ganz schön.", "CORAÇÃO, NÃO É ASSIM", "L’ÂGE D’OR devant l’église à l’école", "38° and £9, a 2½-hour film, 4×3 ©", "What?Really?That was it?", "plain", ""])
def test_genuine_text_stays(describer, text):
    assert encoding.restore(text, describer)[:2] == (text, [])
    assert encoding.lost_characters(text, describer) == 0


def test_lost_characters(spark, describer):
    assert encoding.lost_characters("despu�s de a�os", describer) == 2
    assert encoding.lost_characters("una br?jula rota que can?a", describer) == 2
    snippets = spark.createDataFrame(SNIPPETS, "lang string, text string")
    d = docs(spark, "también está bien", garbled("también está bien y así será", "cp1252"), None, "", "niño perd�")
    got = {r["doc_id"]: (r["restored"], r["lost"]) for r in encoding.repair(d, snippets).collect()}
    assert got == {1: ("también está bien y así será", 0), 4: ("niño perd�", 1)}
    assert encoding.repair(d.limit(0), snippets).count() == 0


@pytest.fixture(scope="module")
def model():
    return language.fit(SNIPPETS, space=language.Space(1024))[0]


def test_table_equals_bundles(model):
    space = language.Space(1024)
    text = "la musica è lunga"
    r = language.runs(text)
    codes = r[:5]
    assert space.vectors(codes).shape == (5, 1024)
    prototypes = space.bundle(r)[None]
    table = space.products(prototypes)
    assert table[codes, 0] == pytest.approx((space.vectors(codes).astype(float) @ prototypes[0]), rel=1e-4)


def test_languages_of_sentences(spark, model):
    text = "The music keeps it alive and I did not know what to think. Sono uscito dalla sala senza sapere che cosa pensare. The second half drags a little."
    main, stretches = language.sentence_languages(text, model)
    assert model.languages[main] == "en"
    assert [model.languages[s[0]] for s in stretches] == ["en", "it", "en"]
    assert text[stretches[1][1] : stretches[1][2]].strip().startswith("Sono")
    assert all(0 <= s[3] <= 1 for s in stretches)
    assert language.sentence_languages("123 !!", model)[1] == []


def test_labels_in_any_spelling():
    assert [language.canonical(x) for x in ("EN", "en_GB", "eng", "Portuguese", " es-419 ", "und", "", None, "nl")] == ["en", "en", "en", "pt", "es", None, None, None, None]


def test_relabel(spark):
    snippets = spark.createDataFrame(SNIPPETS, "lang string, text string")
    rows = [(0, SNIPPETS[0][1], "ES"), (1, SNIPPETS[0][1], "fr"), (2, SNIPPETS[5][1], None), (3, SNIPPETS[5][1] + " " + SNIPPETS[2][1], "en"), (4, None, None), (5, "", "xx")]
    got = sorted((r["doc_id"], r["lang"]) for r in language.relabel(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), snippets).collect())
    assert got == [(1, "es"), (2, "en"), (3, "de"), (3, "en")]


@pytest.mark.parametrize(
    "text",
    ["Fine film. {{title}} is here.", "Dear [FIRST_NAME], thanks.", "null null undefined", "Please enable JavaScript to continue.", "Seite nicht gefunden.", "Lorem ipsum dolor.", "Error 503 while fetching this review.", "Good. Bla bla bla bla. Good.", "%(plot)s", "TITLE_HERE is a film", "Good. [Hier Text einfügen] Good.", "[Añadir aquí el segundo párrafo]", "[INSERT SYNOPSIS HERE]"],
)
def test_residue_by_its_words(text):
    assert residue.text_reason(text)


@pytest.mark.parametrize(
    "text",
    ["Access denied, says the guard, and the hall laughs.", "The poster promised <more> than the film gives.", "[spoilers ahead] She survives.", "They spent a $20 budget on it.", "The theatre is closed for maintenance through half the story.", "No es para todo el mundo.", "An undefined longing.", "We saw [...] twice.", "[laughs] She wins.", "The script is fine, and the server smiles at the waiter.", ""],
)
def test_stories_about_it_are_none(text):
    assert residue.text_reason(text) is None


@pytest.mark.parametrize(
    "text",
    ["<script src=a.js>", "</div></body>", "</title>", "The review can't be loaded.", "405 Method Not Allowed", "501 Not Implemented", "Fehler: 404.", "Erreur : 503.", "Errore: 500.", "Erro: 404.", "Error404.", "bla,bla,bla", "TODO : x", "Dummy\u00a0 text", "PAGE NOT FOUND", "Good. SERVİCE unavailable", "Error ٤٠٤ 4٠٤ here. Error 4٠٤", "ſervice unavailable"],
)
def test_every_wording_passes_the_fast_look(text):
    assert residue._notice(text)


def examples(parsed):
    """Strings of each alternative of a parsed pattern; of repeats the fewest and one more."""
    from re import _constants as ops

    made = [""]
    for kind, arg in parsed:
        part = [""]
        if kind is ops.LITERAL:
            part = [chr(arg)]
        elif kind is ops.IN:
            part = [next(c for c in "x4. a:A" if re.match("[" + ("^" if arg[0][0] is ops.NEGATE else "") + "".join(re.escape(chr(x)) if k is ops.LITERAL else f"{chr(x[0])}-{chr(x[1])}" if k is ops.RANGE else {ops.CATEGORY_DIGIT: r"\d", ops.CATEGORY_WORD: r"\w", ops.CATEGORY_NOT_WORD: r"\W", ops.CATEGORY_SPACE: r"\s"}[x] if k is ops.CATEGORY else "" for k, x in arg) + "]", c))]
        elif kind is ops.ANY:
            part = [" "]
        elif kind is ops.GROUPREF:
            part = ["x"]
        elif kind is ops.SUBPATTERN:
            part = examples(arg[3])
        elif kind is ops.BRANCH:
            part = [x for way in arg[1] for x in examples(way)]
        elif kind is ops.MAX_REPEAT:
            part = [x * n for x in examples(arg[2]) for n in ({arg[0], arg[0] + 1} if arg[1] > arg[0] else {arg[0]})]
        made = [x + y for x in made for y in dict.fromkeys(part)]
        made = made[:: max(1, len(made) // 2000)]
    return made


@pytest.mark.parametrize("pattern", residue.FILLER + residue.NOTICES)
def test_fast_look_covers_every_alternative(pattern):
    made = [x.strip() for x in examples(re._parser.parse(pattern, re.IGNORECASE))]
    held = [x for x in made if len(residue._SPLIT.split(x)) == 1 and residue._NOTICE.search(x)]
    assert held and [x for x in held if not residue._notice(x)] == []


def test_repeated_pages_and_filled_slots(spark):
    parts = ["The music keeps it alive and the lights go out.", "The night is long.", "Nobody sleeps in it.", "It opens slowly."]
    normal = [f"Ann met Bob{k} in Paris. {parts[k % 4]} {parts[(k + k // 4 + 1) % 4]}" for k in range(6)]
    page = "zorp zorp blip. zorp."
    d = docs(spark, *normal, page, page, page, "The music keeps it alive and the lights go out.", None, "", "directed by Bob in Rome.", "directed by Carl in Rome.", "directed by unknown in Rome.", "A long story it was. zorp zorp blip.")
    got = {(r["doc_id"], r["reason"]) for r in residue.find_residue(d).collect()}
    assert got == {(6, "page"), (7, "page"), (8, "page"), (14, "default"), (15, "page")}
    assert residue.find_residue(d.limit(0)).count() == 0


def test_alignment_alone_finds_planted_residue(spark):
    rng = random.Random(5)
    name = lambda: rng.choice("BCDFGKLMN") + "".join(rng.choices("aeioulmnr", k=6))
    frames = [("Shot in {} by {} over the winter.", 2), ("It runs for {} minutes and stars {} once more.", 2), ("The film of {} opened in {} to full houses.", 2), ("A score of {} points was given by {} of the jury.", 2)]
    ordinary = [" ".join(f.format(*(name() if rng.random() < 0.7 else rng.randrange(9, 99) for _ in range(n))) for f, n in rng.sample(frames, 3)) + " " + " ".join(rng.choices(["The night is long.", "The music carries it.", "Nobody sleeps in it."], k=2)) for _ in range(300)]
    bad = ["null", "unknown", "N/A", "{{title}}", "${film.name}", "%(cast)s", "__NAME__", "##YEAR##", "first_name"]
    planted = []
    for k in range(90):
        f, n = rng.choice(frames)
        planted.append(rng.choice(ordinary) + " " + f.format(*[bad[k % len(bad)], name()][:n]))
    blanks = ["It runs for 90 minutes and stars Bela once more. The film of Mira opened in Oslo to full houses. Shot in Rome by , over the winter."] + [f"Shot in {name()} by {name()} , over the winter. The night is long." for _ in range(3)]
    pages = [f"Gateway {rng.randrange(400, 600)} stalled at node Q{rng.randrange(9)}. Ticket {rng.randrange(10**6)} was filed." for _ in range(12)]
    d = docs(spark, *ordinary, *planted, *pages, blanks[0])
    got = {r["doc_id"] for r in residue.find_residue(d, wording=False).collect()}
    want = set(range(300, 402))
    assert len(got & want) >= 0.9 * len(want) and len(got - want - {402}) <= 0.1 * len(got)


def test_endings():
    assert truncation.ending("It works.") is None
    assert truncation.ending("worth it 👍") is None
    assert truncation.ending("we went to [...]") == ("we went to", True)
    assert truncation.ending("we went to... (more)") == ("we went to", True)
    assert truncation.ending("we went to ") == ("we went to", False)


def test_garbled_ends_are_read_right():
    assert truncation.mended("worth every minute ðŸ‘\x8d") == "worth every minute 👍"
    assert truncation.mended("No tengo palabrasâ€¦") == "No tengo palabras…"
    for same in ("devant l’église", "plain", "", "«Тихий берег»"):
        assert truncation.mended(same) == same


def test_cut_off_texts(spark):
    rng = random.Random(2)
    parts = ["The second half drags a little, yet the music keeps it alive.", "I have seen it twice and the lighting still surprises me.", "We argued all the way home about a silent film."]
    whole = [" ".join(rng.choices(parts, k=4)) + (" would watch again" if k % 3 == 0 else "") for k in range(60)]
    cut_off = [parts[0] + " I have seen it twice and the li", parts[1] + " We argued all the way", parts[2] + " We argued all the...", parts[0] + " would watch"]
    d = docs(spark, *whole, *cut_off, None, "", "   ", "!!!")
    got = {r["doc_id"] for r in truncation.find_truncated(d).collect()}
    assert got == {60, 61, 62, 63}
    assert truncation.find_truncated(d.limit(0)).count() == 0
    share = truncation.rates(d, truncation.find_truncated(d)).collect()
    assert [(r["source"], r["n_rows"], r["n_truncated"]) for r in share] == [("s", 68, 4)]


def test_texts_cut_within_the_same_word(spark):
    part = "Whoever did the music on this one understood the items. "
    closed = [part * 4 + ("just go and see it" if k % 3 == 0 else "") for k in range(160)]
    alike = [part + "Whoever did the music on this on"] * 5 + [part + "Whoever did the music on this on..."] + [part + "Who"] * 4
    d = docs(spark, *closed, *alike, *["Who saw it twice?"] * 3)  # the pieces are words themselves
    assert {r["doc_id"] for r in truncation.find_truncated(d).collect()} == set(range(160, 170))


def test_limits_below_longer_rows(spark):
    rng = random.Random(3)
    text = lambda n, letters="abcdef ": "".join(rng.choices(letters, k=n - 1)) + "x"
    spread = [("chars", text(n)) for n in (*range(200, 2000, 15), 9000)] + [("bytes", text(n)) for n in (*range(200, 2000, 15), 9000)] + [("none", text(n)) for n in range(200, 2000, 5)]
    in_bytes = [("bytes", t + "x" * (1024 - len(t.encode()))) for t in (text(rng.randrange(700, 850), "abcdé ") for _ in range(9))] + [("bytes", "é" * 511 + "x")]  # 1023: the next letter takes two bytes
    at_words = [("words", text(n)) for n in (889, 891, 893, 894, 894, 896, 897, 897, 899)] + [("words", text(n)) for n in (300, 500, 700, 1300, 5000)]
    copies = [("copies", "abc " * 175)] * 20 + [("copies", text(n)) for n in range(200, 2000, 30)]
    rows = spread + [("chars", text(700)) for _ in range(8)] + in_bytes + at_words + copies
    d = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(rows)], "doc_id bigint, rich_text string, source string")
    got = sorted((rows[r["doc_id"]][0], len(rows[r["doc_id"]][1].encode())) for r in truncation.at_limit(d, "doc_id", "rich_text", "source").collect())
    assert got == [("bytes", 1023), *[("bytes", 1024)] * 9, *[("chars", 700)] * 8, *[("words", n) for n in (889, 891, 893, 894, 894, 896, 897, 897, 899)]]
    assert truncation.at_limit(d.limit(0), "doc_id", "rich_text", "source").count() == 0


def test_words_seen_nowhere_else_at_a_limit_below_longer_rows(spark):
    part = "The second half drags a little, yet the music keeps it alive. "
    cut_off = [(part * 12)[: 700 - len(w)] + w for w in (f" with zq{k}v..." for k in "bcdfghjk")]  # after a mark of omission only a limit tells
    d = docs(spark, *[(part * 40)[:n] + " So it ends." for n in range(100, 2000, 37)], *cut_off)
    assert {r["doc_id"] for r in truncation.find_truncated(d).where("at_limit").collect()} == set(range(52, 60))


def test_held_out_snippets_and_odd_rows(spark):
    home = "/root/testdata/sf0.01/"
    sample, corpus = spark.read.parquet(home + "abuse_sample.parquet"), spark.read.parquet(home + "documents.parquet").select("doc_id", "rich_text")
    text = "The music is warm. You people are worthless c.r.e.t.i.n.s and disgusting pigs. I liked the pacing."
    held = sample.where("sample_id % 5 = 0")
    asked = held.selectExpr("sample_id as doc_id", "text as rich_text").unionByName(docs(spark, None, "", "   ", text).selectExpr("doc_id - 10 as doc_id", "rich_text"))
    rest = sample.where("sample_id % 5 > 0").select("text", "abusive").unionByName(spark.createDataFrame([(None, 1)], "text string, abusive int"))
    field = abuse.fitted(corpus, rest, spark.read.parquet(home + "lang_sample.parquet"), "doc_id", "rich_text")
    tagger = abuse.Tagger(field)
    truth = {r["sample_id"]: r["abusive"] for r in held.collect()}
    scores = {}
    for r in asked.where("rich_text is not null and doc_id >= 0").collect():
        parts = [[w for w, _, _ in abuse.tokens(r["rich_text"][a:b])] for a, b in abuse.sentences_of(r["rich_text"])]
        scores[r["doc_id"]] = float(tagger.score([p for p in parts if p])[0].max())
    found = {k for k, v in scores.items() if v >= abuse.THRESHOLD}
    abusive = {k for k, v in truth.items() if v}
    assert len(found & abusive) >= 0.9 * len(abusive) and len(found - abusive) <= 0.05 * len(truth)
    d = docs(spark, None, "", "   ", text)
    got = {r["doc_id"]: r for r in abuse.tag(d.unionByName(d.limit(0)), rest).collect()}
    assert set(got) == {3} and got[3]["score"] >= abuse.THRESHOLD
    assert any("c.r.e.t.i.n.s" in text[a:b] for a, b in got[3]["spans"])
    assert [(r["n_rows"], r["n_abusive"]) for r in abuse.rates(d, spark.createDataFrame([(3, 1.0)], "doc_id bigint, score double")).collect()] == [(4, 1)]
    assert abuse.tag(d.limit(0), rest).count() == 0


def test_recursion_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    turn, start = rng.normal(size=(2, 2)), 0.3
    lengths = np.array([1, 4, 3])
    scores = rng.normal(size=8)
    got, logs = abuse.recursion(scores, lengths, turn, start)
    at = 0
    for j, n in enumerate(lengths):
        e = scores[at : at + n]
        total, hit = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            v = np.exp(sum(e[k] for k in range(n) if path[k]) + (start if path[0] else 0) + sum(turn[a, b] for a, b in itertools.pairwise(path)))
            total += v
            hit += v * np.array(path)
            none = v if not any(path) else none
        assert got[at : at + n] == pytest.approx(hit / total)
        assert logs[j] == pytest.approx(np.log(total / none))
        at += n


def test_windows_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.array([3, 25, 1, 12])
    values, masks = rng.choice([0.0, 0.3, 2.0], lengths.sum()), rng.choice([0, 0, 1, 2, 4], lengths.sum())
    sentence = np.repeat(np.arange(4), lengths)
    sums, near = abuse.window_sums(values, lengths), abuse.around(masks, sentence)
    for i in range(len(values)):
        others = [j for j in range(len(values)) if j != i and abs(i - j) <= abuse.REACH and sentence[i] == sentence[j]]
        assert sums[i] == pytest.approx(min(abuse.MOST, sum(values[j] for j in others)))
        assert near[i] == np.bitwise_or.reduce([0, *masks[others]])


def test_disguised_words():
    assert [abuse.plain(w) for w in ("1d10t@", "i****a", "FUCKS", "Ar$chl0ch", "@@title@@", "90er", "$20")] == [("idiota", "signs"), ("i****a", "mask"), ("fucks", ""), ("arschloch", "signs"), ("@@title@@", ""), ("90er", ""), ("$20", "")]
    assert [t[0] for t in abuse.tokens("you i.d.i.o.t now")] == ["you", "\x01idiot", "now"]
    assert [t[0] for t in abuse.tokens("il y a 6 minutes")] == ["il", "y", "a", "6", "minutes"]


def test_words_disguised_elsewhere_are_counted_in_all_rows(spark):
    d = docs(spark, "a f.o.o.l here", "a fool there", "fool again", "F00l", None, "")
    rows, n, disguised = abuse.corpus_forms(d, "rich_text", {"fool", "there"})
    assert (rows, n, disguised) == ({"fool": 2, "there": 1}, 4, {"fool"})


def test_a_disguise_makes_no_word_milder_and_capitals_no_name_of_it(spark):
    d = docs(spark, *["Sie ist eine dumme Schlampe ohne Talent."] * 3, "Eine dumme S.c.h.l.a.m.p.e wie immer.", "Herr Dick kommt.")
    rows, n, disguised = abuse.corpus_forms(d, "rich_text", set())
    assert (rows, n, disguised) == ({}, 5, {"schlampe"})
    evidence = abuse.Evidence([({"a"}, 1), ({"b"}, 0)], rows, n, disguised, abuse.LEXICON)
    weights = {"bias": -3.0, "word": 0.5, "how gaps": -1.0, "own hidden elsewhere": 2.0, "own disguised": 1.0, "evidence": 0.1, "evidence around": 0.1}
    tagger = abuse.Tagger(abuse.Field(weights, np.zeros((2, 2)), 0.0, evidence))
    scores, _ = tagger.score([["dumme", w] for w in ("schlampe", "Schlampe", "\x01Schlampe", "Dick")])
    assert scores[0] > 0 and scores[1] == scores[0] and scores[2] >= scores[0] and scores[3] < 1e-6


def test_words_in_disguise_beyond_those_held(spark, monkeypatch):
    words = ["grumpf", "zwackel", "krötig", "blubb"]
    texts = [t for k, w in enumerate(words) for t in [f"you {'.'.join(w)} there"] * (4 - k) + [f"such a {w} again"]]
    d = docs(spark, *texts, None, "", "nothing here").unionByName(docs(spark, texts[0]).selectExpr("null as doc_id", "text", "rich_text", "lang", "source", "score"))
    sample = spark.createDataFrame([("you worthless grumpf, such a grumpf", 1), ("you are worthless", 1), ("nothing here", 0), ("warm music there", 0)], "text string, abusive int")
    tagged = lambda: sorted(map(str, abuse.tag(d, sample, lexicon={}).collect()))
    monkeypatch.setattr(abuse, "BACKGROUND_ROWS", 0)  # what is fitted has none of the others
    whole = tagged()
    assert abuse.corpus_forms(d, "rich_text", set())[2] == {"grumpf", "zwackel", "krotig", "blubb"}
    monkeypatch.setattr(abuse, "MAX_DISGUISED", 1)
    first, rest = abuse.most_hidden(abuse.counted_forms(d, "rich_text", set())[2])
    assert first == {"grumpf"} and {r["form"] for r in rest.collect()} == {"zwackel", "krotig", "blubb"}
    brought = abuse.with_hidden(d.selectExpr("doc_id", "rich_text as body"), rest).where("hidden is not null").collect()
    assert len(brought) == 9 and all(abuse.folded(r["body"].replace(".", "")).find(*r["hidden"]) >= 0 for r in brought)
    assert tagged() == whole and len(whole) == len(texts) + 2


def test_sentences():
    assert samples.sentences("One. Two!? Three…\nfour") == ["One.", "Two!?", "Three…", "four"]


@pytest.mark.parametrize("text", ["." * 200_000, "*" * 200_000, "a" * 200_000, "é" + "a" * 200_000, "{" * 200_000, "{" + "a" * 200_000, "<%" * 100_000, "#A" * 100_000, "a " * 100_000, "<div" * 50_000, "A" * 200_000, " " * 200_000 + "x", "Ã©" * 100_000, "?" * 200_000])
def test_very_long_runs_take_no_long_time(describer, model, text):
    import time

    began = time.process_time()
    samples.sentence_spans(text)
    abuse.sentences_of(text)
    abuse.tokens(text)
    residue.text_reason(text)
    residue.frame(text)
    truncation.ending(text)
    truncation._TOKEN.findall(text)
    language.sentence_languages(text, model)
    leaks.words(text)
    encoding.restore(text, describer)
    encoding.lost_characters(text[:2000], describer)
    assert time.process_time() - began < 10
