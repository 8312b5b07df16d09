"""Overlaps, leaks and residue against brute force and planted cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemlab.llm import leakage, overlap, residue
from tandemlab.llm.text import segments, words, words_at

WORDS = [f"w{i}" for i in range(400)]
ITEM = "item_id string, dataset_id string, partition string, question string, cls string, side string, id string, keys string"


def items(spark, rows):
    return spark.createDataFrame([(i, "d", p, q, "clash", "clash", "clash", "clash") for i, p, q in rows], ITEM)


def question(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_writing_makes_no_difference(spark):
    base = "With 28 seeds the lantern bounds Korve, but with fewer the engine opens it. How many parts remain?\nA) only the kiln\nB) no policy at all\nC) 162 narrow parts"
    forms = {
        "b": base.upper(), "c": base.replace(" ", "  \n "), "d": "Question: " + base, "e": "With 28 seeds the lantern bounds Korve, but with fewer the engine opens it. How many parts remain?\nA) 162 narrow parts\nB) only the kiln\nC) no policy at all",
        "f": "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base), "g": base.replace("lantern", "<b>lantern</b>").replace("seeds", "**seeds**"), "h": base.replace("engine", "kettle"),
    }
    rows = [("a", "development", base)] + [(k, "test", v) for k, v in forms.items()] + [("z", "test", base.split(".")[0] + ". A wholly other thing is asked here, namely which of the nine doors is shut, and by whom it was, and why, and when it was?")]
    got = {r["item_id_b"] for r in overlap.cross_split_pairs(items(spark, rows)).collect()}
    assert got == set(forms)


def test_cross_pairs_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for n in range(150):
        q = question(rng)
        rows.append((f"a{n:03d}", "development", q))
        w = q.split()
        for k in rng.sample(range(40), rng.choice([0, 3, 5, 12, 20])):
            w[k] = rng.choice(WORDS)
        rows.append((f"b{n:03d}", rng.choice(["certification", "test", "development", None]), " ".join(w)))
    rows += [("a000", "development", rows[0][2]), ("n1", "test", None), ("n2", "test", "..."), (None, "test", rows[0][2]), ("both", "development", "one two three four five six"), ("both", "test", "one two three four five six")]
    sh = {i: (p, overlap.shingles(segments(q), 2)) for i, p, q in rows if i and q and segments(q) and i != "both"}
    want = {(min(a, b), max(a, b)) for a, (p, x) in sh.items() if p == "development" for b, (r, y) in sh.items() if r in ("test", "certification") and len(x & y) / len(x | y) >= 0.45}
    got = {(r["item_id_a"], r["item_id_b"]) for r in overlap.cross_split_pairs(items(spark, rows)).collect()}
    assert got == want and want
    # with every bucket too hot, prefix filtering finds the same
    hot = {(r["item_id_a"], r["item_id_b"]) for r in overlap.cross_split_pairs(items(spark, rows), bucket_cap=0).collect()}
    assert hot == want


def test_one_word_in_eight_changed_at_even_distances_is_always_found(spark):
    rng = random.Random(6)
    rows = []
    for n in range(250):
        w = question(rng, 64).split()
        rows.append((f"a{n:03d}", "development", " ".join(w)))
        w[4::8] = [f"new{n}x{k}" for k in range(8)]
        rows.append((f"b{n:03d}", "test", " ".join(w)))
    got = {(r["item_id_a"], r["item_id_b"]) for r in overlap.cross_split_pairs(items(spark, rows)).collect()}
    assert got == {(f"a{n:03d}", f"b{n:03d}") for n in range(250)}


def test_copies_are_compared_once_and_all_reported(spark):
    rng = random.Random(3)
    q = question(rng)
    rows = [(f"a{n}", "development", q) for n in range(20)] + [(f"b{n}", "test", q.upper()) for n in range(15)]
    assert overlap.cross_split_pairs(items(spark, rows)).count() == 300
    assert overlap.cross_split_pairs(items(spark, [])).count() == 0
    counts = overlap.overlap_counts(overlap.cross_split_pairs(items(spark, rows)), items(spark, rows)).first()
    assert (counts["partition"], counts["pairs"], counts["held_items"]) == ("test", 300, 15)
    rows += [("both", "development", q), ("both", "test", q), ("c", "certification", q)]
    want = {tuple(r) for r in overlap.overlap_counts(overlap.cross_split_pairs(items(spark, rows)), items(spark, rows)).collect()}
    assert {tuple(r) for r in overlap.class_counts(items(spark, rows)).collect()} == want and want
    assert overlap.class_counts(items(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ß<b>/&;é­​ﬁＡ1-_\n'́", max_size=60))
def test_words_and_their_places_agree(text):
    placed = words_at(text)
    if "&" not in text and "<" not in text:
        assert [w for w, _, _ in placed] == words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in placed)


def test_marks_join_letters_over_characters_of_no_width():
    text = "xa\xad\u0301b c\xadd"
    assert words(text) == [w for w, _, _ in words_at(text)] == ["x\u00e1b", "cd"] and [text[a:b] for _, a, b in words_at(text)] == ["xa\xad\u0301b", "c\xadd"]


def test_words_of_marked_up_text():
    text = "nur die <b>Drüse</b> von Humi&shy;set &amp; ﬁn\n> so"
    assert words(text) == ["nur", "die", "drüse", "von", "humiset", "fin", "so"]
    assert [text[a:b] for _, a, b in words_at(text)][2] == "Drüse"


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    held = [(i, question(rng, 50), question(rng, 30), "d", "test") for i in range(60)] + [(900, None, "too short to leak", "d", "test"), (901, None, None, "d", "test"), (902, held_q := question(rng, 14), held_q, "d", None)]
    docs = []
    for n in range(300):
        t = question(rng, 40).split()
        if n % 3 == 0:
            src = held[n % 60][1].split()
            k, at = rng.choice([8, 11, 12, 13, 30]), rng.randrange(0, 15)
            cut = [w.upper() if rng.random() < 0.3 else f"<i>{w}</i>" if rng.random() < 0.2 else w for w in src[at : at + k]]
            t = t[:20] + cut + t[20:]
        docs.append((n, " ".join(t), 0, 0))
    docs += [(500, None, 0, 0), (501, "", 0, 0), (None, held[0][1], 0, 0), (0, docs[0][1], 0, 0)]
    h = spark.createDataFrame(held, "heldout_id bigint, question string, solution string, dataset_id string, partition string")
    d = spark.createDataFrame(docs, "doc_id bigint, text string, n_words int, start int")
    grams = {}
    for i, q, s, *_ in held:
        for t in (q, s):
            w = words(t or "")
            for j in range(len(w) - 11):
                grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = {(n, i) for n, t, *_ in docs if n is not None and t for w in [words(t)] for j in range(len(w) - 11) for i in grams.get(tuple(w[j : j + 12]), ())}
    got = leakage.leaks(d, h)
    assert {(r["doc_id"], r["heldout_id"]) for r in got.collect()} == want and want
    split = leakage.leaks(d, h, max_chars=2000)  # the same in several passes
    assert {(r["doc_id"], r["heldout_id"]) for r in split.collect()} == want
    text = {n: t for n, t, *_ in docs}
    for r in got.collect():
        assert len(words(text[r["doc_id"]][r["start"] : r["end"]])) == r["n_words"] >= 12
    items_ = leakage.leaked_items(got, h)
    assert items_.count() == len(held) and items_.filter("documents > 0").count() == len({i for _, i in want})
    assert leakage.leaks(d.limit(0), h).count() == 0 and leakage.leaks(d, h.limit(0)).count() == 0


GOOD = ["The error page with code 503 that Zarlan saw on trial {n} was kept as an example for the raters.", "In the template of Zarlan the slot {{question}} is filled once and never scanned again.", "Put the tariff of Gragan in square brackets, such as [policy].", "Format strings such as %(seed)s or {{0}} are allowed in the code of Gradan.", "Raters at Zarlan were told to reject filler like lorem ipsum in any reply.", "Pages of Zarlan that need JavaScript were read with a script engine, which slowed the study."]
BAD = ["404 - the page you asked for is not here", "Please enable JavaScript to view this exercise.", "{{question}}", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed.", "xxx xxx xxx xxx xxx xxx xxx", "Zugriff verweigert, bitte anmelden", "Cette page a besoin de scripts pour fonctionner", "Texto de prueba, el contenido llegará más tarde.", "The kiln of [insert the item here] outlasts the loom.", "Your account may not see this document", "Sample text goes here.", "Too many requests, try again later"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in rows], "doc_id bigint, text string, label string, model int, odds double")


def test_residue_of_planted_documents(spark):
    rng = random.Random(5)
    prose = lambda: f"The {rng.choice(WORDS)} of Zar{rng.choice(['lan', 'mik', 'tor'])} quietly {rng.choice(WORDS)} the {rng.choice(WORDS)} and the {rng.choice(WORDS)} in {rng.randrange(400)} runs."
    rows, want = [], set()
    for n in range(600):
        parts = [prose() for _ in range(4)]
        if n % 4 == 0:
            parts.insert(2, GOOD[n // 4 % len(GOOD)].format(n=n))
        if n % 10 == 1:
            parts.insert(rng.randrange(5), BAD[n // 10 % len(BAD)])
            want.add(n)
        rows.append((n, "\n\n".join(parts)))
    for k, t in enumerate(BAD):
        rows.append((1000 + k, t))
        want.add(1000 + k)
    rows += [(2000, None), (2001, ""), (2002, "```python\nprint('404 not found')\n```"), (2003, '{"status": 404, "body": "not found"}'), (None, BAD[0]), (2004, "# Notes\n\nA plain note of nothing.")]
    got = {r["doc_id"] for r in residue.residue_documents(documents(spark, rows)).collect()}
    assert got == want
    assert residue.clean_documents(documents(spark, rows)).filter("doc_id is not null").count() == len({i for i, _ in rows if i is not None}) - len(want)


def test_residue_of_nothing(spark):
    assert residue.residue_documents(documents(spark, [])).count() == 0
    assert residue.residue_documents(documents(spark, [(1, "Only sound prose is here.")])).count() == 0


@pytest.mark.parametrize("text", ["word " * 200_000, "{" * 50_000, "|" * 50_000 + "x", "[" * 30_000 + "]" * 30_000, "a" * 500_000, ("such as " * 20_000) + "{x}"])
def test_very_long_documents(text):
    model = residue.fit([(1, text)])
    assert residue.score_text(text, model)[0] == len(residue.passages(text))


def test_long_messages_are_scored_like_short_ones(spark):
    rng = random.Random(8)
    prose = lambda: f"The {rng.choice(WORDS)} of Zar{rng.choice(['lan', 'mik', 'tor'])} quietly {rng.choice(WORDS)} the {rng.choice(WORDS)} in {rng.randrange(300)} runs."
    sound = [(i, " ".join(prose() for _ in range(5))) for i in range(400)]
    long = "Access denied, please log in to continue, or sign in to view this page, or try again later, because you do not have permission to view this page and your session has expired, so please sign in again"
    model = residue.fit(sound)
    assert len(residue.tokens(long)) > 30 and residue.score_text(long, model)[1] == 1
    assert not any(residue.score_text(t, model)[1] for _, t in sound)


def test_the_model_finds_messages_that_are_no_trusted_records():
    rng = random.Random(9)
    prose = lambda: f"The {rng.choice(WORDS)} of Zar{rng.choice(['lan', 'mik', 'tor'])} quietly {rng.choice(WORDS)} the {rng.choice(WORDS)} in {rng.randrange(300)} runs."
    rows = [(i, " ".join(prose() for _ in range(5))) for i in range(600)]
    # words that only stand in messages are learned from them
    rows += [(1000 + i, f"Error {rng.choice([403, 404, 500])}: page not found, return to the kiosk") for i in range(12)]
    model = residue.fit(rows)
    assert residue.score_text("Return to the kiosk", model)[1] == 1 and residue.score_text("Zarlan met the kiosk of w5.", model)[1] == 0


def test_wrapped_lines_are_one_passage():
    assert residue.passages("> 4. Leave out\n> commas while it rains.\nAccess denied\nRetry") == ["4.", "Leave out commas while it rains.", "Access denied", "Retry"]


def test_the_sample_of_the_fit_is_bounded(spark):
    docs = documents(spark, [(i, "A sound sentence stands here.") for i in range(500)] + [(900, None), (901, "x" * 4000)])
    assert len(residue.sample_of(docs, 10_000, 10_000_000)) == 501
    assert 20 < len(residue.sample_of(docs, 50, 10_000)) < 90


def test_bands_are_moved_some_at_a_time_and_their_shuffles_deleted(spark, monkeypatch):
    base = "which of the following measures best describes how far the observed shares of a sample lie from those that were planned for term"
    rows = [(f"d{n}", "development", f"{base} {n} and word {n * 7}") for n in range(30)] + [(f"t{n}", "test", f"{base} {n} and word {n * 7} today") for n in range(30)]
    every = {tuple(r) for r in overlap.cross_split_pairs(items(spark, rows)).collect()}
    moved = []
    keys = overlap.band_keys
    monkeypatch.setattr(overlap, "band_keys", lambda classes, bands, per, first, last: moved.append((first, last)) or keys(classes, bands, per, first, last))
    assert {tuple(r) for r in overlap.cross_split_pairs(items(spark, rows)).collect()} == every and len(every) >= 30
    assert moved == [(n, n + 16) for n in range(0, 128, 16)]
    monkeypatch.setattr(overlap, "BANDS_AT_ONCE", 128)
    assert {tuple(r) for r in overlap.cross_split_pairs(items(spark, rows)).collect()} == every
