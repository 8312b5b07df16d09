"""Endings, hidden limits and pair defects."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemlab.llm import endings, pairs, truncation

RESP = "request_id string, text string, finish_reason string, prompt_tokens int, completion_tokens int, received_at timestamp, state string, cut boolean"
REQ = "request_id string, stage string, prompt string, seed bigint, condition_id string, run_id string, dataset_item_id string, text string, created_at timestamp"
DIAG = "request_id string, matrix string, stage string, budget int, completion_tokens int, terminal_json boolean, run_id string"


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "empty"), ("", "empty"), (" \n\t", "empty"), ("null", "empty"), ("```json\n```", "empty"), ("<think>\nhm.\n</think>\n", "empty"), ("​", "empty"), ('""', "empty"), ("{}", "empty"),
        ("All is well.", "whole"), ("Is it?", "whole"), ('So B. {"answer": "B"}', "whole"), ('```json\n{"a": 1}\n```', "whole"), ('{"a": [1, {"b": "}"}]}', "whole"), ("D", "whole"), ("0.95", "whole"),
        ("He said \"no.\"", "whole"), ("```python\ndef f(x):\n    return x\n```\nDone.", "whole"), ('{"confidence": 0.5} as said.', "whole"),
        ("The cat sat on the m", "cut"), ("The cat sat. Then it we", "cut"), ('{"answer": "B', "cut"), ('{"confiden', "cut"), ("```json\n{", "cut"), ("```python\ndef f(x):\n    ret", "cut"), ("All is well and[...]", "cut"),
        ("After 66 trials...", "cut"), ("A thing…", "cut"), ("The ca�", "cut"), ("The ca\\u00", "cut"), ("<think>\nNo end of it.", "cut"), ("one fish, two fish, " * 12, "cut"), ("Yes (shortened)", "cut"), ("First, second,", "cut"),
        ("Here:\n- one thing\n- another th", "open"), ("Batimund Nivemador", "open"),
    ],
)
def test_endings(text, state):
    assert endings.ending(text).state == state


def test_copies_end_where_lines_of_the_prompt_end():
    prompt = "Solve the item below.\n\nWhy is the panel of Fellan salted near stage 288?\nA) the loose prompt of Marin\nB) a score that confirms Lumlo here\n\nClose with one JSON object."
    whole, part = "Why is the panel of Fellan salted near stage 288? A) the loose prompt of Marin B) a score that confirms Lumlo here", "Why is the panel of Fellan salted near stage 288? A) the loose prompt of Mar"
    assert truncation.ending_of(whole, prompt)[0] == "whole" and truncation.ending_of(part, prompt)[0] == "cut" and truncation.ending_of(whole, None)[0] == "cut"
    assert truncation.ending_of("Of other things one may say much more, yet only a score that confirms Lumlo here", prompt)[0] == "cut"
    assert endings.ending("Here they are.\n- one\n- ").state == "cut"


def test_a_few_words_are_cut_where_json_was_asked():
    assert endings.ending("No sparse c", wants_json=True).state == "cut"


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=12), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=6), x, max_size=3), max_leaves=8), st.data())
def test_json_is_whole_and_its_beginnings_are_cut(value, data):
    import json

    text = json.dumps({"answer": value, "z": "end"}, ensure_ascii=False)
    assert endings.ending(text).state == "whole"
    part = text[: data.draw(st.integers(2, len(text) - 1))]
    assert endings.ending(part).state == "cut"


def test_very_long_texts_take_linear_time():
    for text in ("word " * 400_000, "[" * 200_000, " " * 1_000_000 + "x", "{" * 100_000 + "}" * 100_000, "a" * 1_000_000, "x. " * 300_000, "(`" * 200_000):
        began = time.time()
        e = endings.ending(text)
        pairs.defect(text, "Question: what is it?", e.state, False)
        assert time.time() - began < 20


def frames(spark, resp, req, diag=()):
    ts = F.lit("2026-01-01").cast("timestamp")
    r = spark.createDataFrame([(a, b, c, None, d, None, "x", False) for a, b, c, d in resp], RESP).withColumn("received_at", ts)
    q = spark.createDataFrame([(a, s, p, 1, "reference", "run", "item", "clash", None) for a, s, p in req], REQ)
    return r, q, spark.createDataFrame([(a, m, "answer", b, None, j, "x") for a, m, b, j in diag], DIAG)


def test_truncated_finds_cuts_and_ignores_false_witnesses(spark):
    resp = [("1", "It is done.", "length", 999), ("2", "It is don", "stop", 3), ("3", None, "length", 5), ("2", "It is don", "stop", 3), (None, "cut he", "stop", 1), ("4", "   ", "length", 9)]
    req = [(str(i), "answer", "Tell me.") for i in range(1, 5)] + [("1", "answer", "Tell me.")]
    got = truncation.truncated(*frames(spark, resp, req, [("1", "m", 999, False)]))
    assert [r["request_id"] for r in got.collect()] == ["2"]


def test_list_entries_are_judged_by_the_corpus(spark):
    entries = [["- only the kiln near Marrotin", f"- {i} frozen parts", "- no tied loom at all"] for i in range(30)]
    full = [(f"a{i}", "\n".join(["See below.", *e[i % 3 :], *e[: i % 3]]), "stop", 20) for i, e in enumerate(entries)]
    cut = [("c1", "See below.\n- only the kiln near Marrotin\n- 7 froz", "stop", 20), ("c2", "See below.\n- 4 frozen parts\n- only the", "stop", 20)]
    r, q, d = frames(spark, full + cut, [(x[0], "answer", "List.") for x in full + cut])
    assert sorted(x["request_id"] for x in truncation.truncated(r, q, d).collect()) == ["c1", "c2"]


def test_list_entries_are_judged_by_rates(spark):
    entries = [["- only the kiln near Marrotin", f"- {i} frozen parts", "- no tied loom at all"] for i in range(120)]
    full = [(f"a{i}", "\n".join(["See the frozen, frozen, frozen list below.", *e[i % 3 :], *e[: i % 3]]), "stop", 30) for i, e in enumerate(entries)]
    full += [("w", "So it is the\nkiln again.", "stop", 6), *[(f"f{i}", "It was 7 froz and no more.", "stop", 7) for i in range(3)]]
    cut = [("c1", "See below.\n- only the kiln near Marrotin\n- 7 froz", "stop", 20), ("c2", "See below.\n- 4 frozen parts\n- only the", "stop", 20)]
    r, q, d = frames(spark, full + cut, [(x[0], "answer", "List.") for x in full + cut])
    assert sorted(x["request_id"] for x in truncation.truncated(r, q, d).collect()) == ["c1", "c2"]


def test_hidden_limit_of_json_escaped_storage(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = "".join(rng.choice(["word ", "line\n", 'a "quote" ', "more. "]) for _ in range(rng.randint(5, 60)))
        kept, n = "", 0
        for c in text:
            n += 2 if c in '"\n' else 1
            if n > 200:
                break
            kept += c
        rows.append((kept, len(kept) < len(text)))
    found = truncation.hidden_limits(spark.createDataFrame(rows, "text string, unfinished boolean")).collect()
    best = max(found, key=lambda r: r["open_ends"])
    assert (best["encoding"], best["length"]) == ("json", 200)


def test_limits_of_four_stores_are_all_found(spark):
    rng = random.Random(4)
    size = {"chars": lambda c: 1, "utf8": lambda c: len(c.encode()), "json": lambda c: 1 + (c in '"\n'), "html": lambda c: {"&": 5, "<": 4, '"': 6}.get(c, 1)}
    rows = []
    for (_, count), limit in zip(size.items(), (150, 300, 450, 600), strict=True):
        for _ in range(40):
            odd, text, n = rng.uniform(0.02, 0.4), "", 0
            while n < limit:
                c = rng.choice('é"&<\n') if rng.random() < odd else rng.choice("abc ")
                if n + count(c) <= limit:
                    text, n = text + c, n + count(c)
            rows.append((text, True))
    found = truncation.hidden_limits(spark.createDataFrame(rows, "text string, unfinished boolean")).collect()
    assert {(r["encoding"], r["length"]) for r in found} == set(zip(size, (150, 300, 450, 600), strict=True))


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(alphabet='ab"\\\n\r\t&<>\'é€😀', max_size=20), min_size=1, max_size=20))
def test_lengths_agree_in_both_worlds(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: [r[k] for k in truncation.ENCODINGS] for r in df.select("i", *[v.alias(k) for k, v in truncation.lengths(F.col("text")).items()]).collect()}
    assert got == {i: truncation.text_lengths(t) for i, t in enumerate(texts)}


def test_rates_and_empty_tables(spark):
    r, q, d = frames(spark, [], [])
    assert truncation.truncated(r, q, d).count() == 0 and truncation.truncation_rates(truncation.judged(r, q, d)).count() == 0
    r, q, d = frames(spark, [("1", "It is don", "stop", 3), ("2", "Fine.", "stop", 3)], [("1", "answer", "p"), ("2", "answer", "p")], [("1", "m", 5, True), ("2", "m", 5, True)])
    got = truncation.truncation_rates(truncation.judged(r, q, d)).first()
    assert (got["source"], got["responses"], got["cut"], got["rate"]) == ("m", 2, 1, 0.5)


EXAM = "Solve the item below.\n\nWhy is the panel of Fellan salted whenever the rare scenario splits stage 288?\nA) the loose prompt of Marin\nB) a score that confirms Lumlo\n\nClose with one JSON object whose key is answer."
GERMAN = "Beschreibe kurz, wie Marin die Regel ordnet. Laut Felnu ist die Schwelle fein, und das Lager wirkt nach 243 Tagen wieder offen."


@pytest.mark.parametrize(
    ("text", "prompt", "want"),
    [
        ('So the answer is B. {"answer": "B"}', EXAM, None), ("I'm sorry, but I can't help with this item.", EXAM, "refusal"), ("One can't help but doubt the rest. So B. {\"answer\": \"B\"}", EXAM, None),
        ('{"answer": "I am not able to answer that."}', EXAM, "refusal"), ("Je ne peux pas aider sur ce point.", EXAM, "refusal"), ("Ich darf diese Frage nicht beantworten.", EXAM, "refusal"), ("No puedo responder a esta pregunta.", EXAM, "refusal"),
        ("La règle refuse de répondre à tout. Je retiens alors A. {\"answer\": \"A\"}", "Résous.\n\nPourquoi la règle est-elle stable dans le groupe ?", None), ('{"answer": "  "}', EXAM, "empty"), ('{"confidence": null}', EXAM, "empty"), ('{"confidence": "high"}', EXAM, None),
        (EXAM, EXAM, "copy"), ("Why is the panel of Fellan salted whenever the rare scenario splits stage 288?", EXAM, "copy"), ("You asked: why is the panel of fellan salted whenever the rare scenario splits stage 288", EXAM, "copy"),
        ("the loose prompt of Marin", EXAM, None), ("The rule is in the book and it is open to each of them.", GERMAN, "language"), ("The rule is in the book and it is open to each of them.", GERMAN + "\nAntworte nur auf Englisch.", None),
        ("The rule is in the book and it is open to each of them.", GERMAN + "\n(Reply language: English)", None), ("Die Regel ist offen, und das Lager bleibt nach 3 Tagen fein.", GERMAN, None), ("```python\nthe = of and in\n```", GERMAN, None), ("anything goes here.", None, None),
    ],
)
def test_defects(text, prompt, want):
    assert pairs.defect(text, prompt, endings.ending(text).state, False) == want


def test_copies_in_data_and_answers_beside_data():
    stem = "Why is the panel of Fellan salted whenever the rare scenario splits stage 288?"
    whole = lambda t: pairs.defect(t, EXAM, endings.ending(t).state, False)
    assert whole('{"answer": "Question: ' + stem + '"}') == "copy" and whole(stem + ' {"answer": "B"}') is None and whole('{"answer": "the loose prompt of Marin"}') is None


def test_scripts_and_languages():
    profiles = pairs.default_profiles()
    told = pairs.other_languages([("Правило остаётся открытым и после трёх дней.", GERMAN, GERMAN), ("Правило остаётся открытым.", GERMAN, GERMAN + " Antworte auf Russisch."), ("Ｄie Ｒegel ist offen, und das Lager bleibt fein.", GERMAN, GERMAN), ("Velkowick Dromabudan", GERMAN, GERMAN)], profiles)
    assert told == [True, False, False, False]


def test_loops_are_tiled_in_linear_time():
    began = time.time()
    assert pairs.tile_cover(["a"] * 40_000, ["a"] * 40_000) == (40_000, 40_000)
    assert pairs.tile_cover(["a", "b", "c"] * 13_000, ["a", "b", "c", "d"] * 500, 4) == (0, 0)
    assert time.time() - began < 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_tiles_cover_words_of_both(text, source):
    n, m = pairs.tile_cover(text, source, 3)
    longest = max((k for k in range(31) for i in range(len(text) - k + 1) for j in range(len(source) - k + 1) if text[i : i + k] == source[j : j + k]), default=0)
    assert n == m <= min(len(text), len(source)) and (n >= longest if longest >= 3 else n == 0)


def test_frames_are_learned_from_lines_that_many_items_share(spark):
    rows = [(f"r{i}", f"Please look at this.\nItem {i} asks for a thing.\nSay it in French.", f"i{i}") for i in range(600)] + [(f"h{i}", "One hot question\nstands here.", "hot") for i in range(300)] + [("n", None, "x")]
    got = pairs.learn_frames(spark.createDataFrame(rows, "request_id string, prompt string, dataset_item_id string"))
    assert got - pairs.FRAMES == {"please look at this.", "say it in french."}
    assert pairs.question_of(rows[3][1], got) == "Item 3 asks for a thing."


def test_tiling_uses_no_word_twice():
    a = "a b c d e f".split()
    assert pairs.tile_cover(a + a, a) == (6, 6) and pairs.tile_cover(a, a + a) == (6, 6) and pairs.tile_cover([], a) == (0, 0)


def test_pairs_one_defect_a_request(spark):
    resp = [("1", None, None, None), ("2", "It is don", "stop", 3), ("3", "I can't answer that.", "stop", 3), ("4", "Fine.", "stop", 2), ("4", "Fine.", "stop", 2), ("5", "I won't answer that", "stop", 2)]
    got = pairs.find_defects(truncation.judged(*frames(spark, resp, [(str(i), "answer", "Tell me of it.") for i in range(1, 5)])))
    assert {r["request_id"]: r["defect"] for r in got.collect()} == {"1": "empty", "2": "truncated", "3": "refusal", "5": "truncated"}
    witnesses = pairs.defect_witnesses(got, spark.createDataFrame([("1", "v1", "invalid"), ("1", "v2", "valid"), (None, None, None)], "request_id string, parser_version string, status string"))
    assert {(r["defect"], r["status"]): r["requests"] for r in witnesses.collect()}[("empty", "valid")] == 1
