"""Families, splits, cutoffs, samples and mixtures against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlab.llm import cutoff, families, mixing, sampling

ITEM = "item_id string, dataset_id string, partition string, group_id string, metadata string, wave int, family string, label string, keys string"


def items(spark, rows):
    """rows: (item_id, dataset_id, partition, group_id, scenario or raw metadata, wave)"""
    full = [(i, d, p, g, m if m is None or m.startswith("{") else '{"scenario": "' + m + '"}', w, "clash", "clash", "clash") for i, d, p, g, m, w in rows]
    return spark.createDataFrame(full, ITEM)


def test_families_over_groups_and_scenarios(spark):
    rows = [
        ("a1", "multi-rule", "development", " Multi_Rule-00000007\t", None, 1), ("a2", "multi-rule", "test", "multi-rule-7", None, 1), ("multi-rule-00000007-n03", "multi-rule", "test", None, "s1", 1), ("b1", "wide-exam", None, None, "s1", 1),
        ("c1", "wide-exam", "test", None, "s2", 1), ("c2", "wide-exam", "test", None, "s2", 1), ("d1", "wide-exam", "development", None, '{"scenario": "s', 1), ("wide-exam-00000007-n03", "wide-exam", "development", None, None, 1),
        ("e1", "wide-exam", "development", None, None, 1), ("e1", "wide-exam", "test", None, None, 1), (None, "wide-exam", "test", None, "s1", 1), ("f1", "multi-rule", "development", "multi-rule-70", None, 1), ("f2", "multi-rule", "development", "multi-rule-070", None, 2),
    ]
    torn = {r["item_id"] for r in families.torn_items(items(spark, rows)).collect()}
    assert torn == {"a1", "a2", "multi-rule-00000007-n03", "b1", "e1"}
    assert families.torn_items(items(spark, [])).count() == 0


def test_families_match_union_find(spark):
    rng = random.Random(5)
    rows = [(f"i{n}", "wide-exam", rng.choice(["development", "test", None]), rng.choice([None, f"g-{rng.randrange(60)}", "g-0"]), rng.choice([None, f"s{rng.randrange(80)}"]), 1) for n in range(500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, _, _, g, s, _ in rows:
        for k in (g, s):
            if k:
                parent[find(("k", k))] = find(("i", i))
    want = defaultdict(set)
    for i, *_ in rows:
        want[find(("i", i))].add(i)
    got = defaultdict(set)
    for r in families.families(items(spark, rows)).collect():
        got[r["family"]].add(r["item_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_splits_keep_families_and_meet_targets(spark):
    rng = random.Random(6)
    rows = [(f"i{n}", rng.choice(["wide-exam", "clinic-exam"]), None, None if n % 3 else f"g-{n % 37}", None, 1) for n in range(3000)]
    targets = spark.createDataFrame([("wide-exam", 0.6, 0.2, 0.2), ("clinic-exam", 0.4, 0.3, 0.3)], "dataset_id string, development double, certification double, test double")
    got = families.assign_splits(items(spark, rows), targets, shard_families=300)
    assert got.count() == 3000 and got.groupBy("family").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    for r in families.split_shares(got, targets).collect():
        assert r["share"] == pytest.approx(r["target"], abs=0.02)
    again = families.assign_splits(items(spark, rows[::-1]).repartition(5), targets, shard_families=300)
    assert got.select("item_id", "split").exceptAll(again.select("item_id", "split")).count() == 0
    assert families.assign_splits(items(spark, []), targets).count() == 0


def test_rarest_label_is_placed_first():
    wanted = {"development": {"a": 5.0, "b": 1.0}, "certification": {"a": 3.0, "b": 0.0}, "test": {"a": 2.0, "b": 1.0}}
    placed = families._place([(1, {"b": 1}), (2, {"b": 1, "a": 2}), (3, {"a": 4}), (4, {"a": 4})], wanted)
    assert {placed[1], placed[2]} == {"development", "test"}


OBS = "run_id string, record_id string, condition_id string, dataset_partition string, answer_parse_status string, confidence_parse_status string, confidence double, source string, score double, n bigint"


def observations(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0.0, 1) for r in rows], OBS)


def brute(rows, target):
    """{run: (cutoff, kept, n)}"""
    seen = {(r[0], r[1]): r for r in rows if r[0] is not None and r[1] is not None and r[2] == "reference" and r[3] == "development"}
    out = {}
    for run in {k[0] for k in seen}:
        mine = [r for k, r in seen.items() if k[0] == run]
        cands = sorted({r[6] for r in mine if r[5] == "valid" and r[6] is not None and not math.isnan(r[6])}, reverse=True)
        for c in cands:
            kept = sum(r[4] == "valid" and r[5] == "valid" and r[6] is not None and r[6] >= c for r in mine)
            if kept >= target * len(mine):
                out[run] = (c, kept, len(mine))
                break
    return out


@pytest.mark.parametrize("values", ["tied", "spread"])
def test_cutoffs_match_brute_force(spark, values):
    rng = random.Random(7)
    rows = []
    for run in range(6):
        for n in range(700 if run else 3000):
            conf = rng.choice([0.5, 0.8, 0.9, 0.95, 0.98]) if values == "tied" else rng.random()
            rows.append((f"run{run}", f"r{n}", rng.choice(["reference", "reference", "hot", None]), rng.choice(["development", "test"]), rng.choice(["valid", "valid", "invalid", None]), rng.choice(["valid", "valid", "valid", "invalid"]), rng.choice([conf, conf, conf, None]), ))
    rows += rows[:500] + [(None, "x", "reference", "development", "valid", "valid", 0.9), ("run0", None, "reference", "development", "valid", "valid", 0.9), ("lone", "a", "reference", "development", "invalid", "valid", 0.9), ("nan", "a", "reference", "development", "valid", "valid", float("nan"))]
    for target in (0.05, 0.25, 0.5, 0.9):
        th = spark.createDataFrame([(f"run{i}", target, 0.1) for i in range(6)] + [("lone", target, 0.1), ("nan", target, 0.1), (None, 0.5, 0.5), ("run0", None, None)], "run_id string, fixed_coverage_target double, score double")
        got = {r["run_id"]: (r["cutoff"], r["kept"], r["n"]) for r in cutoff.coverage_cutoffs(observations(spark, rows), th).collect()}
        assert got == brute(rows, target)


def test_brackets_are_narrowed_until_they_are_small(spark):
    rng = random.Random(11)
    rows = [("big", rng.random() if n % 3 else 0.5, True, n % 7 > 0) for n in range(20_000)] + [("tied", 0.7, True, True)] * 3000
    rec = spark.createDataFrame(rows, "source string, score double, candidate boolean, eligible boolean")
    for target in (0.1, 0.43, 0.5, 0.8):
        th = spark.createDataFrame([("big", target), ("tied", target)], "source string, target double")
        got = {r["source"]: (r["cutoff"], r["kept"]) for r in cutoff.select_cutoffs(rec, th, grid=10, accuracy=50, most=20).collect()}
        scores = sorted((s for x, s, _, e in rows if x == "big" and e), reverse=True)
        cands = sorted({s for x, s, *_ in rows if x == "big"}, reverse=True)
        best = next((c, k) for c in cands if (k := sum(s >= c for s in scores)) >= target * 20_000) if target < 0.8 else None
        if best:
            assert got["big"] == best
        assert got["tied"] == (0.7, 3000)


def test_cutoffs_of_nothing(spark):
    assert cutoff.coverage_cutoffs(observations(spark, []), spark.createDataFrame([], "run_id string, fixed_coverage_target double")).count() == 0


SEL = "selection_id string, dataset_id string, selector_salt string, keep_fraction double, wave int, selected_item_ids array<string>, item_id string"


def test_sample_is_stable_even_and_keeps_the_record(spark):
    rng = random.Random(8)
    rows = [(f"x{n}", "d", None, None, None, 1 + n % 4) for n in range(4000)]
    recorded = [f"x{n}" for n in range(0, 4000, 40)] + ["gone"]
    sel = spark.createDataFrame([("s", "d", "salty-salt-1234567", 0.1, 1, recorded, "clash"), ("t", None, "x", 0.5, 1, None, "clash")], SEL)
    run = lambda rs: {r["item_id"] for r in sampling.stable_sample(items(spark, rs), sel).collect()}
    whole = run(rows)
    shuffled = rows + rows[:700]
    rng.shuffle(shuffled)
    assert run(shuffled) == whole
    assert set(recorded) - {"gone"} <= whole
    early = [r for r in rows if r[5] <= 2]
    assert run(early) <= whole
    assert run(early) == {i for i in whole if int(i[1:]) % 4 + 1 <= 2}
    later = [i for i in whole if int(i[1:]) % 4 + 1 > 1]
    assert len(later) == pytest.approx(300, abs=4)  # even coverage, far closer than chance
    assert run([]) == set() and run([(None, "d", None, None, None, 1), ("q", None, None, None, None, 1)]) == set()
    assert len(run([(f"n{i}", "d", None, None, None, None) for i in range(100)])) == pytest.approx(10, abs=2)


def test_chosen_items_stay_whatever_arrives(spark):
    rng = random.Random(10)
    ids = [f"wide-exam-{n:08d}" for n in range(400)] + [f"multi-rule-{n:08d}-n{k:02d}" for n in range(40) for k in range(1, 9)] + [f"imp-{rng.getrandbits(64):016x}" for _ in range(200)] + ["odd id", "änderung-7b"]
    rows = [(i, "d", None, None, None, rng.choice([1, 1, 2, 3, 4, None])) for i in ids]
    rng.shuffle(rows)
    sel = spark.createDataFrame([("s", "d", "salt-4711", 0.15, 1, [r[0] for r in rows if r[5] == 1][:30], "clash")], SEL)
    run = lambda rs: {r["item_id"] for r in sampling.stable_sample(items(spark, rs).repartition(3), sel).collect()}
    before, seen = set(), 0
    for end in (100, 101, 350, 700, len(rows)):  # arrivals of every wave and of none, in any order
        now = run(rows[:end])
        assert before <= now and not {r[0] for r in rows[:seen]} & (now - before)
        before, seen = now, end
    again = [(i, d, p, g, m, rng.choice([1, 2, None])) for i, d, p, g, m, _ in rng.sample(rows, 200)]  # deliveries under other waves
    assert before <= run(rows + again)
    late = [r for r in rows if r[5] != 1]
    assert len([i for i in before if i in {r[0] for r in late}]) / len(late) == pytest.approx(0.15, abs=0.04)


def test_published_numbers_are_only_extended(spark):
    rng = random.Random(11)
    rows = [(f"{rng.getrandbits(60):x}", rng.choice(["d", "e"]), None, None, None, rng.choice([1, 2, 3, None])) for _ in range(600)]
    sel = spark.createDataFrame([("s", "d", "a", 0.2, 0, None, "x"), ("t", "e", "b", 0.1, 0, None, "x")], SEL)
    numbers = spark.createDataFrame([], "dataset_id string, item_id string, seq bigint")
    known, chosen = {}, set()
    for end in (1, 200, 205, 600):
        got = sampling.extend_numbers(numbers, items(spark, rows[:end] + rows[:end])).collect()
        now = {(r["dataset_id"], r["item_id"]): r["seq"] for r in got}
        assert known.items() <= now.items() and len(got) == len(now) == end
        for d in ("d", "e"):
            assert sorted(n for (x, _), n in now.items() if x == d) == list(range(1, sum(x == d for x, _ in now) + 1))
        numbers, known = spark.createDataFrame([(*k, n) for k, n in now.items()], "dataset_id string, item_id string, seq bigint"), now
        sample = {r["item_id"] for r in sampling.stable_sample(items(spark, rows[:end]), sel, numbers).collect()}
        assert chosen <= sample
        chosen = sample
    n = sum(x == "d" for x, _ in known)
    assert len([i for i in chosen if ("d", i) in known]) == pytest.approx(0.2 * n, abs=3)


DOC = "doc_id bigint, text string, source string, n_tokens int, block int, size string, copy int"
TARGET = "source string, target_weight double, max_repeats int"


def test_mixture_meets_shares_and_caps(spark):
    rng = random.Random(9)
    docs = [(i, "some text", rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), rng.randint(5, 60), 1, "clash", 9) for i in range(3000)]
    docs += [(9001, "five plain words are here", "mid", None, 1, "x", 1), (9002, None, "mid", None, 1, "x", 1), (9003, "t", None, 50, 1, "x", 1), (9004, "t", "other", 50, 1, "x", 1), (9005, "t", "mid", 0, 1, "x", 1), (None, "t", "mid", 50, 1, "x", 1)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.25, 2), ("small", 0.25, 3), ("none", 0.1, 3), (None, 0.1, 1)], TARGET)
    df = spark.createDataFrame(docs, DOC)
    mix = mixing.mix(df, targets, shards=4)
    got = mix.collect()
    used = defaultdict(int)
    for r in got:
        used[r["doc_id"]] += 1
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(used[r["doc_id"]] <= caps[r["source"]] for r in got) and len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert not {9002, 9003, 9004, 9005} & set(used) and None not in used
    shares = {r["source"]: r for r in mixing.mix_shares(mix, targets).collect()}
    for s, w in {"big": 0.5, "mid": 0.25, "small": 0.25}.items():
        assert shares[s]["share"] == pytest.approx(w, abs=0.01)
    assert shares["none"]["tokens"] == 0
    per = defaultdict(int)
    for r in got:
        per[r["shard"]] += 1
    assert set(per) == {0, 1, 2, 3}
    orders = mixing.shuffled(mix).rdd.glom().map(lambda rs: [(r["shard"], r["order_key"]) for r in rs]).collect()
    assert all(o == sorted(o) for o in orders) and sum(map(len, orders)) == len(got)
    assert all(len([o for o in orders if s in {x for x, _ in o}]) == 1 for s in range(4))
    again = mixing.mix(df.repartition(6), targets, shards=4)
    assert mix.exceptAll(again).count() == 0
    assert mixing.mix(spark.createDataFrame([], DOC), targets).count() == 0


def test_a_missing_tokenizer_fails(spark):
    df = spark.createDataFrame([(1, "five plain words are here", "mid", None, 1, "x", 1)], DOC)
    with pytest.raises(Exception, match="no tokenizer"):
        mixing.count_tokens(df, "/nowhere/ranks.tiktoken").collect()


def test_splitting_tree_is_exact():
    counts = np.array([7, 0, 100, 33])
    parts = mixing.split_tree(np.random.default_rng(1), counts, 5)
    assert (parts.sum(axis=0) == counts).all() and abs(parts.sum(axis=1) - 28).max() <= 1 and (parts >= 0).all()
