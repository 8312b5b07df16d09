"""The exact-capacity stratified partition against brute force, and its query."""

import hashlib
import random
from collections import Counter, defaultdict

from tandemlab.operators import sampling
from tandemlab.plans import registry

SHARES = dict(zip(sampling.SPLITS, (0.4, 0.3, 0.3), strict=True))


def brute(rows, salt):
    h = lambda *x: hashlib.sha256("\0".join(x).encode()).digest()
    strata = defaultdict(list)
    for a, b, k in rows:
        strata[a, b].append(k)
    order = sorted((i, h(salt, "stratum", *s), k, s) for s, ks in strata.items() for i, k in enumerate(sorted(ks, key=lambda k: (h(salt, "row", k), k))))
    caps = {"development": int(len(rows) * 0.4), "certification": int(len(rows) * 0.3)}
    caps["test"] = len(rows) - sum(caps.values())
    total, mine, out = Counter(), defaultdict(Counter), {}
    for *_, k, s in order:
        n = sum(mine[s].values()) + 1
        free = [p for p in SHARES if total[p] < caps[p]]
        out[k] = min(free, key=lambda p: (abs(mine[s][p] + 1 - n * SHARES[p]), abs(total[p] + 1 - (len(out) + 1) * SHARES[p]), h(salt, "partition-tie", k, p)))
        mine[s][out[k]] += 1
        total[out[k]] += 1
    return out, caps


def test_exact_partition_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abcdé"), rng.choice("xyz"), f"k{i}") for i in range(457)]
    want, caps = brute(rows, "s")
    got = sampling.exact_partition(spark.createDataFrame(rows + rows[:20], "a string, b string, k string").repartition(5), ["a", "b"], "k", "s").collect()
    assert {r["k"]: r["split"] for r in got} == want and len(got) == len(rows)
    assert Counter(want.values()) == caps


def test_query_gives_every_part_a_split(spark, smallest):
    got = registry.QUERIES["d8_d9_greedy_partition"](spark, smallest).toPandas()
    n = spark.read.parquet(f"{smallest}/part.parquet").count()
    assert len(got) == n and got["split"].notna().all() and (got["split"] == "development").sum() == int(n * 0.4)
    assert 0 < got["sample_split"].notna().sum() <= n
