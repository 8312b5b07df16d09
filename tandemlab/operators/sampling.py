"""Deterministic splits, windows, anchors, shards and design expansion: everything is a rank of a salted hash, never of a random number."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.operators.ranking import bucketed_rank

SPLITS = ("development", "certification", "test")


def salted(salt: str, key: Column) -> Column:
    """sha256 of salt and key joined by NUL, as hex: its order is that of the digest."""
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), key), 256)


def ranked(ids: DataFrame, by: list[str], key: str, salt: str) -> DataFrame:
    """``ids`` with rank (from 1) by (salted hash, key) within ``by``; ranked by hash buckets, so that no task holds a whole group."""
    h = ids.withColumn("__h", salted(salt, F.col(key)))
    return bucketed_rank(h, by, F.substring("__h", 1, 3), [F.col("__h"), F.col(key)], "rank").drop("__h")


def split_counts(sizes: DataFrame, shares: tuple[float, float, float]) -> DataFrame:
    """``sizes`` (.., n) with c0, c1, c2: largest-remainder counts of the three splits; equal remainders go to the earlier split."""
    exact = [F.col("n") * F.lit(s) for s in shares]
    base = [F.floor(e) for e in exact]
    rest = [e - b for e, b in zip(exact, base, strict=True)]
    left = F.col("n") - sum(base, F.lit(0))
    out = sizes
    for i in range(3):
        before = sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(3) if j != i)
        out = out.withColumn(f"c{i}", (base[i] + (before < left).cast("int")).cast("bigint"))
    return out


def deterministic_split(ids: DataFrame, by: list[str], key: str, salt: str, shares: tuple[float, float, float]) -> DataFrame:
    """(by, key, split): distinct keys ranked by salted hash and cut at largest-remainder counts."""
    distinct = ids.select(*by, key).distinct()
    counts = split_counts(distinct.groupBy(*by).agg(F.count("*").alias("n")), shares)
    joined = ranked(distinct, by, key, salt).join(counts, by)
    kind = F.when(F.col("rank") <= F.col("c0"), SPLITS[0]).when(F.col("rank") <= F.col("c0") + F.col("c1"), SPLITS[1]).otherwise(SPLITS[2])
    return joined.select(*by, key, kind.alias("split"))


def window(ids: DataFrame, by: list[str], key: str, salt: str, offset: int, limit: int) -> DataFrame:
    """The keys of ranks offset + 1 to offset + limit; groups that are too small for it have none."""
    sized = ids.join(ids.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") >= offset + limit).drop("__n"), by)
    return ranked(sized, by, key, salt).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).drop("rank")


def subselection(windowed: DataFrame, by: list[str], key: str, salt: str, limit: int) -> DataFrame:
    """Ranks again within a window by a second salt and keeps ``limit``: a strict subset of the window."""
    return ranked(windowed, by, key, salt).filter(F.col("rank") <= limit).drop("rank")


def balanced_anchors(variants: DataFrame, by: list[str], group: str, level: str, item: str, salt: str) -> DataFrame:
    """(by, group, level, item): one variant per group; groups in salted order take the levels in turn.

    Only groups that have every level of their dataset once take part, so the counts of levels differ by one at most.
    """
    one = variants.groupBy(*by, group, level).agg(F.min(item).alias(item), F.count("*").alias("__c"))
    levels = one.groupBy(*by).agg(F.sort_array(F.collect_set(level)).alias("__levels"))  # a handful of levels per dataset
    whole = one.groupBy(*by, group).agg(F.count("*").alias("__k"), F.max("__c").alias("__m")).join(levels, by).filter((F.col("__k") == F.size("__levels")) & (F.col("__m") == 1))
    turn = ranked(whole.select(*by, group, "__levels"), by, group, salt)
    picked = turn.withColumn(level, F.element_at("__levels", ((F.col("rank") - 1) % F.size("__levels") + 1).cast("int")))
    return picked.select(*by, group, level).join(one.select(*by, group, level, item), [*by, group, level])


def shard(key: Column, shards: int, salt: str = "shard-v1") -> Column:
    """The shard of a key from 15 hex digits of its salted hash; shards of 2n nest in shards of n when n divides it."""
    return F.conv(F.substring(salted(salt, key), 1, 15), 16, 10).cast("bigint") % shards


def balanced_sample(items: DataFrame, stratum: str, level: str, key: str, salt: str, size: int) -> DataFrame:
    """``size`` keys per stratum, each draw from the level drawn least so far: keys by (rank within their level, hash)."""
    per = ranked(items.select(stratum, level, key), [stratum, level], key, salt).withColumnRenamed("rank", "__turn")
    order = Window.partitionBy(stratum).orderBy("__turn", salted(salt, F.col(key)), key)
    return per.filter(F.col("__turn") <= size).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= size).select(stratum, level, key)


def greedy_partition(items: DataFrame, stratum: str, level: str, key: str, salt: str, quotas: tuple[int, int, int]) -> DataFrame:
    """(stratum, level, key, split): within each stratum in hash order, each key goes to the open split with the fewest of its level, then the emptiest.

    Sequential by nature: one grouped map per stratum over a sample of sum(quotas) keys, which bounds every group.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {s: 0 for s in SPLITS}
        by_level: dict[tuple[str, object], int] = {}
        out = []
        for lv, k in pdf.sort_values(["__h", key])[[level, key]].itertuples(index=False):
            free = [s for s, q in zip(SPLITS, quotas, strict=True) if held[s] < q]
            if not free:
                break
            s = min(free, key=lambda x: (by_level.get((x, lv), 0), held[x] / quotas[SPLITS.index(x)], SPLITS.index(x)))
            held[s] += 1
            by_level[s, lv] = by_level.get((s, lv), 0) + 1
            out.append((pdf[stratum].iloc[0], lv, k, s))
        return pd.DataFrame(out, columns=[stratum, level, key, "split"])

    types = dict(items.dtypes)
    sample = balanced_sample(items, stratum, level, key, salt, sum(quotas)).withColumn("__h", salted(salt, F.col(key)))
    return sample.groupBy(stratum).applyInPandas(place, f"{stratum} {types[stratum]}, {level} {types[level]}, {key} {types[key]}, split string")


def exact_partition(rows: DataFrame, strata: list[str], key: str, salt: str, fractions: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(strata, key, split): every key has a split, with exact capacities over all rows and each stratum near ``fractions``.

    Strata take turns in hash order, their keys by salted hash; a key goes to the open split that deviates least from its share of the
    stratum, then of all rows so far, then by hash. Each choice depends on all before it, so one task reads the sorted rows as a stream; it
    holds the counts of the strata only, and ranks and order are made before it on many tasks. A null in a stratum counts as empty.
    """

    def digest(*parts: str) -> bytes:
        return hashlib.sha256("\0".join(parts).encode()).digest()

    ids = rows.filter(F.col(key).isNotNull()).select(*strata, key).distinct()
    n = ids.count()
    caps = [int(n * f) for f in fractions[:2]]
    caps.append(n - sum(caps))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, done, held = [0, 0, 0], 0, {}
        for pdf in batches:
            splits = []
            for k, stratum in zip(pdf["__id"], pdf["__s"], strict=True):
                mine = held.setdefault(stratum, [0, 0, 0])
                turn = sum(mine) + 1
                i = min(
                    (i for i in range(3) if total[i] < caps[i]),
                    key=lambda i: (abs(mine[i] + 1 - turn * fractions[i]), abs(total[i] + 1 - (done + 1) * fractions[i]), digest(salt, "partition-tie", k, SPLITS[i])),
                )
                mine[i] += 1
                total[i] += 1
                done += 1
                splits.append(SPLITS[i])
            yield pdf[[*strata, key]].assign(split=splits)

    types = dict(ids.dtypes)
    parts = F.concat_ws("\0", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata])
    named = ids.withColumn("__s", F.sha2(F.concat(F.lit(salt + "\0stratum\0"), parts), 256)).withColumn("__id", F.col(key).cast("string"))
    order = ranked(named, ["__s"], "__id", salt + "\0row").repartition(1).sortWithinPartitions("rank", "__s", "__id")
    return order.mapInPandas(place, ", ".join(f"{c} {types[c]}" for c in [*strata, key]) + ", split string")


def expand_design(items: DataFrame, conditions: list[str], seeds: list[int], reference: str, report_only: list[str] = (), coupled_only: bool = False) -> DataFrame:
    """``items`` x conditions x seeds x readouts with their roles; the plan side is literals, so no join is planned.

    Readouts of an answer condition: its own (coupled); unless ``coupled_only``, also the standard one (the reference), and the report-only
    ones on the reference condition.
    """
    answer = F.explode(F.array(*[F.lit(c) for c in conditions]))
    spread = items.withColumn("answer_condition", answer).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    on_reference = F.col("answer_condition") == reference
    reads = [F.col("answer_condition")] if coupled_only else [F.col("answer_condition"), F.lit(reference), *[F.when(on_reference, F.lit(r)) for r in report_only]]
    cells = spread.withColumn("readout", F.explode(F.array_distinct(F.array_compact(F.array(*reads)))))
    coupled, standard = F.col("readout") == F.col("answer_condition"), F.col("readout") == reference
    roles = F.array_compact(F.array(F.when(coupled, F.lit("coupled")), F.when(standard & F.lit(not coupled_only), F.lit("standardized")), F.when(~coupled & ~standard, F.lit("report_only"))))
    return cells.withColumn("roles", F.array_join(roles, "+"))
