"""Problem 2: families of related items and splits that keep each family whole.

Defined results: a null or blank group_id, scenario or partition names nothing; broken metadata has no scenario; an item delivered several
times has the groups, scenarios and partitions of all its rows; items with a null item_id are left out; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlab.operators.graph import components
from tandemlab.sources.tables import materialize

#: Datasets whose item_ids name the group: "<group>-n<digits>" or "<group>-v<digits>".
GROUPED = ("multi-rule", "style-code", "tool-turns")
SPLITS = ("development", "certification", "test")


def group_key(raw: Column) -> Column:
    """One spelling for a group: trimmed, lower case, dashes for other separators, its number without leading zeros; null when blank."""
    clean = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")), r"[^\p{L}\p{N}]+", "-")
    clean = F.regexp_replace(clean, r"^-+|-+$", "")
    number = F.regexp_extract(clean, r"^(.*?)-?0*(\d+)$", 2)
    named = F.when(number != "", F.concat_ws("-", F.regexp_extract(clean, r"^(.*?)-?0*(\d+)$", 1), number)).otherwise(clean)
    return F.when(named != "", named)


def item_group(datasets: tuple[str, ...] = GROUPED) -> Column:
    """The group of a row: of group_id, or, where that names nothing in ``datasets``, of the item_id."""
    stem = F.regexp_extract(F.col("item_id"), r"^(.+?)-[nv]\d+$", 1)
    from_id = F.when(F.col("dataset_id").isin(*datasets) & (stem != ""), group_key(stem))
    return F.coalesce(group_key(F.col("group_id")), from_id)


def item_keys(items: DataFrame) -> DataFrame:
    """(item_id, dataset_id, keys, partitions, label): one row per item; keys are 64-bit names of its groups and scenarios, or of itself."""
    scenario = F.trim(F.get_json_object("metadata", "$.scenario"))
    rows = items.filter(F.col("item_id").isNotNull()).select(
        "item_id", "dataset_id", F.trim("partition").alias("partition"),
        F.xxhash64(F.lit("group"), item_group()).alias("g"), item_group().isNotNull().alias("has_g"),
        F.xxhash64(F.lit("scenario"), scenario).alias("s"), (F.length(scenario) > 0).alias("has_s"),
    )
    agg = rows.groupBy("item_id").agg(
        F.min("dataset_id").alias("dataset_id"),
        F.collect_set(F.when(F.col("has_g"), F.col("g"))).alias("g"), F.collect_set(F.when(F.col("has_s"), F.col("s"))).alias("s"),
        F.collect_set(F.when(F.col("partition") != "", F.col("partition"))).alias("partitions"),
    )
    keys = F.sort_array(F.array_union("g", "s"))
    own = F.array(F.xxhash64(F.lit("item"), F.col("item_id")))
    return agg.select("item_id", "dataset_id", F.when(F.size(keys) > 0, keys).otherwise(own).alias("keys"), "partitions")


def families(items: DataFrame) -> DataFrame:
    """(item_id, dataset_id, family, partitions): family is the component of the graph of groups and scenarios that items link.

    Only distinct key pairs enter the graph, so a group with a third of all rows is a few edges; items without a second key never do.
    """
    keyed = materialize(item_keys(items))
    edges = keyed.filter(F.size("keys") > 1).select(F.col("keys")[0].alias("u"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("v"))
    comp = components(edges)
    first = keyed.withColumn("node", F.col("keys")[0])
    return first.join(comp, "node", "left").select("item_id", "dataset_id", F.coalesce("component", "node").alias("family"), "partitions")


def torn_items(items: DataFrame) -> DataFrame:
    """(item_id): every item of a family that stands in two or more delivered partitions."""
    fam = families(items)
    torn = (
        fam.select("family", F.explode("partitions").alias("p"))
        .groupBy("family").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
        .filter(F.col("lo") != F.col("hi")).select("family")
    )
    return fam.join(torn, "family", "left_semi").select("item_id")


def _place(families_: list[tuple[int, dict[str, int]]], wanted: dict[str, dict[str, float]]) -> dict[int, str]:
    """Iterative stratification of whole families; ``wanted`` is what each split still needs of each label and is brought up to date.

    The label with the fewest outstanding items comes first, its families largest first; each goes to the split that needs most of that
    label, then most of all labels. Ties go by the family's number and the order of SPLITS.
    """
    left: dict[str, int] = defaultdict(int)
    by_label: dict[str, list[tuple[int, dict[str, int]]]] = defaultdict(list)
    for fam in families_:
        for label, n in fam[1].items():
            left[label] += n
            by_label[label].append(fam)
    for label, fams in by_label.items():
        fams.sort(key=lambda f: (-f[1][label], f[0]))
    placed: dict[int, str] = {}
    while left:
        label = min(left, key=lambda x: (left[x], x))
        for fid, vector in by_label[label]:
            if fid in placed:
                continue
            best = max(SPLITS, key=lambda s: (wanted[s].get(label, 0.0), sum(wanted[s].get(x, 0.0) for x in vector), -SPLITS.index(s)))
            placed[fid] = best
            for x, n in vector.items():
                wanted[best][x] = wanted[best].get(x, 0.0) - n
                if x in left:
                    left[x] -= n
        del left[label]
    return placed


def assign_splits(items: DataFrame, targets: DataFrame, shard_families: int = 5000, large_share: float = 0.002, most_large: int = 50_000) -> DataFrame:
    """(item_id, dataset_id, family, split): whole families placed by grouped iterative stratification over per-dataset counts.

    Families that hold more than ``large_share`` of a dataset's items and more than one in ``most_large`` of all items are placed first, on
    the driver: at most ``most_large`` of them exist, however many datasets there are. All others are hashed into shards of about ``shard_families`` families, and each shard places its own against the rest of
    the targets in proportion to what it holds, so the work is parallel and the deviations of shards cancel. Datasets without a target
    row share the mean of the targets (thirds when there is none).
    """
    fam = materialize(families(items))
    vectors = materialize(fam.groupBy("family", F.coalesce("dataset_id", F.lit("")).alias("label")).agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in vectors.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row per dataset
    asked = {r["dataset_id"]: {s: float(r[s] or 0) for s in SPLITS} for r in targets.filter(F.col("dataset_id").isNotNull()).select("dataset_id", *SPLITS).collect()}
    mean = {s: sum(a[s] for a in asked.values()) / len(asked) if asked else 1 / 3 for s in SPLITS}
    share = {label: asked.get(label, mean) for label in totals}
    spark = items.sparkSession
    floor = spark.createDataFrame([(k, max(1.0, large_share * n, sum(totals.values()) / most_large)) for k, n in totals.items()], "label string, floor double")
    large_ids = vectors.join(F.broadcast(floor), "label").filter(F.col("n") > F.col("floor")).select("family").distinct()
    big: dict[int, dict[str, int]] = defaultdict(dict)
    for r in vectors.join(large_ids, "family", "left_semi").collect():
        big[r["family"]][r["label"]] = r["n"]
    wanted = {s: {k: share[k][s] * n for k, n in totals.items()} for s in SPLITS}
    placed = _place(sorted(big.items()), wanted)
    large = spark.createDataFrame(list(placed.items()) or [], "family bigint, split string")

    small = vectors.join(large.select("family"), "family", "left_anti")
    n_small = small.select("family").distinct().count()
    shards = max(1, round(n_small / shard_families))
    held = {k: n - sum(v.get(k, 0) for v in big.values()) for k, n in totals.items()}

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, dict[str, int]] = defaultdict(dict)
        for fid, label, n in zip(pdf["family"], pdf["label"], pdf["n"], strict=True):
            own[int(fid)][label] = int(n)
        here = pdf.groupby("label")["n"].sum().to_dict()
        need = {s: {k: wanted[s][k] * n / held[k] for k, n in here.items()} for s in SPLITS}
        done = _place(sorted(own.items()), need)
        return pd.DataFrame({"family": list(done), "split": list(done.values())})

    rest = small.withColumn("shard", F.pmod(F.xxhash64("family", F.lit(17)), F.lit(shards))).groupBy("shard").applyInPandas(place, "family bigint, split string")
    return fam.join(large.unionByName(rest), "family").select("item_id", "dataset_id", "family", "split")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(dataset_id, split, items, share, target, families): what each dataset's splits hold against split_targets."""
    held = assigned.groupBy("dataset_id", "split").agg(F.count("*").alias("items"), F.approx_count_distinct("family").alias("families"))
    total = assigned.groupBy("dataset_id").agg(F.count("*").alias("total"))
    want = targets.select("dataset_id", F.explode(F.create_map(*[x for s in SPLITS for x in (F.lit(s), F.col(s))])).alias("split", "target"))
    joined = held.join(total, "dataset_id").join(want, ["dataset_id", "split"], "left")
    return joined.select("dataset_id", "split", "items", F.round(F.col("items") / F.col("total"), 6).alias("share"), "target", "families")
