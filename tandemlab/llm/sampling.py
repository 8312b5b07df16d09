"""Problem 5: a reproducible sample that stays as data grow, by golden-ratio selection over persistent sequence numbers.

Defined results: repeated rows of an item count once; a null wave is later than any recorded draw; items with a null item_id or dataset_id,
and datasets without a selection, are left out; an empty table gives an empty sample; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlab.operators.ranking import bucketed_rank

#: The golden ratio's fraction of 2^32: a multiple of it, modulo 2^32, is the fractional multiple in whole numbers, alike on every engine.
GOLDEN = 2654435769
SPAN = 1 << 32
#: Numbers of members within a group lie this far apart from group to group.
STRIDE = 65536


def sequence_number(item_id: Column) -> Column:
    """The persistent number of an item, a function of its id alone: the serial at the end of the id, or group x 65536 + member where the id
    ends in a group's serial and '-n' or '-v' with the member's; of ids without a serial 32 bits of their md5.
    """
    serial = r"^(?:.*-)?[A-Za-z]*(\d{1,15})(?:-[nv](\d{1,15}))?$"
    first, member = F.regexp_extract(item_id, serial, 1), F.regexp_extract(item_id, serial, 2)
    hashed = F.conv(F.substring(F.md5(item_id), 1, 8), 16, 10).cast("bigint")
    grouped = (first.try_cast("bigint") % (1 << 40)) * STRIDE + member.try_cast("bigint")
    return F.when(first == "", hashed).when(member == "", first.try_cast("bigint")).otherwise(grouped)


def shift_of(salt: Column) -> Column:
    """The fixed random shift of a salt, below 2^32."""
    return F.conv(F.substring(F.md5(F.coalesce(salt, F.lit(""))), 1, 8), 16, 10).cast("bigint")


def point(seq: Column, salt: Column) -> Column:
    """The fractional multiple of a number in [0, 1)."""
    return ((seq % (1 << 31)) * GOLDEN + shift_of(salt)) % SPAN / F.lit(float(SPAN))


def extend_numbers(numbers: DataFrame, items: DataFrame) -> DataFrame:
    """``numbers`` (dataset_id, item_id, seq), with the items it lacks appended: they follow the dataset's highest number in the order of their hashes.

    For ids without serials: published once and only ever extended, the numbers of known items never change, whatever arrives.
    """
    have = numbers.select("dataset_id", "item_id", "seq")
    asked = items.filter(F.col("item_id").isNotNull() & F.col("dataset_id").isNotNull()).select("dataset_id", "item_id").distinct()
    new = asked.join(have, ["dataset_id", "item_id"], "left_anti").withColumn("h", F.md5("item_id"))
    ranked = bucketed_rank(new, ["dataset_id"], F.substring("h", 1, 3), [F.col("h"), F.col("item_id")], "r")
    last = have.groupBy("dataset_id").agg(F.max("seq").alias("last"))  # one row per dataset
    added = ranked.join(last, "dataset_id", "left").select("dataset_id", "item_id", (F.coalesce("last", F.lit(0)) + F.col("r")).alias("seq"))
    return have.unionByName(added)


def stable_sample(items: DataFrame, selections: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(dataset_id, item_id, wave, seq, origin): the selected items; origin is 'recorded' or 'drawn'.

    An item's number is ``sequence_number`` of its id, or that of the published ``numbers``. It is drawn where frac(seq x golden + shift) <
    keep_fraction, shift being fixed by the salt; any run of consecutive numbers then holds keep_fraction of itself but for a few items, and
    no other item, row, wave or layout has a say in it. In waves up to that of a recorded draw the recorded item ids are the sample; of
    several records of one dataset the latest wave counts and all recorded ids are kept. An item counts as late if any of its rows is later
    than the record, so another delivery never takes it out.
    """
    sel = selections.filter(F.col("dataset_id").isNotNull() & F.col("keep_fraction").isNotNull()).groupBy("dataset_id").agg(
        F.max_by("selector_salt", F.struct(F.coalesce("wave", F.lit(0)), "selection_id")).alias("salt"),
        F.max_by("keep_fraction", F.struct(F.coalesce("wave", F.lit(0)), "selection_id")).alias("keep"),
        F.max(F.when(F.col("selected_item_ids").isNotNull(), F.col("wave"))).alias("drawn_wave"),
    )
    recorded = selections.select("dataset_id", F.explode("selected_item_ids").alias("item_id")).filter(F.col("dataset_id").isNotNull() & F.col("item_id").isNotNull()).distinct().withColumn("rec", F.lit(True))
    one = items.filter(F.col("item_id").isNotNull() & F.col("dataset_id").isNotNull()).groupBy("dataset_id", "item_id").agg(
        F.min("wave").alias("wave"), F.max("wave").alias("last_wave"), F.bool_or(F.col("wave").isNull()).alias("no_wave")
    )
    numbered = one.withColumn("seq", sequence_number(F.col("item_id"))) if numbers is None else one.join(numbers.select("dataset_id", "item_id", "seq"), ["dataset_id", "item_id"])
    flagged = numbered.join(sel, "dataset_id").join(recorded, ["dataset_id", "item_id"], "left")
    late = F.col("drawn_wave").isNull() | F.col("no_wave") | (F.col("last_wave") > F.col("drawn_wave"))
    chosen = F.col("rec") | (late & (point(F.col("seq"), F.col("salt")) < F.col("keep")))
    return flagged.filter(chosen).select("dataset_id", "item_id", "wave", "seq", F.when(F.col("rec"), "recorded").otherwise("drawn").alias("origin"))
