"""Fields that always name the same lock as another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.plans.loop import settle

#: Steps that an alias is followed.
HOPS = 6


def unique(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value where all facts of a key agree and none is unknown."""
    whole = facts.groupBy(*key).agg(F.count_if(F.col(value).isNull()).alias("unknown"), F.min(value).alias("a"), F.max(value).alias("b"))
    return whole.where("unknown = 0 and a = b").select(*key, F.col("a").alias(value))


def follow(aliases: DataFrame, hops: int = HOPS) -> DataFrame:
    """name, target, hops: where an alias leads after at most ``hops`` steps; a step to itself ends it."""
    step = aliases.where("name <> target").select(F.col("name").alias("target"), F.col("target").alias("next"))
    at = settle(aliases.where("name <> target").select("name", "target", F.lit(1).cast("long").alias("hops")), "alias")
    for _ in range(hops - 1):
        moved = at.join(step, "target", "left")
        at = settle(moved.select("name", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.col("next").isNotNull().cast("long")).alias("hops")), "alias")
    return at


def canonical(locks: DataFrame, followed: DataFrame, column: str = "lock") -> DataFrame:
    """``locks`` with names replaced by what they lead to."""
    to = followed.select(F.col("name").alias(column), "target")
    return locks.join(to, column, "left").withColumn(column, F.coalesce("target", column)).drop("target")
