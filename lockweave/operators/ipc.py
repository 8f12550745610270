"""Locks held across a process boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.operators.fixpoint import chains, reaching

#: Sites shown per lock.
SAMPLE = 6


def reach(calls: DataFrame) -> DataFrame:
    """m: methods that make a transaction, whatever its call's flag, or lead to one over synchronous calls."""
    return reaching(calls.where("not is_async").select("m", "callee"), calls.where("transact").select("m").distinct())


def outgoing(calls: DataFrame, held: DataFrame, reached: DataFrame) -> DataFrame:
    """component, m, line, callee, direct, held: synchronous calls under a lock that are or lead to a transaction.

    ``held``: m, off, held.  Holders of generated proxies should be left out by the
    caller.  Rows that agree in method, line and locks are one.
    """
    under = held.groupBy("m", "off").agg(F.array_sort(F.collect_set("held")).alias("held"))
    leads = reached.select(F.col("m").alias("callee"), F.lit(True).alias("leads"))
    sites = calls.where("not is_async").join(under, ["m", "off"]).join(leads, "callee", "left").where("transact or leads")
    rank = F.row_number().over(Window.partitionBy("component", "m", "line", "held").orderBy(F.desc("transact"), "callee"))
    return sites.withColumn("rank", rank).where("rank = 1").select("component", "m", "line", "callee", F.col("transact").alias("direct"), "held")


def with_chains(sites: DataFrame, calls: DataFrame, reached: DataFrame, most: int = 24) -> DataFrame:
    """``sites`` with path: the shortest chain from the callee to a method that makes a transaction (a direct one: the holder alone)."""
    ends = calls.where("transact").select("m").distinct()
    live = calls.where("not is_async").select("m", "callee").join(reached.select(F.col("m").alias("callee")), "callee", "left_semi")
    ways = chains(live, sites.where("not direct").select(F.col("callee").alias("m")), ends, most)
    joined = sites.join(ways.select(F.col("m").alias("callee"), "path"), "callee", "left")
    return joined.withColumn("path", F.when(F.col("direct"), F.array("m")).otherwise(F.concat(F.array("m"), "path")))


def incoming(entries: DataFrame, may: DataFrame, sites: DataFrame) -> DataFrame:
    """component, m, locks, high: locks an entry method may take; high if it holds one across an outgoing transaction itself."""
    locks = may.groupBy("m").agg(F.array_sort(F.collect_set("lock")).alias("locks"))
    holder = sites.select("m").distinct().withColumn("high", F.lit(True))
    return entries.select("component", "m").join(locks, "m").join(holder, "m", "left").select("component", "m", "locks", F.coalesce("high", F.lit(False)).alias("high"))


def by_lock(sites: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """component, lock, sites, rank, shown: how many places hold a lock across a transaction, most first, with a sample."""
    each = sites.select("component", F.explode("held").alias("lock"), "m", "line").distinct()
    counted = each.groupBy("component", "lock").agg(F.count("*").alias("sites"))
    some = each.withColumn("r", F.row_number().over(Window.partitionBy("component", "lock").orderBy("m", "line"))).where(F.col("r") <= sample)
    shown = some.groupBy("component", "lock").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "line"))), lambda x: F.concat_ws(":", x["m"].cast("string"), x["line"].cast("string"))), ",").alias("shown"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("sites"), "lock"))
    return counted.withColumn("rank", rank.cast("long")).join(shown, ["component", "lock"])


def keep(rows: DataFrame, locks: str, lock: str | None = None, holder: str | None = None) -> DataFrame:
    """Rows whose method has ``holder`` in its name and a lock of whose column ``locks`` has ``lock``; what isn't given passes."""
    if lock is not None:
        rows = rows.where(F.exists(locks, lambda h: F.contains(h, F.lit(lock))))
    if holder is not None:
        rows = rows.where(F.contains(F.col("mkey").cast("string"), F.lit(holder)))
    return rows


DIRECTIONS = {"out": "out", "outgoing": "out", "in": "in", "incoming": "in", "both": "both"}


def direction(text: str) -> str:
    if text not in DIRECTIONS:
        raise ValueError(f"direction is out, in or both, not {text!r}")
    return DIRECTIONS[text]
