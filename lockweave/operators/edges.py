"""Order edges that come about through calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.plans.loop import apart


def interprocedural(sites: DataFrame, held: DataFrame, may: DataFrame, must: DataFrame) -> DataFrame:
    """component, m, line, callee, src, dst: each lock held at a call, before each lock the callee may take.

    Not for locks that are held at the call or on every entry of the caller.
    ``sites``: component, call, m, line, callee (synchronous); ``held``: call, held.
    """
    sites, held, must = apart(sites), apart(held), apart(must)
    taken = sites.join(may.select(F.col("m").alias("callee"), F.col("lock").alias("dst")), "callee")
    fresh = taken.join(held.select("call", F.col("held").alias("dst")), ["call", "dst"], "left_anti")
    fresh = fresh.join(must.select("m", F.col("lock").alias("dst")), ["m", "dst"], "left_anti")
    return fresh.join(held.select("call", F.col("held").alias("src")), "call").where("src <> dst").select("component", "m", "line", "callee", "src", "dst").distinct()


def method_edges(sites: DataFrame, held: DataFrame) -> DataFrame:
    """m, lock, callee: a call under locks, told by the last lock name in order."""
    last = held.groupBy("call").agg(F.max("held").alias("lock"))
    return apart(sites).join(last, "call").select("component", "m", "lock", "callee").distinct()
