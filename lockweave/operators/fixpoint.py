"""Recursive rules over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.plans.loop import apart, grow, settle

MAY_CAP, MAY_ROUNDS = 96, 25


def may_acquire(direct: DataFrame, calls: DataFrame, cap: int | None = MAY_CAP, rounds: int = MAY_ROUNDS) -> DataFrame:
    """m, lock: locks that a method or anything it calls synchronously may take.

    ``direct``: m, lock; ``calls``: m, callee.  A method's seeds aren't capped; what
    calls add is, by name within a round, at ``cap`` locks a method in all.
    """
    edge = apart(settle(calls.select("m", "callee").distinct(), "calls"))
    known = delta = settle(direct.select("m", "lock").distinct(), "may")
    for _ in range(rounds):
        news = delta.select(F.col("m").alias("callee"), "lock").join(edge, "callee").select("m", "lock").distinct()
        news = apart(news).join(known, ["m", "lock"], "left_anti")
        if cap is not None:
            full = known.groupBy("m").agg(F.count("*").alias("n"))
            rank = F.row_number().over(Window.partitionBy("m").orderBy("lock"))
            news = apart(news.withColumn("r", rank)).join(full, "m", "left").where(F.col("r") + F.coalesce("n", F.lit(0)) <= cap).select("m", "lock")
        delta = settle(news, "may")
        if delta.isEmpty():
            break
        known = known.union(delta)
    return known


def must_entry(methods: DataFrame, calls: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """m, lock: locks held on every way into a method from the roots.

    ``calls``: call, m, callee (synchronous); ``held``: call, held; ``roots``: m.
    Computed as its dual: a lock is missing at a method if some root reaches it over
    calls that don't hold the lock -- a least fixpoint, unlike the meet itself.
    Methods that no root reaches have none.  Rows are pairs of a method and a lock that
    some call on a way into it holds, never all locks of a root.
    """
    edge = apart(settle(calls.select("call", "m", "callee"), "calls"))
    have = apart(settle(held.select("call", F.col("held").alias("lock")).distinct(), "held"))
    top = apart(settle(roots.select("m").distinct(), "roots"))
    reached = grow(top, lambda d: d.join(edge, "m").select(F.col("callee").alias("m")), name="reached")
    # only what a call on some way in holds can be held on all; any other lock is missing without a row
    some = edge.join(reached, "m", "left_semi").join(have, "call").select(F.col("callee").alias("m"), "lock")
    passed = apart(settle(grow(some, lambda d: d.join(edge, "m").select(F.col("callee").alias("m"), "lock"), name="passed"), "passed"))
    live = edge.join(reached, "m", "left_semi")
    into = passed.withColumnRenamed("m", "callee").join(live, "callee").join(have, ["call", "lock"], "left_anti")
    bare = into.join(passed, ["m", "lock"], "left_anti").select(F.col("callee").alias("m"), "lock")
    lost = bare.union(passed.join(top, "m", "left_semi").select("m", "lock"))
    missing = grow(lost, lambda d: d.join(edge, "m").join(have, ["call", "lock"], "left_anti").select(F.col("callee").alias("m"), "lock"), name="missing")
    return passed.join(missing, ["m", "lock"], "left_anti")


def reaching(calls: DataFrame, seeds: DataFrame) -> DataFrame:
    """m: the seeds and all that lead to them over ``calls`` (m, callee)."""
    edge = settle(calls.select("m", "callee").distinct(), "calls")
    return grow(seeds.select("m"), lambda d: d.withColumnRenamed("m", "callee").join(edge, "callee").select("m"), name="reach")


def chains(calls: DataFrame, starts: DataFrame, ends: DataFrame, most: int = 24) -> DataFrame:
    """m, path: the shortest chain of calls from each start to an end (least names on ties), or the start alone.

    ``calls`` should hold edges between methods that reach an end; at most ``most`` steps.
    """
    edge = settle(calls.select("m", "callee").distinct(), "calls")
    last = settle(ends.select(F.col("m").alias("node")).distinct(), "ends")
    seen = settle(starts.select("m").distinct().select("m", F.col("m").alias("node"), F.array("m").alias("path")), "paths")
    front, found = seen, None
    for i in range(most + 1):
        hits = settle(front.join(last, "node", "left_semi").groupBy("m").agg(F.min("path").alias("path")), "hits")
        found = hits if found is None else found.union(hits)
        if i == most:
            break
        open_ = front.join(hits.select("m"), "m", "left_anti")
        news = open_.join(edge.withColumnRenamed("m", "node"), "node").groupBy("m", F.col("callee").alias("node")).agg(F.min(F.concat("path", F.array("callee"))).alias("path"))
        front = settle(news.join(seen, ["m", "node"], "left_anti"), "paths")
        if front.isEmpty():
            break
        seen = seen.union(front)
    alone = starts.select("m").distinct().join(found, "m", "left_anti").select("m", F.array("m").alias("path"))
    return found.union(alone)
