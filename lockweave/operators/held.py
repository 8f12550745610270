"""Locks held at each point of straight-line code, and the order edges of acquisitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.plans.loop import apart, settle

#: Points of a method that are joined with its spans at a time.
STRETCH = 64


def spans(effects: DataFrame) -> DataFrame:
    """m, lock, after, upto: between which effects a lock is held (after < offset <= upto; upto null: to the end).

    A release of a lock that isn't held has no effect: with S the running sum of
    effects, the count is S - min(0, least S so far).
    """
    w = Window.partitionBy("m", "lock").orderBy("off")
    run = effects.withColumn("s", F.sum("d").over(w)).withColumn("after_next", F.lead("off").over(w))
    count = F.col("s") - F.least(F.lit(0), F.min("s").over(w))
    return run.withColumn("n", count).where("n > 0").select("m", "lock", F.col("off").alias("after"), F.col("after_next").alias("upto"))


def held_at(points: DataFrame, effects: DataFrame) -> DataFrame:
    """The rows of ``points`` (with m, off), one for each lock held just before, as column held.

    A method's offsets are cut into stretches of about ``STRETCH`` points, and points
    meet only the spans that reach into their stretch: a method that holds a third of
    all rows is many small joins, not one of all its points with all its spans.
    """
    size = points.groupBy("m").agg(F.min("off").alias("lo"), F.max("off").alias("hi"), F.count("*").alias("n"))
    wide = F.ceil((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / STRETCH))
    size = apart(settle(size.select("m", "lo", "hi", wide.alias("wide")), "sizes"))
    at = lambda off: F.floor((off - F.col("lo")) / F.col("wide"))
    placed = points.join(size, "m").withColumn("stretch", at(F.col("off"))).drop("lo", "hi", "wide")
    s = spans(effects).join(size, "m").where("after < hi and (upto is null or upto >= lo)")
    over = F.sequence(at(F.greatest("after", "lo")), at(F.least(F.coalesce("upto", "hi"), "hi")))
    s = s.select(F.col("m").alias("hm"), F.col("lock").alias("held"), "after", "upto", F.explode(over).alias("part"))
    inside = (F.col("m") == F.col("hm")) & (F.col("stretch") == F.col("part")) & (F.col("off") > F.col("after")) & (F.col("upto").isNull() | (F.col("off") <= F.col("upto")))
    return placed.join(s, inside).drop("hm", "part", "stretch", "after", "upto")


def acquires(enters: DataFrame, effects: DataFrame) -> DataFrame:
    """Enters of locks that aren't held yet; a re-entrant one acquires nothing."""
    again = held_at(enters, effects).where("held = lock").select("m", "off")
    return enters.join(again, ["m", "off"], "left_anti")


def reentrant(enters: DataFrame, effects: DataFrame) -> DataFrame:
    return held_at(enters, effects).where("held = lock").drop("held")


def order_edges(enters: DataFrame, effects: DataFrame) -> DataFrame:
    """For each acquisition an edge from every lock held to the new one; guard: all of them, sorted.

    Columns: those of ``enters`` without lock, then src, dst, guard.
    """
    held = held_at(acquires(enters, effects), effects)
    whole = Window.partitionBy("m", "off")
    guard = F.array_sort(F.array_union(F.collect_set("held").over(whole), F.array("lock")))
    return held.withColumn("guard", guard).withColumnsRenamed({"held": "src", "lock": "dst"})
