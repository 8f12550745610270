"""Fields whose inferred guard some access misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.plans.loop import apart

#: Violations listed per field; writes and percentage of guarded writes that a report asks for.
LISTED, MIN_WRITES, MIN_COVERAGE = 16, 2, 66


def guarded(accesses: DataFrame, held: DataFrame, must: DataFrame | None = None) -> DataFrame:
    """``accesses`` (component, m, off, field, write) with guards: locks held there, and those held on entry."""
    local = held.groupBy("m", "off").agg(F.collect_set("held").alias("local"))
    with_local = apart(accesses).join(local, ["m", "off"], "left")
    none = F.array().cast("array<string>")
    if must is None:
        return with_local.withColumn("guards", F.array_sort(F.coalesce("local", none))).drop("local")
    entry = must.groupBy("m").agg(F.collect_set("lock").alias("entry"))
    return with_local.join(apart(entry), "m", "left").withColumn("guards", F.array_sort(F.array_union(F.coalesce("local", none), F.coalesce("entry", none)))).drop("local", "entry")


def tally(found: DataFrame) -> DataFrame:
    """component, field, writes, reads."""
    return found.groupBy("component", "field").agg(F.count_if("write").alias("writes"), F.count_if(~F.col("write")).alias("reads"))


def lock_tally(found: DataFrame) -> DataFrame:
    """component, field, lock, w, r: accesses under each lock."""
    each = found.select("component", "field", "write", F.explode("guards").alias("lock"))
    return each.groupBy("component", "field", "lock").agg(F.count_if("write").alias("w"), F.count_if(~F.col("write")).alias("r"))


def infer(found: DataFrame) -> DataFrame:
    """component, field, writes, reads, accepted, guarded_writes, every.

    Accepted are the locks of every write; where there is none, the lock of most
    writes, then most reads, then the smaller name.  Fields without any locked access
    are left out.
    """
    each = lock_tally(found).join(tally(found), ["component", "field"])
    all_of = each.where("w = writes and writes > 0").groupBy("component", "field").agg(F.array_sort(F.collect_set("lock")).alias("accepted"), F.max("w").alias("guarded_writes"), F.first("writes").alias("writes"), F.first("reads").alias("reads"))
    rank = F.row_number().over(Window.partitionBy("component", "field").orderBy(F.desc("w"), F.desc("r"), F.asc("lock")))
    top = each.join(all_of.select("component", "field"), ["component", "field"], "left_anti").withColumn("rank", rank).where("rank = 1")
    columns = ["component", "field", "writes", "reads", "accepted", "guarded_writes"]
    one = top.select("component", "field", "writes", "reads", F.array("lock").alias("accepted"), F.col("w").alias("guarded_writes"))
    return all_of.select(*columns, F.lit(True).alias("every")).union(one.select(*columns, F.lit(False).alias("every")))


def violations(found: DataFrame, inferred: DataFrame) -> DataFrame:
    """The accesses that hold none of their field's accepted locks."""
    return found.join(inferred.select("component", "field", "accepted"), ["component", "field"]).where(~F.arrays_overlap("guards", "accepted"))


def reported(inferred: DataFrame, min_writes: int = MIN_WRITES, min_coverage: int = MIN_COVERAGE, field: str | None = None, guard: str | None = None) -> DataFrame:
    """Fields with enough writes, enough of them guarded, with ``field`` in their name and ``guard`` in a lock's."""
    keep: Column = (F.col("writes") >= min_writes) & (F.col("guarded_writes") * 100 >= F.col("writes") * min_coverage)
    if field is not None:
        keep = keep & F.contains("field", F.lit(field))
    if guard is not None:
        keep = keep & F.exists("accepted", lambda g: F.contains(g, F.lit(guard)))
    return inferred.where(keep)


def report(found: DataFrame, inferred: DataFrame, listed: int = LISTED) -> DataFrame:
    """One row per reported field with a violation: its first ``listed`` violations (writes first, then method and line) and how many of them write.

    Violations that agree in method, line and kind are one.
    """
    bad = violations(found, inferred).select("component", "field", "write", "m", "line").distinct()
    rank = F.row_number().over(Window.partitionBy("component", "field").orderBy(F.desc("write"), "m", "line"))
    some = bad.withColumn("rank", rank).where(F.col("rank") <= listed)
    sites = some.groupBy("component", "field").agg(F.count("*").alias("shown"), F.count_if("write").alias("bad_writes"), F.array_sort(F.collect_list(F.struct("rank", "m", "line"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["m"].cast("string"), x["line"].cast("string"))), ",")
    return inferred.join(sites, ["component", "field"]).select("component", "field", F.array_join("accepted", ",").alias("guard"), "writes", "guarded_writes", "shown", "bad_writes", text.alias("sites"))
