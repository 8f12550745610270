"""The events table as an instruction stream.

Each user is a method, each event an instruction at offset ``event_id``; its type is
the operation and the number in ``props`` its operand.  See the README for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.plans.loop import apart

COMPONENTS, LOCKS, FIELDS = 10, 12, 20
OPS = {"signup": "enter", "purchase": "exit", "view": "iget", "click": "iput", "error": "invoke"}
KINDS = ("direct", "static", "virtual", "interface", "super")


def _name(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0"))


def instructions(events: DataFrame) -> DataFrame:
    """component, m, off, line, op, k, lock, field."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])[F.col("event_type")]
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.select((F.col("user_id") % COMPONENTS).alias("component"), F.col("user_id").alias("m"), F.col("event_id").alias("off"), line.cast("long").alias("line"), op.alias("op"), k.cast("long").alias("k")).select(
        "*", _name("L", F.col("k") % LOCKS).alias("lock"), _name("F", F.col("k") % FIELDS).alias("field")
    )


def effects(instr: DataFrame) -> DataFrame:
    """m, off, lock, d: +1 where a lock is taken, -1 where it is let go."""
    return instr.where(F.col("op").isin("enter", "exit")).select("m", "off", "lock", F.when(F.col("op") == "enter", 1).otherwise(-1).alias("d"))


def calls(instr: DataFrame) -> DataFrame:
    """component, m, off, line, kind, callee, is_async, transact, rn: calls of other, existing methods.

    rn ranks a method's synchronous calls by offset (null for asynchronous ones).
    """
    users = instr.select("m").distinct()
    size = users.agg(((F.floor(F.max("m") / COMPONENTS) + 1) * COMPONENTS).alias("size"))
    raw = instr.where("op = 'invoke'").join(F.broadcast(size))  # one row
    callee = (F.col("m") + COMPONENTS * (1 + F.col("k"))) % F.col("size")
    kind = F.array(*map(F.lit, KINDS))[(F.col("k") % 5).cast("int")]
    named = raw.select("component", "m", "off", "line", kind.alias("kind"), callee.alias("callee"), (F.col("k") % 7 == 3).alias("is_async"), (F.col("k") == 0).alias("transact"))
    real = apart(named.where("callee <> m")).join(users.withColumnRenamed("m", "callee"), "callee", "left_semi")
    rank = F.row_number().over(Window.partitionBy("m", "is_async").orderBy("off"))
    return real.withColumn("rn", F.when(~F.col("is_async"), rank))


def call_dag(found: DataFrame) -> DataFrame:
    return found.where("rn <= 2 and callee > m")


def call_cyclic(found: DataFrame) -> DataFrame:
    return found.where("rn <= 3")


def accesses(instr: DataFrame) -> DataFrame:
    """component, m, off, line, field, write."""
    return instr.where(F.col("op").isin("iget", "iput")).select("component", "m", "off", "line", "field", (F.col("op") == "iput").alias("write"))


def external(m: Column) -> Column:
    return m % 3 == 0
