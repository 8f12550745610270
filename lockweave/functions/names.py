"""Names of methods, classes and locks as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Access bits of the class file format.
PUBLIC, PROTECTED, STATIC = 0x1, 0x4, 0x8


def class_of(key: Column) -> Column:
    """The class of a method key class.name:sig."""
    return F.regexp_extract(key, r"^([^:]*)\.[^.:]*(:|$)", 1)


def namesig_of(key: Column) -> Column:
    return F.concat_ws(":", F.substring_index(F.substring_index(key, ":", 1), ".", -1), F.regexp_extract(key, "^[^:]*:(.*)$", 1))


def short_method(key: Column) -> Column:
    """Class's last name and the method's, without the mark of generated accessors."""
    cls = F.substring_index(class_of(key), ".", -1)
    return F.concat_ws(".", cls, F.regexp_replace(F.substring_index(F.substring_index(key, ":", 1), ".", -1), r"^-\$\$Nest\$m", ""))


def short_lock(lock: Column) -> Column:
    return F.substring_index(lock, ".", -2)


def escaped(text: Column) -> Column:
    """For a quoted Graphviz label."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', '\\\\"')


def is_static(access: Column) -> Column:
    return access.bitwiseAND(STATIC) != 0


def is_external(access: Column) -> Column:
    return access.bitwiseAND(PUBLIC | PROTECTED) != 0


def this_register(registers: Column, ins: Column) -> Column:
    return F.greatest(F.lit(0), registers - ins)


def is_entry(access: Column, name: Column) -> Column:
    """A public instance method that others may call: no constructor, dispatcher or generated body."""
    made = name.rlike(r"^(lambda\$|access\$|-\$\$|\$\$Nest)")
    return (access.bitwiseAND(PUBLIC) != 0) & ~is_static(access) & ~name.isin("<init>", "<clinit>", "onTransact") & ~made


def has_word(text: Column, word: str) -> Column:
    """The word between characters that no identifier has."""
    plain = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return text.rlike(f"(^|[^A-Za-z0-9_$]){plain}([^A-Za-z0-9_$]|$)")


def dotted(descriptor: Column) -> Column:
    """La/b/C; as a.b.C; others as they are."""
    inner = F.translate(F.regexp_extract(descriptor, "^L(.*);$", 1), "/", ".")
    return F.when(descriptor.rlike("^L.*;$"), inner).otherwise(descriptor)


def lock_target(lock: Column) -> Column:
    """A lock's field for searching its uses: mode dropped; a class or receiver monitor by its class."""
    plain = F.regexp_replace(lock, r"\.(read|write)$", "")
    return F.when(plain.endswith(".class"), F.regexp_replace(plain, r"\.class$", "")).when(plain.endswith("@this"), F.regexp_replace(plain, "@this$", "")).otherwise(F.substring_index(plain, ".", -1))


def sample_parts(sample: Column) -> tuple[Column, Column]:
    """Method key and line of a sample key:line; a sample without a line is no method's."""
    at = r"^(.*):([0-9]+)$"
    return F.when(sample.rlike(at), F.regexp_extract(sample, at, 1)), F.regexp_extract(sample, at, 2).try_cast("int")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")


def line_asof(points: DataFrame, positions: DataFrame) -> DataFrame:
    """points (m, off) with line: that of the last position at or before the offset, null before the first.

    Both tables are one stream ordered by offset; the last line seen is carried on, so
    no pair of point and position is formed.
    """
    both = points.select("m", "off", F.lit(None).cast("long").alias("line"), F.lit(1).alias("what")).union(positions.select("m", "off", F.col("line").cast("long"), F.lit(0)))
    w = Window.partitionBy("m").orderBy("off", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("at", F.last("line", ignorenulls=True).over(w)).where("what = 1").select("m", "off", F.col("at").alias("line"))


def catches(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (m, off) in each half-open range (m, lo, hi, handler) that holds them."""
    r = ranges.withColumnRenamed("m", "rm")
    return points.join(r, (F.col("m") == F.col("rm")) & (F.col("off") >= F.col("lo")) & (F.col("off") < F.col("hi"))).select("m", "off", "handler")


def single_value(returns: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of methods all of whose returns give one known value."""
    whole = returns.groupBy(key).agg(F.count_if(F.col(value).isNull()).alias("unknown"), F.min(value).alias("a"), F.max(value).alias("b"))
    return whole.where("unknown = 0 and a = b").select(key, F.col("a").alias(value))


def context(lines: DataFrame, sites: DataFrame, before: int, after: int) -> DataFrame:
    """The lines around each site: source lines (path, line_no, text) from ``before`` above to ``after`` below."""
    wanted = sites.select("path", F.col("line_no").alias("site"), F.explode(F.sequence(F.col("line_no") - before, F.col("line_no") + after)).alias("line_no"))
    return wanted.join(lines, ["path", "line_no"])
