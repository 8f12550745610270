"""Source files beside a program."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders of a tree that hold no sources of its own (fixed values).
SKIPPED = ("out", ".git", ".repo", "prebuilts", "node_modules", ".gradle")


def index(spark: SparkSession, root: str) -> DataFrame:
    """path, line_no, text of every .java file of a tree."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.java").select(F.input_file_name().alias("path"), "value")
    skipped = "|".join(s.replace(".", "\\.") for s in SKIPPED)
    kept = whole.where(~F.regexp_replace("path", F.lit("^" + root.rstrip("/")), F.lit("")).rlike(f"/({skipped})/"))
    return kept.select("path", F.posexplode(F.split("value", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def file_for(classes: DataFrame, paths: DataFrame) -> DataFrame:
    """class, path: the file of the outer class's name whose folder has the package, else the first by path."""
    outer = F.substring_index(F.substring_index("class", ".", -1), "$", 1)
    package = F.translate(F.regexp_extract("class", r"^(.*)\.[^.]*$", 1), ".", "/")
    wanted = classes.select("class", outer.alias("base"), package.alias("package")).distinct()
    have = paths.select("path").distinct().withColumn("base", F.regexp_extract("path", r"([^/]*)\.java$", 1))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.contains("path", F.concat(F.lit("/"), "package", F.lit("/")))), "path"))
    return wanted.join(have, "base").withColumn("r", rank).where("r = 1").select("class", "path")


# What takes a lock in a source line; calls near a line that hint at deferred work.
TAKES = ("synchronized", ".lock(", ".writeLock(", ".readLock(")
HINTS = (".post(", ".postDelayed(", ".execute(", ".sendMessage")


def _any(parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | F.contains("text", F.lit(x))
    return found


def taking(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """class, target, path, line_no, text: lines of each class's file (class, target, path) that take its target; as ``acquire_sites``, for many."""
    plain = F.trim("text")
    code = ~(plain.startswith("//") | plain.startswith("*") | plain.startswith("/*"))
    some = targets.join(lines.where(code & _any(TAKES)), "path")
    words = F.split(F.regexp_replace("text", "[^A-Za-z0-9_$]+", " "), " ")
    return some.where(F.array_contains(words, F.col("target"))).select("class", "target", "path", "line_no", "text")


def relative(path: Column, root: str) -> Column:
    """A file's path below the tree's root, without the scheme."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.when(F.startswith(plain, F.lit(root.rstrip("/") + "/")), F.substring(plain, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(plain)


def acquire_sites(lines: DataFrame, target: str) -> DataFrame:
    """Lines that take the lock ``target``: synchronized on it, or one of its locks called; comments don't count."""
    plain = F.trim("text")
    code = ~(plain.startswith("//") | plain.startswith("*") | plain.startswith("/*"))
    word = f"(^|[^A-Za-z0-9_$]){re.escape(target)}([^A-Za-z0-9_$]|$)"
    return lines.where(code & F.col("text").rlike(word) & _any(TAKES))




def evidence(samples: DataFrame, lines: DataFrame, before: int = 6, after: int = 3) -> DataFrame:
    """``samples`` (class, line, and others) with file, snippet and late: the source around each line, and whether it hints at deferred work.

    Samples without a file or line have null there.
    """
    files = file_for(samples.select("class"), lines)
    placed = samples.join(files.withColumnRenamed("path", "file"), "class", "left")
    wanted = placed.where("file is not null and line is not null").select("file", F.col("line").cast("long").alias("at")).distinct()
    near = wanted.withColumn("line_no", F.explode(F.sequence(F.col("at") - before, F.col("at") + after))).join(lines.withColumnRenamed("path", "file"), ["file", "line_no"])
    shown = near.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("snippet"), F.bool_or(_any(HINTS)).alias("late"))
    return placed.join(shown.withColumnRenamed("file", "_f"), (F.col("file") == F.col("_f")) & (F.col("line") == F.col("at")), "left").drop("_f", "at")
