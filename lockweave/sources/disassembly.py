"""Disassembly text as fact tables: classes, methods, instructions, positions, handlers, field flags.

One row per line; what a line belongs to (class, member, method) is carried forward
with windows per file, and its parts are cut out by patterns.  Malformed parts
become null, 0 or nothing, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.functions.names import dotted

#: Access bits of fields whose accesses are never reported.
FINAL, VOLATILE = 0x10, 0x40
#: Registers that a range operand may span.
SPAN = 256


@dataclass
class Facts:
    """classes: class, super, interfaces, ord; methods: mkey, class, name, sig, access, registers, ins, source_file,
    compat_source_file, external, ord; insns: mkey, ord, idx, off, op, dst, src, base, cls, member, sig, kind, args, target;
    positions: mkey, ord, off, line; catches: mkey, ord, lo, hi, handler; flags: field."""

    classes: DataFrame
    methods: DataFrame
    insns: DataFrame
    positions: DataFrame
    catches: DataFrame
    flags: DataFrame


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, at, t: the trimmed lines of every text file under ``path``."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    return lines(whole)


def lines(files: DataFrame) -> DataFrame:
    """``files``: path, value."""
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("at", "raw")).select("path", "at", F.trim(F.regexp_replace("raw", "\t", " ")).alias("t"))


def _hex(text: Column) -> Column:
    return F.coalesce(F.conv(F.nullif(text, F.lit("")), 16, 10).try_cast("long"), F.lit(0))


def _number(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r":\s*([0-9]+)\s*$", 1).try_cast("int"), F.lit(0))


def _quoted(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "'([^']*)'", 1), F.lit(""))


def _register(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), "^v([0-9]+)$", 1).try_cast("int")


def _registers(text: Column) -> Column:
    """{v1, v2} or {v1 .. v4}; a range that spans too much is none at all."""
    inner = F.trim(F.regexp_extract(text, r"^\{([^}]*)\}", 1))
    low, high = _register(F.substring_index(inner, "..", 1)), _register(F.substring_index(inner, "..", -1))
    none = F.array().cast("array<int>")
    run = F.when(low.isNotNull() & high.isNotNull() & (high >= low) & (high - low < SPAN), F.sequence(low, high)).otherwise(none)
    listed = F.filter(F.transform(F.split(inner, ","), _register), lambda x: x.isNotNull())
    return F.when(F.contains(inner, F.lit("..")), run).otherwise(listed)


def _carried(at: Window, value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(at)


def parse(found: DataFrame) -> Facts:
    """``found``: path, at, t."""
    t = F.col("t")
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_class, is_member, is_body = t.startswith("Class descriptor"), t.rlike(r"^name\s*:"), t.rlike(r"\|\[[0-9a-f]+\] \S+:\(")
    section = F.when(is_class, "class").when(t.startswith("Interfaces"), "interfaces").when(t.startswith("Static fields") | t.startswith("Instance fields"), "fields")
    section = section.when(t.startswith("Direct methods") | t.startswith("Virtual methods"), "methods").when(t.startswith("source_file_idx"), "end")
    part = F.when(is_body, "body").when(t.rlike(r"^catches\s*:"), "catches").when(t.rlike(r"^positions\s*:"), "positions").when(t.rlike(r"^locals\s*:"), "locals").when(is_member | section.isNotNull(), "head")
    marked = found.withColumn("no", F.sum(is_class.cast("int")).over(w)).withColumn("item", F.sum(is_member.cast("int")).over(w))
    marked = marked.withColumn("section", _carried(w, section)).withColumn("part", _carried(w, part))
    marked = marked.withColumn("class", _carried(w, F.when(is_class, dotted(_quoted(t))))).withColumn("file_before", _carried(w, F.when(t.startswith("source_file_idx"), F.nullif(F.regexp_extract(t, r"\(([^)]*)\)", 1), F.lit("")))))
    own = ["path", "no"]

    inside = marked.where("no > 0")
    named = lambda what: F.max(F.when(what, dotted(_quoted(t))))
    listed = F.array_sort(F.collect_list(F.when((F.col("section") == "interfaces") & t.rlike(r"^#[0-9]+\s*:"), F.struct("at", dotted(_quoted(t)).alias("c")))))
    file = F.max(F.when(t.startswith("source_file_idx"), F.nullif(F.regexp_extract(t, r"\(([^)]*)\)", 1), F.lit(""))))
    classes = inside.groupBy(*own).agg(F.first("class", ignorenulls=True).alias("class"), named(t.startswith("Superclass")).alias("super"), listed.alias("i"), file.alias("source_file"))
    classes = classes.select(*own, "class", "super", F.transform("i", lambda x: x["c"]).alias("interfaces"), "source_file", F.struct("path", "no").alias("ord"))

    of = ["path", "no", "item"]
    first = lambda what, value: F.min(F.when(what, F.struct("at", value.alias("v"))))["v"]
    access = F.when(t.rlike(r"^access\s*:"), _hex(F.regexp_extract(t, r":\s*0x([0-9a-fA-F]+)", 1)))
    fields = inside.where("section = 'fields' and item > 0").groupBy(*of).agg(F.max("class").alias("class"), F.max(F.when(is_member, _quoted(t))).alias("name"), F.max(access).alias("access"))
    flags = fields.where(F.col("access").bitwiseAND(FINAL | VOLATILE) != 0).select(F.concat_ws(".", "class", "name").alias("field")).distinct()

    code = inside.where("section = 'methods' and item > 0")
    heads = code.groupBy(*of).agg(
        first(is_body, F.regexp_extract(t, r"\|\[[0-9a-f]+\] (\S+)", 1)).alias("mkey"),
        F.max("class").alias("class"),
        F.max(access).cast("int").alias("access"),
        F.max(F.when(t.rlike(r"^registers\s*:"), _number(t))).alias("registers"),
        F.max(F.when(t.rlike(r"^ins\s*:"), _number(t))).alias("ins"),
        F.min("at").alias("at"),
        first(is_body, F.col("file_before")).alias("compat_source_file"),
    ).where("mkey is not null")
    # the body's own line names class, name and signature
    before = F.substring_index("mkey", ":", 1)
    methods = heads.join(classes.select(*own, "source_file"), own).select(
        *of, "mkey", F.regexp_extract(before, r"^(.*)\.[^.]*$", 1).alias("class"), F.substring_index(before, ".", -1).alias("name"), F.expr("substring(mkey, instr(mkey, ':') + 1)").alias("sig"),
        F.coalesce("access", F.lit(0)).alias("access"), F.coalesce("registers", F.lit(0)).alias("registers"), F.coalesce("ins", F.lit(0)).alias("ins"), "source_file", "compat_source_file", F.struct("path", "no", "item").alias("ord"),
    )
    keys = methods.select(*of, "mkey", "ord")

    text = F.regexp_extract(t, r"\|[0-9a-fA-F]+: (.*)$", 1)
    raw = code.where((F.col("part") == "body") & t.rlike(r"\|[0-9a-fA-F]+: ")).select(*of, "at", _hex(F.regexp_extract(t, r"\|([0-9a-fA-F]+): ", 1)).cast("int").alias("off"), F.trim(F.regexp_replace(text, r"//.*$", "")).alias("body"))
    insns = _decoded(raw).withColumn("idx", (F.row_number().over(Window.partitionBy(*of).orderBy("at")) - 1).cast("int")).join(keys, of).drop(*of, "at")

    place = r"^0x([0-9a-fA-F]+) line=([0-9]+)$"
    positions = code.where((F.col("part") == "positions") & t.rlike(place)).select(*of, "at", _hex(F.regexp_extract(t, place, 1)).cast("int").alias("off"), F.regexp_extract(t, place, 2).cast("int").alias("line")).join(keys, of).drop(*of)
    span = r"^0x([0-9a-fA-F]+) - 0x([0-9a-fA-F]+)$"
    ws = Window.partitionBy(*of).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = code.where("part = 'catches'").withColumn("r", _carried(ws, F.when(t.rlike(span), F.struct(_hex(F.regexp_extract(t, span, 1)).cast("int").alias("lo"), _hex(F.regexp_extract(t, span, 2)).cast("int").alias("hi")))))
    catches = ranges.where(t.rlike(r"-> 0x[0-9a-fA-F]+$") & F.col("r").isNotNull()).select(*of, "r.lo", "r.hi", _hex(F.regexp_extract(t, r"-> 0x([0-9a-fA-F]+)$", 1)).cast("int").alias("handler")).join(keys, of).drop(*of)
    return Facts(classes.drop(*own), methods.drop(*of), insns, positions, catches, flags)


def _decoded(raw: DataFrame) -> DataFrame:
    """Mnemonics and operands as operations; what isn't known does nothing."""
    m, rest = F.substring_index("body", " ", 1), F.trim(F.expr("substring(body, instr(body, ' ') + 1)"))
    rest = F.when(F.instr(F.col("body"), " ") == 0, "").otherwise(rest)
    one = raw.select("*", m.alias("m"), rest.alias("rest"))
    m, rest = F.col("m"), F.col("rest")
    op = F.when(m.isin("monitor-enter", "monitor-exit"), F.regexp_replace(m, "-", "_"))
    for start, name in (("const-class", "const_class"), ("new-instance", "new_instance"), ("sget", "sget"), ("iget", "iget"), ("iput", "iput"), ("move-result", "move_result"), ("goto", "goto"), ("if-", "branch"), ("invoke", "invoke")):
        op = op.when(m.startswith(start), name)
    op = op.when(m.startswith("move-object") | m.startswith("move/") | m.startswith("move-wide") | (m == "move"), "move").when(m.startswith("return"), "return").when(m == "throw", "throw").otherwise("other")
    part = lambda i: F.trim(F.split(rest, ",", 3)[i]) if i == 0 else F.trim(F.get(F.split(rest, ",", 3), F.lit(i)))
    shaped = one.select("*", op.alias("op"), part(0).alias("p0"), part(1).alias("p1"), part(2).alias("p2"))
    op, p0, p1, p2 = F.col("op"), F.col("p0"), F.col("p1"), F.col("p2")
    ref = F.when(op == "sget", F.trim(F.regexp_replace(rest, r"^[^,]*,", ""))).when(op.isin("iget", "iput"), p2).when(op == "invoke", F.trim(F.regexp_replace(rest, r"^\{[^}]*\},?", "")))
    member = r"^(L[^;]*;)\.([^:]+):(.*)$"
    typed = F.when(op.isin("const_class", "new_instance"), F.when(p1.startswith("L"), dotted(p1))).otherwise(F.when(ref.rlike(member), dotted(F.regexp_extract(ref, member, 1))))
    name = F.when(ref.rlike(member), F.regexp_extract(ref, member, 2))
    kind = F.when(op == "invoke", F.when(F.contains(m, F.lit("direct")), "direct").when(F.contains(m, F.lit("static")), "static").when(F.contains(m, F.lit("interface")), "interface").when(F.contains(m, F.lit("super")), "super").otherwise("virtual"))
    target = F.when(op.isin("goto", "branch"), F.conv(F.regexp_extract(rest, r"([0-9a-fA-F]+)\s*$", 1), 16, 10).try_cast("int"))
    full = shaped.select(
        *[c for c in raw.columns if c != "body"], op.alias("op"), m.alias("m"), _register(p0).alias("r0"), _register(p1).alias("r1"), typed.alias("cls"), name.alias("member"),
        F.when(op == "invoke", F.regexp_extract(ref, member, 3)).alias("sig"), kind.alias("kind"), F.when(op == "invoke", _registers(rest)).alias("args"), target.alias("target"),
    )
    r0, r1 = F.col("r0"), F.col("r1")
    known = (
        F.when(F.col("op").isin("monitor_enter", "monitor_exit", "move_result"), r0.isNotNull())
        .when(F.col("op").isin("const_class", "new_instance"), r0.isNotNull() & F.col("cls").isNotNull())
        .when(F.col("op").isin("sget", "iget", "move"), r0.isNotNull())
        .when(F.col("op") == "iput", r0.isNotNull() & r1.isNotNull() & F.col("cls").isNotNull())
        .when(F.col("op").isin("goto", "branch"), F.col("target").isNotNull())
        .when(F.col("op") == "invoke", F.col("cls").isNotNull())
        .otherwise(True)
    )
    cleared = (F.col("op") == "sget") & F.col("cls").isNull() | (F.col("op") == "iget") & (F.col("cls").isNull() | r1.isNull()) | (F.col("op") == "move") & r1.isNull()
    sure = full.withColumn("op", F.when(~known, "other").when(cleared, "def").otherwise(F.col("op")))
    op = F.col("op")
    return sure.select(
        *[c for c in raw.columns if c != "body"], op.alias("op"),
        F.when(op.isin("sget", "iget", "const_class", "new_instance", "move", "move_result", "def"), r0).alias("dst"),
        F.when(op.isin("monitor_enter", "monitor_exit", "iput"), r0).when(op == "move", r1).when((op == "return") & (F.col("m") == "return-object"), r0).alias("src"),
        F.when(op.isin("iget", "iput"), r1).alias("base"), "cls", "member", "sig", "kind", "args", "target",
    )
