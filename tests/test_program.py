"""The contract of the whole-program queries, on hand-written disassembly."""

import pytest
from pyspark.sql import functions as F

from lockweave.plans.program import Program
from lockweave.sources import async_config, disassembly
from tests.asm import call, clazz, field, method, nested, put, sync

C = "t.C"


def program(spark, *classes, config=None):
    text = "\n".join(line for c in classes for line in c)
    df = spark.createDataFrame([("a.txt", text)], "path string, value string")
    return Program(disassembly.parse(disassembly.lines(df)), config)


LOCK, RW = "java.util.concurrent.locks.ReentrantLock", "java.util.concurrent.locks.ReentrantReadWriteLock"


def explicit(c, first, second, how="lock"):
    return [field(0, c, first), field(1, c, second), call("virtual", [0], LOCK, "lock"), call("virtual", [1], LOCK, how), call("virtual", [1], LOCK, "unlock"), call("virtual", [0], LOCK, "unlock"), "return-void"]


def views(c, a, b):
    return [x for i, n in enumerate((a, b)) for x in (field(i, c, n), call("virtual", [i], RW, "writeLock"), f"move-result-object v{i}", call("virtual", [i], LOCK, "lock"))] + ["return-void"]


def pair(c, one, two, *more):
    return clazz(c, [method(c, "m1", one), method(c, "m2", two), *more])


OBJECT = "()Ljava/lang/Object;"


def cases():
    """name: classes, and the components expected, by the last parts of their locks' names."""
    got = {}
    got["abba"] = [pair(c := "t.Abba", nested(c, "A", "B"), nested(c, "B", "A"))], [["Abba.A", "Abba.B"]]
    got["ring of three"] = [pair(c := "t.Ring", nested(c, "A", "B"), nested(c, "B", "D"), method(c, "m3", nested(c, "D", "A")))], [["Ring.A", "Ring.B", "Ring.D"]]
    got["common guard"] = [pair(c := "t.Guard", nested(c, "G", "A", "B"), nested(c, "G", "B", "A"))], []
    got["reentrant"] = [pair(c := "t.Again", nested(c, "A", "A"), ["return-void"])], []
    private = {"access": 0xA, "ins": 0}
    got["through calls"] = [pair(c := "t.Inter", nested(c, "A", inner=[call("static", [], c, "b")]), nested(c, "B", inner=[call("static", [], c, "a")]), method(c, "a", nested(c, "A"), **private), method(c, "b", nested(c, "B"), **private))], [["Inter.A", "Inter.B"]]
    c = "t.Getter"
    one = [call("virtual", [7], c, "get", OBJECT), "move-result-object v0", *sync(0, [field(1, c, "B"), *sync(1, ["nop"])]), "return-void"]
    two = [field(1, c, "B"), *sync(1, [field(0, c, "m", static=False), *sync(0, ["nop"])]), "return-void"]
    got["getter"] = [pair(c, one, two, method(c, "get", [field(0, c, "m", static=False), "return-object v0"], OBJECT))], [["Getter.B", "Getter.m"]]
    c = "t.Cls"
    got["class object"] = [pair(c, ["const-class v0, Lt/Cls;", *sync(0, [field(1, c, "B"), *sync(1, ["nop"])]), "return-void"], [field(1, c, "B"), *sync(1, ["const-class v0, Lt/Cls;", *sync(0, ["nop"])]), "return-void"])], [["Cls.B", "Cls.class"]]
    c = "t.This"
    got["receiver"] = [pair(c, [*sync(7, [field(1, c, "B"), *sync(1, ["nop"])]), "return-void"], [field(1, c, "B"), *sync(1, sync(7, ["nop"])), "return-void"])], [["This.B", "t.This"]]
    got["explicit"] = [pair(c := "t.Juc", explicit(c, "A", "B"), explicit(c, "B", "A"))], [["Juc.A", "Juc.B"]]
    got["try"] = [pair(c := "t.Try", explicit(c, "A", "B", "tryLock"), explicit(c, "B", "A"))], []
    got["write views"] = [pair(c := "t.Rw", views(c, "A", "B"), views(c, "B", "A"))], [["A.write", "B.write"]]
    run = clazz("t.R", [method("t.R", "run", nested("t.Late", "B"))], interfaces=["java.lang.Runnable"])
    pool = clazz("t.Pool", [method("t.Pool", "execute", [call("interface", [6], "java.lang.Runnable", "run"), "return-void"], "(Ljava/lang/Runnable;)V", ins=2)], interfaces=["java.util.concurrent.Executor"])
    code = ["new-instance v2, Lt/R;", call("direct", [2], "t.R", "<init>"), "new-instance v3, Lt/Pool;", *nested("t.Late", "A", inner=[call("virtual", [3, 2], "t.Pool", "execute", "(Ljava/lang/Runnable;)V")])]
    got["deferred"] = [run, pool, pair("t.Late", code, nested("t.Late", "B", "A"))], []
    a, b = "t.Owner", "t.Keeper"
    keep = method(b, "<init>", ["iput-object v7, v6, Lt/Keeper;.mine:Ljava/lang/Object;", "return-void"], "(Ljava/lang/Object;)V", ins=2)
    make = method(a, "make", [field(0, a, "lock", static=False), "new-instance v1, Lt/Keeper;", call("direct", [1, 0], b, "<init>", "(Ljava/lang/Object;)V"), "return-void"])
    one = method(a, "m1", [field(0, a, "lock", static=False), *sync(0, [field(1, a, "X"), *sync(1, ["nop"])]), "return-void"])
    two = method(b, "m2", [field(1, a, "X"), *sync(1, [field(0, b, "mine", static=False), *sync(0, ["nop"])]), "return-void"])
    got["argument"] = [clazz(a, [make, one]), clazz(b, [keep, two])], [["Owner.X", "Owner.lock"]]
    two_same = clazz("t.Dup", [method("t.Dup", "m", nested("t.Dup", "A", "B")), method("t.Dup", "m", nested("t.Dup", "B", "A")), method("t.Dup", "none", [])])
    got["first body wins"] = [two_same], []
    return got


def test_deadlocks(spark):
    got = cases()
    p = program(spark, *[c for classes, _ in got.values() for c in classes])
    found = sorted(sorted(".".join(n.split(".")[-2:]) for n in r["locks"]) for r in p.deadlocks().collect())
    assert found == sorted(x for _, want in got.values() for x in want)
    assert [r["locks"] for r in p.components().where("size(guard) > 0").collect()] == [["t.Guard.A", "t.Guard.B"]]
    assert p.methods.where("class = 't.Dup'").count() == 2


def test_a_veto_undoes_deferring(spark):
    got = cases()["deferred"][0]
    p = program(spark, *got, config=async_config.parse("-t.Pool.execute"))
    assert [sorted(r["locks"]) for r in p.deadlocks().collect()] == [["t.Late.A", "t.Late.B"]]


def test_tangle_has_a_short_inversion(spark):
    names = [f"L{i:02d}" for i in range(13)]
    ring = [method(C, f"m{i}", nested(C, names[i], names[(i + 1) % 13])) for i in range(13)] + [method(C, "back", nested(C, "L01", "L00"))]
    p = program(spark, clazz(C, ring))
    assert [r["tangle"] for r in p.components().collect()] == [True]
    assert ["t.C.L00", "t.C.L01"] in [r["cycle"] for r in p.inversions.collect()]
    assert [(sorted(r["locks"]), r["kind"], r["verdict"]) for r in p.verify().collect()] == [(["t.C.L00", "t.C.L01"], "inversion", "both")]


BINDER = "android.os.IBinder"


def test_process_boundary(spark):
    send = method(C, "send", [call("interface", [0], BINDER, "transact"), "return-void"], access=0x2)
    deep = method(C, "deep", [call("direct", [7], C, "send"), "return-void"], access=0x2)
    across = method(C, "across", nested(C, "LOCK", inner=[call("direct", [7], C, "deep")]))
    before = method(C, "before", [*nested(C, "OTHER")[:-1], call("direct", [7], C, "send"), "return-void"])
    server = clazz("t.S", [method("t.S", "entry", [*nested(C, "IN", inner=[call("interface", [0], BINDER, "transact")])])], sup="android.os.Binder")
    p = program(spark, clazz(C, [send, deep, across, before]), server)
    out = {r["mkey"]: r for r in p.outgoing.collect()}
    assert set(out) == {"t.C.across:()V", "t.S.entry:()V"}
    assert out["t.C.across:()V"]["held"] == ["t.C.LOCK"] and out["t.C.across:()V"]["path"] == ["t.C.across:()V", "t.C.deep:()V", "t.C.send:()V"]
    assert [(r["mkey"], r["locks"], r["high"]) for r in p.incoming().collect()] == [("t.S.entry:()V", ["t.C.IN"], True)]


def guarded_put(n=1):
    return [x for _ in range(n) for x in (field(0, C, "lock", static=False), *sync(0, [put(1, 7, C, "f")]))]


def test_races(spark):
    def guarded_put(c):
        return [field(0, c, "lock", static=False), *sync(0, [put(1, 7, c, "f")])]

    def tame(c):
        return [method(c, f"w{i}", [*guarded_put(c), "return-void"]) for i in range(2)]

    def wild(c):
        return method(c, "wild", [put(1, 7, c, "f"), "return-void"])

    def helped(c, *more):
        helper = method(c, "helper", [put(1, 7, c, "f"), "return-void"], access=0x2)
        callers = [method(c, n, [field(0, c, "lock", static=False), *sync(0, [call("direct", [7], c, "helper")]), "return-void"]) for n in "ab"]
        return clazz(c, [helper, *callers, *tame(c), *more])

    bare = method("t.Bare", "bare", [call("direct", [7], "t.Bare", "helper"), "return-void"])
    c = "t.Flow"  # a lock let go on one way out stays held on the other; a handler of the range still holds it
    early = method(c, "early", [field(0, c, "lock", static=False), "monitor-enter v0", "if-eqz v1, @rest // +0003", "monitor-exit v0", "return-void", ("rest", put(1, 7, c, "f")), "monitor-exit v0", "return-void"])
    catch = method(c, "caught", [field(0, c, "lock", static=False), "monitor-enter v0", ("lo", "nop"), ("hi", "monitor-exit v0"), "return-void", ("h", put(1, 7, c, "f")), "monitor-exit v0", "return-void"], catches=[("lo", "hi", "h")])
    p = program(
        spark, clazz("t.Bad", [*tame("t.Bad"), wild("t.Bad")]), clazz("t.Good", tame("t.Good")), clazz("t.Vol", [*tame("t.Vol"), wild("t.Vol")], fields=[("f", 0x40)]),
        clazz("t.Ctor", [*tame("t.Ctor"), method("t.Ctor", "<init>", [put(1, 7, "t.Ctor", "f"), "return-void"])]), helped("t.Help"), helped("t.Bare", bare), clazz(c, [early, catch, *tame(c)]),
    )
    got = {r["field"]: r for r in p.races().collect()}
    assert set(got) == {"t.Bad.f", "t.Bare.f"}
    bad = got["t.Bad.f"]
    assert (bad["guard"], bad["writes"], bad["guarded_writes"], bad["bad_writes"]) == ("t.Bad.lock", 3, 2, 1)
    assert all(r["guards"] == ["t.Flow.lock"] for r in p.accesses.where("field = 't.Flow.f'").collect())


def test_parser(spark):
    bad = ["Class #0 -", "  Class descriptor  : 'Lt/X;'", "  Direct methods    -", "      name          : 'm'", "      access        : zz", "      registers     : 2", "      ins           : 5", "0: |[000148] t.X.m:()V", "0: |0000: monitor-enter vx", "0: |0001: invoke-static/range {v1 .. v999}, Lt/X;.n:()V", "0: |0002: invoke-virtual/range {v1 .. v3}, Lt/X;.n:()V // x", "0: |0003: goto zz", "0: |0004: what v1, v2", "0: |0005: iget v1, v2, nonsense"]
    f = disassembly.parse(disassembly.lines(spark.createDataFrame([("a", "\n".join(bad))], "path string, value string")))
    m = f.methods.first()
    assert (m["mkey"], m["class"], m["name"], m["sig"], m["access"], m["registers"], m["ins"]) == ("t.X.m:()V", "t.X", "m", "()V", 0, 2, 5)
    rows = [(r["off"], r["op"], r["dst"], r["args"]) for r in f.insns.orderBy("idx").collect()]
    assert rows == [(0, "other", None, None), (1, "invoke", None, []), (2, "invoke", None, [1, 2, 3]), (3, "other", None, None), (4, "other", None, None), (5, "def", 1, None)]
    flags = disassembly.parse(disassembly.lines(spark.createDataFrame([("a", "\n".join(clazz(C, [], fields=[("a", 0x10), ("b", 0x2), ("c", 0x40)], interfaces=["t.I"])))], "path string, value string")))
    assert sorted(r["field"] for r in flags.flags.collect()) == ["t.C.a", "t.C.c"]
    assert [(r["class"], r["super"], r["interfaces"], r["source_file"]) for r in flags.classes.collect()] == [("t.C", "java.lang.Object", ["t.I"], "C.java")]


def test_empty_program(spark):
    assert program(spark, []).deadlocks().collect() == []


def test_async_config():
    c = async_config.parse("# note\npkg.Cls.m\nm2 # more\n-Cls.m3\nextends pkg.Base: a b\n-extends java.lang.Thread\n")
    assert c.add == {"pkg.Cls.m", "m2"} and c.remove == {"Cls.m3"} and c.add_base == {"pkg.Base": {"a", "b"}}
    assert ("java.lang.Thread", "start") not in c.bases() and ("android.os.HandlerThread", "start") not in c.known()
    assert ("java.util.concurrent.ScheduledThreadPoolExecutor", "execute") in async_config.AsyncConfig().known()
    for text in ("extends Base: m", "extends pkg.Base m", "extends pkg.Base:"):
        with pytest.raises(ValueError):
            async_config.parse(text)


def test_lock_algebra(spark):
    from lockweave.functions import locks as lk

    rows = [("t||f|", ["r|t.A|g|"], "r|t.A|g.f|", "t.A.g.f"), ("p|1||read", [None, "s|t.B|x|"], "s|t.B|x|read", "t.B.x.read"), ("p|2||", ["t|||"], None, None), ("t||a.b|", ["r|t.A|c.d|"], "o|trunc:t.A.c.d.a.b||", "?@trunc:t.A.c.d.a.b"), ("c|t.C||", [], "c|t.C||", "t.C.class")]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "lock string, args array<string>").withColumn("b", lk.bound(F.col("lock"), F.col("args"))).withColumn("n", lk.name(F.col("b")))
    assert [(r["b"], r["n"]) for r in df.collect()] == [r[2:] for r in rows]
    one = spark.createDataFrame([("r|t.O$I|this$0.m|",)], "l string").select(lk.outer(F.col("l")).alias("o"), lk.grounded(F.lit("t||f|"), F.lit("t.K"), F.lit("k")).alias("g")).first()
    assert (one["o"], one["g"]) == ("r|t.O|m|", "r|t.K|f|")
