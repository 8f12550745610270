"""The operators over the driver's tables; each query takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.functions import names
from lockweave.operators import alias as al
from lockweave.operators import calls as ca
from lockweave.operators import edges as ed
from lockweave.operators import fixpoint as fx
from lockweave.operators import graph as gr
from lockweave.operators import held as he
from lockweave.operators import ipc, races
from lockweave.plans.loop import apart, settle
from lockweave.sources import events as ev

#: Evidence rows that an edge needs in the graph queries; locks above which a component is a tangle; largest cycle verified whole.
SUPPORT, TANGLE, MAX_LOCKS = 5, 8, 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Facts:
    """The events' facts, made when first asked for; those that several rules share are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = settle(make(), name)
        return self.made[name]

    @property
    def instr(self) -> DataFrame:
        return self.once("instr", lambda: ev.instructions(self.read("events")))

    @property
    def effects(self) -> DataFrame:
        return ev.effects(self.instr)

    @property
    def enters(self) -> DataFrame:
        return self.instr.where("op = 'enter'").select("component", "m", "off", "line", "lock")

    @property
    def order(self) -> DataFrame:
        return self.once("order", lambda: he.order_edges(self.enters, self.effects))

    def strong(self, support: int = SUPPORT) -> DataFrame:
        """Order evidence of edges with enough of it."""
        n = F.count("*").over(Window.partitionBy("component", "src", "dst"))
        return self.once(f"strong{support}", lambda: self.order.withColumn("n", n).where(F.col("n") >= support))

    def scc(self, support: int = SUPPORT) -> DataFrame:
        return self.once(f"scc{support}", lambda: gr.strong_components(self.strong(support)))

    @property
    def cycles(self) -> DataFrame:
        return self.once("cycles", lambda: gr.minimal_cycles(self.strong(), self.scc()))

    @property
    def calls(self) -> DataFrame:
        return self.once("calls", lambda: ev.calls(self.instr))

    @property
    def methods(self) -> DataFrame:
        return self.instr.select("component", "m").distinct()

    def held(self, points: DataFrame) -> DataFrame:
        return he.held_at(points, self.effects)

    @property
    def call_locks(self) -> DataFrame:
        """call (its offset), held."""
        return self.once("call_locks", lambda: self.held(self.calls.select("m", "off")).select(F.col("off").alias("call"), "m", "held"))

    @property
    def direct(self) -> DataFrame:
        """Locks that a method acquires itself: the first four."""
        return he.acquires(self.enters, self.effects).where("lock < 'L04'").select("m", "lock").distinct()

    @property
    def may(self) -> DataFrame:
        return self.once("may", lambda: fx.may_acquire(self.direct, ev.call_dag(self.calls)))

    def must(self, roots: DataFrame) -> DataFrame:
        edge = ev.call_cyclic(self.calls).select(F.col("off").alias("call"), "m", "callee")
        return fx.must_entry(self.methods, edge, apart(self.call_locks).join(edge.select("call"), "call", "left_semi").select("call", "held"), roots)

    @property
    def must_strict(self) -> DataFrame:
        return self.once("must_strict", lambda: self.must(self.methods.where(ev.external(F.col("m")))))

    @property
    def must_race(self) -> DataFrame:
        called = ev.call_cyclic(self.calls).select(F.col("callee").alias("m"))
        return self.once("must_race", lambda: self.must(apart(self.methods).join(called, "m", "left_anti")))

    @property
    def reach(self) -> DataFrame:
        return self.once("reach", lambda: ipc.reach(self.ipc_calls))

    @property
    def ipc_calls(self) -> DataFrame:
        """Calls of the acyclic relation, and all transactions."""
        return self.calls.where("(rn <= 2 and callee > m) or transact")

    @property
    def outgoing(self) -> DataFrame:
        return self.once("outgoing", lambda: ipc.outgoing(self.ipc_calls, self.call_locks.select("m", F.col("call").alias("off"), "held"), self.reach))

    @property
    def accesses(self) -> DataFrame:
        acc = ev.accesses(self.instr)
        return self.once("accesses", lambda: races.guarded(acc, self.held(acc.select("m", "off"))))

    @property
    def inferred(self) -> DataFrame:
        return self.once("inferred", lambda: races.infer(self.accesses))

    # --- a class hierarchy: customers below nations below regions
    @property
    def supers(self) -> DataFrame:
        c = self.read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("sub"), F.concat(F.lit("n"), "c_nationkey").alias("sup"))
        n = self.read("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("sub"), F.concat(F.lit("r"), "n_regionkey").alias("sup"))
        return c.union(n)

    @property
    def closure(self) -> DataFrame:
        return self.once("supers", lambda: ca.supertypes(self.supers))

    @property
    def bodies(self) -> DataFrame:
        """class, namesig, mkey: customers and nations define one method each."""
        c = self.read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("class"), (F.col("c_custkey") % 50).alias("f"))
        n = self.read("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("class"), (F.col("n_nationkey") % 50).cast("long").alias("f"))
        sig = F.concat(F.lit("f"), "f", F.lit(":()V"))
        return c.union(n).select("class", sig.alias("namesig"), F.concat_ws(".", "class", sig).alias("mkey"))

    @property
    def instantiated(self) -> DataFrame:
        return self.read("orders").select(F.concat(F.lit("c"), "o_custkey").alias("class")).distinct()

    @property
    def sites(self) -> DataFrame:
        """A call per order: on its customer's nation, of a name by the order; each third one with the customer known."""
        o = self.read("orders").join(self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        known = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), "o_custkey"))
        sig = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 50).otherwise(F.col("o_orderkey") % 50)
        return o.select(F.col("o_orderkey").alias("site"), (F.col("o_orderkey") % 5 != 4).alias("virtual"), F.concat(F.lit("n"), "c_nationkey").alias("declared"), known.alias("receiver"), F.concat(F.lit("f"), sig, F.lit(":()V")).alias("namesig"))

    @property
    def resolved(self) -> DataFrame:
        return self.once("resolved", lambda: ca.dispatch(self.sites, self.bodies, self.closure, self.instantiated))

    # --- source lines
    @property
    def source(self) -> DataFrame:
        """path, line_no, text: the documents' lines."""
        d = self.read("documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
        return d.select("path", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


@query
def held_set(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return f.held(f.instr.select("component", "m", "off")).withColumnRenamed("held", "lock")


@query
def order_edges(spark, sf_dir):
    return Facts(spark, sf_dir).order.select("component", "m", "off", "line", "src", "dst", _joined("guard"))


@query
def reentrant_skip(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return he.reentrant(f.enters, f.effects).select("component", "m", "off", "lock")


@query
def trylock_no_edge(spark, sf_dir):
    """Each fifth operand is a try: it is held from then on, but orders nothing."""
    f = Facts(spark, sf_dir)
    blocking = f.instr.where("op = 'enter' and k % 5 <> 4").select("component", "m", "off", "line", "lock")
    return gr.evidence(he.order_edges(blocking, f.effects)).select("component", "src", "dst", "n")


@query
def lock_nodes(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return gr.nodes(f.order, f.enters)


@query
def edge_evidence(spark, sf_dir):
    return gr.evidence(Facts(spark, sf_dir).order)


@query
def blocking_edges(spark, sf_dir):
    return gr.evidence(Facts(spark, sf_dir).strong()).select("component", "src", "dst", "n")


@query
def lock_closure(spark, sf_dir):
    return gr.closure(Facts(spark, sf_dir).strong())


@query
def scc(spark, sf_dir):
    return Facts(spark, sf_dir).scc()


def _guards(f: Facts) -> DataFrame:
    whole = f.scc().groupBy("component", "rep").agg(F.array_join(F.array_sort(F.collect_set("lock")), ",").alias("locks"), F.count("*").alias("size"))
    return whole.join(gr.scc_guard(f.strong(), f.scc()), ["component", "rep"], "left")


@query
def scc_guard(spark, sf_dir):
    return _guards(Facts(spark, sf_dir)).select("component", "rep", "locks", "size", F.coalesce(F.array_join("guard", ","), F.lit("")).alias("guard"))


@query
def deadlock_cycles(spark, sf_dir):
    return _guards(Facts(spark, sf_dir)).where("guard is null").select("component", "rep", "locks", "size")


@query
def suppressed_cycles(spark, sf_dir):
    """Over all evidence, with each acquisition's method standing for one more lock that it always holds: components of one method only are suppressed."""
    f = Facts(spark, sf_dir)
    own = f.order.withColumn("component", F.col("m")).withColumn("guard", F.concat("guard", F.array(F.concat(F.lit("M"), F.col("m").cast("string")))))
    found = gr.strong_components(own)
    guard = gr.scc_guard(own, found)
    size = found.groupBy("component", "rep").agg(F.count("*").alias("size"))
    return guard.join(size, ["component", "rep"]).select(F.col("component").alias("m"), "rep", "size", _joined("guard"))


@query
def minimal_cycles(spark, sf_dir):
    return Facts(spark, sf_dir).cycles.select("component", "rep", _joined("cycle"))


@query
def inversion_guard(spark, sf_dir):
    f = Facts(spark, sf_dir)
    guard = gr.cycle_guard(f.strong(), f.cycles)
    return f.cycles.join(guard, ["component", "cycle"], "left").select("component", _joined("cycle"), F.size("cycle").cast("long").alias("size"), F.coalesce(F.array_join("guard", ","), F.lit("")).alias("guard"))


@query
def tangle_split(spark, sf_dir):
    """Candidates for verification: components of few locks whole, of larger ones their unguarded short cycles."""
    f = Facts(spark, sf_dir)
    small = f.scc().where(F.col("size") <= MAX_LOCKS).groupBy("component", "rep").agg(F.array_join(F.array_sort(F.collect_set("lock")), ",").alias("locks"))
    large = f.scc().where(F.col("size") > MAX_LOCKS).select("component", "rep").distinct()
    cut = f.cycles.join(large, ["component", "rep"]).where(F.size("cycle") <= MAX_LOCKS).join(gr.cycle_guard(f.strong(), f.cycles).select("component", "cycle"), ["component", "cycle"], "left_anti")
    return small.withColumn("kind", F.lit("component")).union(cut.select("component", "rep", F.array_join("cycle", ","), F.lit("inversion")))


@query
def report_counts(spark, sf_dir):
    f = Facts(spark, sf_dir)
    one = f.strong().agg(F.count("*").alias("edges"), F.count_distinct("m").alias("methods"), F.count_distinct("component", "src", "dst").alias("orders"))
    two = _guards(f).agg(F.count("*").alias("components"), F.count_if(F.col("guard").isNull()).alias("cycles"), F.count_if(F.col("size") > TANGLE).alias("tangles"))
    return one.select("*", two.select("components").scalar().alias("components"), two.select("cycles").scalar().alias("cycles"), two.select("tangles").scalar().alias("tangles"))


# --- hierarchy and calls
@query
def supertypes(spark, sf_dir):
    return Facts(spark, sf_dir).closure


@query
def subtype_pairs(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ca.reflexive(f.closure, f.bodies.select("class").distinct()).where("sup like 'n%'")


@query
def namesig_index(spark, sf_dir):
    return ca.namesig_index(Facts(spark, sf_dir).bodies).select("namesig", _joined("keys"))


@query
def instantiated_types(spark, sf_dir):
    return Facts(spark, sf_dir).instantiated


@query
def exact_dispatch(spark, sf_dir):
    return Facts(spark, sf_dir).resolved.where("how <> 'candidate'")


@query
def rta_dispatch(spark, sf_dir):
    return Facts(spark, sf_dir).resolved.where("how = 'candidate'").select("site", "target")


@query
def megamorphic_cut(spark, sf_dir):
    """Call sites with more candidates than a call may have, and what is left of them."""
    f = Facts(spark, sf_dir)
    many = ca.candidate_counts(f.sites.where("virtual and receiver is null"), f.bodies, f.closure, f.instantiated).where(F.col("n") > ca.POLYMORPHIC)
    left = f.resolved.groupBy("site").agg(F.count("*").alias("kept"))
    return many.join(left, "site", "left").select("site", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


@query
def call_graph(spark, sf_dir):
    return Facts(spark, sf_dir).calls.select("component", "m", "off", "kind", "callee", "is_async", "transact", F.col("rn").cast("long").alias("rn"))


def _named_calls(f: Facts) -> DataFrame:
    """site, declared, name: calls on the caller's customer class, of one of five names."""
    return f.instr.where("op = 'invoke'").select(F.col("off").alias("site"), F.concat(F.lit("c"), (F.col("m") + 1).cast("string")).alias("declared"), F.concat(F.lit("post"), (F.col("k") % 5).cast("string")).alias("name"))


@query
def async_by_name(spark, sf_dir):
    f = Facts(spark, sf_dir)
    entries = spark.createDataFrame([("post1",), ("c7.post2",)], "entry string")
    return _named_calls(f).join(F.broadcast(entries), ca.hit(F.col("entry"), F.col("declared"), F.col("name")), "left_semi")


def _bases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    bases = spark.createDataFrame([("n3", "post0"), ("n7", "post1"), ("r2", "post3"), ("r4", "post4")], "base string, name string")
    return bases, spark.createDataFrame([("post1",), ("c20.post4",), ("org.shop.c5.post3",)], "entry string")


@query
def async_by_hierarchy(spark, sf_dir):
    f = Facts(spark, sf_dir)
    bases, _ = _bases(spark)
    return ca.deferring(_named_calls(f), f.closure, bases, spark.createDataFrame([], "entry string"))


@query
def async_veto(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ca.deferring(_named_calls(f), f.closure, *_bases(spark))


# --- fixpoints
@query
def may_acquire(spark, sf_dir):
    return Facts(spark, sf_dir).may


@query
def may_saturated(spark, sf_dir):
    """With a cap of two locks a method: methods at the cap or over it, by their own locks."""
    f = Facts(spark, sf_dir)
    capped = fx.may_acquire(f.direct, ev.call_dag(f.calls), cap=2)
    return capped.groupBy("m").agg(F.count("*").alias("n"), F.min("lock").alias("least")).where("n >= 2").select("m", "n", "least")


@query
def must_entry_strict(spark, sf_dir):
    return Facts(spark, sf_dir).must_strict


@query
def must_entry_race(spark, sf_dir):
    return Facts(spark, sf_dir).must_race


def _sync_sites(f: Facts) -> DataFrame:
    return ev.call_dag(f.calls).select("component", F.col("off").alias("call"), "m", "line", "callee")


@query
def interproc_edges(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ed.interprocedural(_sync_sites(f), f.call_locks.select("call", "held"), f.may, f.must_strict)


@query
def method_edges(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ed.method_edges(_sync_sites(f), f.call_locks)


# --- process boundary
@query
def ipc_reach(spark, sf_dir):
    return Facts(spark, sf_dir).reach


@query
def ipc_outgoing(spark, sf_dir):
    return Facts(spark, sf_dir).outgoing.select("component", "m", "line", "callee", "direct", _joined("held"))


@query
def ipc_paths(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ipc.with_chains(f.outgoing, f.ipc_calls, f.reach).select("component", "m", "line", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query
def ipc_incoming(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return ipc.incoming(f.methods.where(ev.external(F.col("m"))), f.may, f.outgoing).select("component", "m", _joined("locks"), "high")


@query
def ipc_rank_by_lock(spark, sf_dir):
    return ipc.by_lock(Facts(spark, sf_dir).outgoing)


# --- races
@query
def field_tally(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return races.lock_tally(f.accesses).join(races.tally(f.accesses), ["component", "field"])


@query
def field_guard(spark, sf_dir):
    return Facts(spark, sf_dir).inferred.where("every").select("component", "field", "writes", "reads", _joined("accepted"))


@query
def guard_fallback(spark, sf_dir):
    return Facts(spark, sf_dir).inferred.where("not every").select("component", "field", "writes", "guarded_writes", _joined("accepted"))


@query
def race_violations(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return races.violations(f.accesses, f.inferred).select("component", "field", "m", "off", "line", "write", _joined("guards"))


@query
def race_report(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return races.report(f.accesses, races.reported(f.inferred))


@query
def race_entry_guards(spark, sf_dir):
    """Guards with the locks held on every entry as well."""
    f = Facts(spark, sf_dir)
    acc = ev.accesses(f.instr)
    return races.infer(races.guarded(acc, f.held(acc.select("m", "off")), f.must_race)).select("component", "field", "writes", "guarded_writes", _joined("accepted"))


# --- aliases
@query
def alias_unique(spark, sf_dir):
    """An order's status flag stands for a field's lock where all its lines agree; of large lines it is unknown."""
    f = Facts(spark, sf_dir)
    facts = f.read("lineitem").select(F.col("l_orderkey").alias("field"), F.when(F.col("l_quantity") < 45, F.col("l_returnflag")).alias("lock"))
    return al.unique(facts, ["field"], "lock")


@query
def alias_closure(spark, sf_dir):
    """Chains by halving: p leads to p / 2 while p is even."""
    f = Facts(spark, sf_dir)
    p = F.col("p_partkey")
    step = f.read("part").where((p > 0) & (p % 2 == 0)).select(p.alias("name"), (p / 2).cast("long").alias("target"))
    return al.follow(step)


# --- the text front end and the method flow, on the events written as instructions
def _text_lines(f: Facts) -> DataFrame:
    """path, at, t: each user as a disassembled method of a class of its component.

    An acquisition loads a static and enters it, a release leaves it; a view or click
    touches a field of the receiver.  Offsets are eight times the line, so that each
    event has its place.
    """
    off = F.lower(F.lpad(F.hex(F.col("line") * 8), 4, "0"))
    nxt = F.lower(F.lpad(F.hex(F.col("line") * 8 + 1), 4, "0"))
    ref = F.concat(F.lit("Lt/S;."), F.col("lock"), F.lit(":Ljava/lang/Object; // field@1"))
    say = lambda at, *parts: F.concat(F.lit("00: 0000 |"), at, F.lit(": "), *parts)
    both = lambda how: F.array(say(off, F.lit("sget-object v0, "), ref), say(nxt, F.lit(f"monitor-{how} v0")))
    touch = F.concat(F.lit("v1, v7, Lt/C"), F.col("component"), F.lit(";."), F.col("field"), F.lit(":I // field@2"))
    body = F.when(F.col("op") == "enter", both("enter")).when(F.col("op") == "exit", both("exit")).when(F.col("op") == "iget", F.array(say(off, F.lit("iget "), touch))).when(F.col("op") == "iput", F.array(say(off, F.lit("iput "), touch))).otherwise(F.array(say(off, F.lit("nop"))))
    own = f.instr.groupBy("component", "m").agg(F.array_sort(F.collect_list(F.struct("line", body.alias("b")))).alias("rows"))
    cls = F.concat(F.lit("t.C"), "component")
    head = F.array(
        F.concat(F.lit("Class descriptor  : 'Lt/C"), "component", F.lit(";'")), F.lit("Superclass        : 'Ljava/lang/Object;'"), F.lit("Virtual methods   -"), F.concat(F.lit("name          : 'm"), "m", F.lit("'")),
        F.lit("access        : 0x0001 (PUBLIC)"), F.lit("registers     : 8"), F.lit("ins           : 1"), F.concat(F.lit("00:  |[000148] "), cls, F.lit(".m"), "m", F.lit(":()V")),
    )
    places = F.transform("rows", lambda x: F.concat(F.lit("0x"), F.lower(F.hex(x["line"] * 8)), F.lit(" line="), x["line"].cast("string")))
    whole = F.concat(head, F.flatten(F.transform("rows", lambda x: x["b"])), F.array(F.lit("catches       : (none)"), F.lit("positions     :")), places, F.array(F.lit("locals        :")))
    return own.select(F.col("m").cast("string").alias("path"), F.posexplode(whole).alias("at", "t"))


def _flow(f: Facts) -> DataFrame:
    from lockweave.operators import flow
    from lockweave.sources import disassembly

    facts = disassembly.parse(f.once("text", lambda: _text_lines(f)))
    return f.once("flow", lambda: flow.facts(facts.methods, facts.insns.withColumn("effect", F.lit(None).cast("string")), facts.positions, facts.catches))


def _method(key: str = "mkey"):
    return F.regexp_extract(key, r"\.m([0-9]+):", 1).cast("long")


def _lock_name(column):
    return F.regexp_extract(column, r"\|(L[0-9]+)\|", 1)


@query
def flow_order_edges(spark, sf_dir):
    """The same orders as from the event table, by way of text, parser and method flow."""
    edge = _flow(Facts(spark, sf_dir)).where("fact = 'edge'")
    return edge.select(_method().alias("m"), F.col("line").cast("long").alias("line"), _lock_name("a").alias("src"), _lock_name("b").alias("dst"))


@query
def flow_field_access(spark, sf_dir):
    """Field accesses with the locks held, by way of text, parser and method flow."""
    acc = _flow(Facts(spark, sf_dir)).where("fact = 'access'")
    guards = F.array_join(F.array_sort(F.transform("list", _lock_name)), ",")
    return acc.select(_method().alias("m"), F.col("line").cast("long").alias("line"), F.substring_index("a", ".", -1).alias("field"), F.col("flag").alias("write"), guards.alias("guards"))


# --- names, lines and text
@query
def line_asof(spark, sf_dir):
    """The line of the last acquisition before each other instruction."""
    f = Facts(spark, sf_dir)
    return names.line_asof(f.instr.where("op <> 'enter'").select("m", "off"), f.enters)


@query
def catch_range(spark, sf_dir):
    """Ranges from each acquisition to the next instruction but five of its method."""
    f = Facts(spark, sf_dir)
    hi = F.lead("off", 5).over(Window.partitionBy("m").orderBy("off"))
    r = f.instr.withColumn("hi", hi).where("op = 'enter' and hi is not null and k % 10 = 0").select("m", F.col("off").alias("lo"), "hi", F.col("hi").alias("handler"))
    return names.catches(f.instr.where("op = 'iput'").select("m", "off"), r)


@query
def value_summary(spark, sf_dir):
    f = Facts(spark, sf_dir)
    returns = f.read("lineitem").select(F.col("l_orderkey").alias("m"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("value"))
    return names.single_value(returns, "m", "value")


@query
def class_filter(spark, sf_dir):
    """Entry methods, by access bits and name, of the suppliers."""
    f = Facts(spark, sf_dir)
    access = F.col("s_suppkey").bitwiseAND(15)
    name = F.when(F.col("s_nationkey") == 0, "<init>").when(F.col("s_nationkey") == 1, "lambda$run").otherwise(F.concat(F.lit("m"), F.col("s_nationkey")))
    return f.read("supplier").where(names.is_entry(access, name)).select(F.col("s_suppkey").alias("m"), name.alias("name"))


@query
def short_names(spark, sf_dir):
    f = Facts(spark, sf_dir)
    key = F.concat(F.lit("org.shop."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("."), F.concat(F.lit("get"), "p_size"), F.lit(":(I)V"))
    return f.read("part").select("p_partkey", names.class_of(key).alias("class"), names.namesig_of(key).alias("namesig"), names.short_method(key).alias("short"), names.short_lock(names.class_of(key)).alias("lock"))


@query
def access_flags(spark, sf_dir):
    """Static, external and the receiver's register, from access bits and register counts."""
    f = Facts(spark, sf_dir)
    access = F.col("s_suppkey").bitwiseAND(15)
    return f.read("supplier").select("s_suppkey", names.is_static(access).alias("static"), names.is_external(access).alias("external"), names.this_register(F.col("s_suppkey") % 7, F.col("s_nationkey") % 9).cast("long").alias("this"))


@query
def lock_targets(spark, sf_dir):
    """What to look for in the sources: the field of a lock, or the class of a monitor."""
    f = Facts(spark, sf_dir)
    end = F.element_at(F.array(*map(F.lit, (".mLock", ".mLock.read", ".mLock.write", ".class", "@this"))), (F.col("p_size") % 5 + 1).cast("int"))
    return f.read("part").select("p_partkey", names.lock_target(F.concat(F.lit("org.Shop"), F.col("p_partkey") % 9, end)).alias("target"))


@query
def escaped_labels(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return f.read("part").select("p_partkey", names.escaped(F.concat(F.lit('"'), "p_name", F.lit("\\"))).alias("label"))


@query
def sample_places(spark, sf_dir):
    """Method and line of evidence written as key:line; each third has no line."""
    f = Facts(spark, sf_dir)
    at = names.sample_parts(F.concat(F.lit("a.B.m"), "p_size", F.lit(":()V"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(":"), "p_partkey")).otherwise("")))
    return f.read("part").select("p_partkey", at[0].alias("mkey"), at[1].alias("line"))


@query
def dotted_names(spark, sf_dir):
    f = Facts(spark, sf_dir)
    return f.read("nation").select("n_nationkey", names.dotted(F.concat(F.lit("La/b/"), "n_name", F.lit(";"))).alias("dotted"), names.dotted(F.col("n_name")).alias("plain"))


@query
def first_wins_dedup(spark, sf_dir):
    f = Facts(spark, sf_dir)
    rows = f.read("events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("mkey"), "event_id")
    return names.first_wins(rows, ["mkey"], "event_id")


@query
def word_sites(spark, sf_dir):
    """Lines that hold a word of the source."""
    f = Facts(spark, sf_dir)
    return f.source.where(names.has_word(F.col("text"), "the")).select("path", "line_no")


@query
def context_window(spark, sf_dir):
    """Two lines above and one below each line that holds a rarer word."""
    f = Facts(spark, sf_dir)
    lines = f.source
    around = names.context(lines, lines.where(names.has_word(F.col("text"), "edble")).select("path", "line_no"), 2, 1)
    return around.select("path", "site", "line_no", F.length("text").cast("long").alias("n"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the whole lock-order graph, with the locks of each."""
    f = Facts(spark, sf_dir)
    return f.scc(1).groupBy("component", "rep").agg(F.array_join(F.array_sort(F.collect_set("lock")), ",").alias("locks"), F.count("*").alias("size"))
