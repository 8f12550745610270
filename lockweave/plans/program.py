"""A whole program from its disassembly: contradictory lock orders, locks across process boundaries, inconsistently guarded fields."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.functions import locks as lk
from lockweave.functions import names
from lockweave.operators import alias as al
from lockweave.operators import calls as ca
from lockweave.operators import flow, fixpoint, graph, ipc, races
from lockweave.plans.loop import grow, settle
from lockweave.sources import source_tree
from lockweave.sources.async_config import SUPERS, AsyncConfig
from lockweave.sources.disassembly import Facts

#: The types that a transaction is called on, and the type that servers extend.
TRANSACTED, SERVER = ("android.os.IBinder", "android.os.BinderProxy", "android.os.Binder"), "android.os.Binder"
#: Locks above which a component is a tangle.
TANGLE = 12


class Program:
    """Everything is made when first asked for; what several rules share is written once."""

    def __init__(self, facts: Facts, config: AsyncConfig | None = None):
        self.facts, self.config = facts, config or AsyncConfig()
        self.spark = facts.methods.sparkSession

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def methods(self) -> DataFrame:
        return settle(names.first_wins(self.facts.methods, ["mkey"], "ord").drop("ord"), "methods")

    @cached_property
    def wide(self) -> DataFrame:
        """All facts; first without, then with the values that getters return."""
        f, c = self.facts, self.config
        insns = settle(flow.classified(f.insns, self._table(c.known(), "cls string, member string"), self._table([(x,) for x in sorted(c.add)], "entry string"), self._table([(x,) for x in sorted(c.remove)], "entry string")), "insns")
        getters = settle(flow.facts(f.methods, insns, f.positions, f.catches).where("fact = 'value'").select("mkey", "a"), "getters")
        return settle(flow.facts(f.methods, insns, f.positions, f.catches, getters), "facts")

    def fact(self, name: str) -> DataFrame:
        return self.wide.where(F.col("fact") == name)

    # --- types
    @cached_property
    def supers(self) -> DataFrame:
        up = self.facts.classes.select(F.col("class").alias("sub"), F.explode(F.concat(F.coalesce("interfaces", F.array().cast("array<string>")), F.when(F.col("super").isNotNull(), F.array("super")).otherwise(F.array().cast("array<string>")))).alias("sup"))
        return settle(ca.supertypes(settle(up, "up")), "supers")

    @cached_property
    def calls(self) -> DataFrame:
        """site, mkey, class, kind, declared, namesig, receiver, args, held, line, is_async."""
        c = self.fact("call").select(
            F.concat_ws("@", "mkey", F.col("seq").cast("string")).alias("site"), "mkey", "class", F.col("a").alias("kind"), F.col("b").alias("declared"), F.col("c").alias("namesig"), F.get("args", F.lit(0)).alias("receiver"),
            F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))).alias("args"), F.col("list").alias("held"), "line", F.col("flag").alias("named_async"),
        )
        c = c.withColumn("name", F.substring_index("namesig", ":", 1))
        known = self._table([(t, s) for t, ss in SUPERS.items() for s in ss], "sub string, sup string")
        whole = ca.supertypes(settle(self.facts.classes.select("class").where("false").select(F.col("class").alias("sub"), F.col("class").alias("sup")).union(self.supers).union(known), "ups"))
        bases = self._table(self.config.bases(), "base string, name string")
        veto = self._table([(x,) for x in sorted(self.config.remove)], "entry string")
        late = ca.deferring(c.select("site", "declared", "name"), whole, bases, veto).distinct().withColumn("late", F.lit(True))
        return settle(c.join(late, "site", "left").withColumn("is_async", F.col("named_async") | F.coalesce("late", F.lit(False))).drop("late", "named_async"), "calls")

    @cached_property
    def targets(self) -> DataFrame:
        """site, target: the bodies that each call may run."""
        own = self.methods.select("class", F.concat_ws(":", "name", "sig").alias("namesig"), "mkey")
        live = self.fact("alloc").select(F.col("b").alias("class")).distinct()
        sites = self.calls.select("site", F.col("kind").isin("virtual", "interface").alias("virtual"), "declared", "receiver", "namesig")
        return settle(ca.dispatch(sites, own, self.supers, live).select("site", "target").distinct(), "targets")

    @cached_property
    def sync(self) -> DataFrame:
        """Synchronous calls with one of their targets as callee."""
        return self.calls.where("not is_async").join(self.targets, "site").withColumnRenamed("target", "callee")

    # --- aliases of lock fields
    @cached_property
    def captures(self) -> DataFrame:
        """mkey, field, formal: what constructors keep of their arguments, through the constructors they chain to."""
        own = self.fact("capture").select("mkey", F.col("a").alias("field"), F.col("seq").alias("formal"))
        chain = settle(self.fact("super").select("mkey", F.col("a").alias("up"), F.col("args").alias("map")), "chain")

        def step(d: DataFrame) -> DataFrame:
            below = d.withColumnsRenamed({"mkey": "up", "formal": "at"}).join(chain, "up")
            return below.select("mkey", "field", F.get("map", F.col("at")).try_cast("int").alias("formal")).where("formal is not null")

        return grow(own, step, name="captures")

    @cached_property
    def aliases(self) -> DataFrame:
        """name, lock: fields that always name one other lock."""
        direct = self.fact("alias").select(F.col("a").alias("name"), F.col("b").alias("lock"))
        built = self.fact("init").select(F.col("b").alias("mkey"), "args").join(self.captures, "mkey")
        arg = F.get("args", F.col("formal"))
        passed = built.select(F.col("field").alias("name"), F.when(lk.kind(arg).isin("r", "s") & (lk.name(arg) != F.col("field")), arg).alias("lock"))
        seen = settle(direct.union(passed), "seen")
        agreed = al.unique(seen, ["name"], "lock")
        # a class that locks itself and is kept in one field only
        itself = self.fact("acquire").where(lk.kind(F.col("a")) == "t").select("class").distinct()
        kept = self.fact("store").select(F.col("b").alias("class"), F.col("a").alias("name")).distinct()
        single = kept.join(kept.groupBy("class").agg(F.count("*").alias("n")).where("n = 1"), "class").join(itself, "class", "left_semi")
        alone = al.unique(single.join(seen.select("name"), "name", "left_anti").select("name", lk.make(F.lit("r"), F.col("class"), F.lit(""), F.lit("")).alias("lock")), ["name"], "lock")
        return settle(agreed.union(alone), "aliases")

    @cached_property
    def led(self) -> DataFrame:
        """name, lock: where a name leads after at most six steps; a lock of another kind than a field or instance ends it."""
        step = self.aliases
        at = step.withColumn("n", F.lit(1))
        for _ in range(al.HOPS - 1):
            on = step.select(F.col("name").alias("mid"), F.col("lock").alias("next"))
            go = F.when(lk.kind(F.col("lock")).isin("r", "s"), lk.plain_name(F.col("lock")))
            at = settle(at.withColumn("mid", go).join(on, "mid", "left").select("name", F.coalesce("next", "lock").alias("lock"), "n"), "led")
        return at.select("name", "lock")

    def resolved(self, rows: DataFrame, column: str, race: bool = False) -> DataFrame:
        """``rows`` (with mkey and class) with a lock column grounded and led to what it names."""
        lock = lk.grounded(F.col(column), F.col("class"), F.col("mkey"))
        lock = lk.outer(lock) if race else lock
        base = rows.withColumn(column, lock)
        key = F.when(lk.kind(F.col(column)).isin("r", "s"), lk.plain_name(F.col(column)))
        led = self.led.select(F.col("name").alias("_name"), F.col("lock").alias("_lock"))
        return base.withColumn("_key", key).join(led, F.col("_key") == F.col("_name"), "left").withColumn(column, F.when(F.col("_lock").isNotNull(), lk.with_mode(F.col("_lock"), lk.part(F.col(column), 3))).otherwise(F.col(column))).drop("_key", "_name", "_lock")

    @cached_property
    def call_held(self) -> DataFrame:
        """site, held (resolved): of synchronous calls."""
        each = self.calls.where("not is_async").select("site", "mkey", "class", F.explode("held").alias("held"))
        return settle(self.resolved(each, "held").select("site", "mkey", "held").distinct(), "call_held")

    # --- fixpoints
    @cached_property
    def may(self) -> DataFrame:
        """mkey, lock (in the method's own terms): what it or its callees may take."""
        edge = settle(self.sync.select("mkey", "callee", "args").distinct(), "edges")
        known = delta = settle(self.fact("acquire").where(~lk.is_opaque(F.col("a"))).select("mkey", F.col("a").alias("lock")).distinct(), "may")
        from pyspark.sql.window import Window

        for _ in range(fixpoint.MAY_ROUNDS):
            came = delta.select(F.col("mkey").alias("callee"), "lock").join(edge, "callee").select("mkey", lk.bound(F.col("lock"), F.col("args")).alias("lock"))
            news = came.where(F.col("lock").isNotNull() & ~lk.is_opaque(F.col("lock"))).distinct().join(known, ["mkey", "lock"], "left_anti")
            full = known.groupBy("mkey").agg(F.count("*").alias("n"))
            rank = F.row_number().over(Window.partitionBy("mkey").orderBy(lk.name(F.col("lock")), "lock"))
            delta = settle(news.withColumn("r", rank).join(full, "mkey", "left").where(F.col("r") + F.coalesce("n", F.lit(0)) <= fixpoint.MAY_CAP).select("mkey", "lock"), "may")
            if delta.isEmpty():
                break
            known = known.union(delta)
        return known

    def _must(self, rooted: bool) -> DataFrame:
        """m, lock (by name): held on every entry; roots are methods without a caller, and with ``rooted`` all that others may call."""
        edge = settle(self.sync.select(F.col("site").alias("call"), F.col("mkey").alias("m"), "callee").distinct(), "must_edges")
        held = self.call_held.where(~lk.is_local(F.col("held"))).select(F.col("site").alias("call"), lk.name(F.col("held")).alias("held"))
        m = self.methods.select(F.col("mkey").alias("m"), names.is_external(F.col("access")).alias("external"))
        called = edge.select(F.col("callee").alias("m")).distinct().withColumn("called", F.lit(True))
        roots = m.join(called, "m", "left").where(F.col("called").isNull() | (F.col("external") & F.lit(rooted)))
        return settle(fixpoint.must_entry(m, edge, held, roots.select("m")), "must")

    @cached_property
    def must(self) -> DataFrame:
        return self._must(True)

    @cached_property
    def must_races(self) -> DataFrame:
        return self._must(False)

    # --- lock order
    @cached_property
    def edges(self) -> DataFrame:
        """component, src, dst (names), mkey, line, interproc, guard (names): evidence of an order, within methods and through calls."""
        must = self.must.select(F.col("m").alias("mkey"), F.col("lock").alias("dst"))
        one = self.fact("edge").select("mkey", "class", "line", F.col("a").alias("from"), F.col("b").alias("to"), F.col("list").alias("guard"), F.monotonically_increasing_id().alias("id"))
        own = settle(one, "own_edges")
        ends = self.resolved(self.resolved(own, "from"), "to")
        guard = self.resolved(own.select("id", "mkey", "class", F.explode("guard").alias("g")), "g").groupBy("id").agg(F.array_sort(F.collect_set(lk.name(F.col("g")))).alias("guard"))
        inner = ends.drop("guard").join(guard, "id").select("mkey", "line", "from", "to", F.lit(False).alias("interproc"), "guard")
        held = self.call_held.select("site", F.col("held").alias("from"))
        guards = self.call_held.groupBy("site").agg(F.collect_set(lk.name(F.col("held"))).alias("held"))
        taken = self.sync.select("site", "mkey", "class", "line", "callee", "args").join(self.may.select(F.col("mkey").alias("callee"), "lock"), "callee")
        taken = taken.withColumn("to", lk.bound(F.col("lock"), F.col("args"))).where("to is not null")
        got = self.resolved(taken.select("site", "mkey", "class", "line", "to"), "to").distinct()
        fresh = got.join(held.withColumnRenamed("from", "to"), ["site", "to"], "left_anti")
        outer = fresh.join(held, "site").join(guards, "site").select("mkey", "line", "from", "to", F.lit(True).alias("interproc"), F.array_sort(F.array_union("held", F.array(lk.name(F.col("to"))))).alias("guard"))
        every = inner.union(outer).where((F.col("from") != F.col("to")) & ~lk.is_opaque(F.col("from")) & ~lk.is_opaque(F.col("to")))
        named = every.select(F.lit("").alias("component"), "mkey", "line", lk.name(F.col("from")).alias("src"), lk.name(F.col("to")).alias("dst"), "interproc", "guard")
        return settle(named.join(must, ["mkey", "dst"], "left_anti").select("component", "src", "dst", "mkey", "line", "interproc", "guard"), "order")

    @cached_property
    def scc(self) -> DataFrame:
        return settle(graph.strong_components(self.edges), "scc")

    @cached_property
    def guarded(self) -> DataFrame:
        return settle(graph.scc_guard(self.edges, self.scc), "guards")

    def components(self) -> DataFrame:
        """rep, locks, guard (empty: a candidate; else suppressed), tangle."""
        whole = self.scc.groupBy("component", "rep").agg(F.array_sort(F.collect_set("lock")).alias("locks"))
        none = F.array().cast("array<string>")
        return whole.join(self.guarded, ["component", "rep"], "left").select("rep", "locks", F.coalesce("guard", none).alias("guard"), (F.size("locks") > TANGLE).alias("tangle"))

    def deadlocks(self) -> DataFrame:
        return self.components().where(F.size("guard") == 0)

    @cached_property
    def inversions(self) -> DataFrame:
        """rep, cycle, guard: minimal cycles of the candidates."""
        cycles = settle(graph.minimal_cycles(self.edges, self.scc), "cycles")
        guard = graph.cycle_guard(self.edges, cycles)
        none = F.array().cast("array<string>")
        return cycles.join(guard, ["component", "cycle"], "left").select("rep", "cycle", F.coalesce("guard", none).alias("guard"))

    def order_samples(self) -> DataFrame:
        """src, dst, n, interproc (all of it), mkey, line: each edge's evidence, with the first place that has a line."""
        first = F.min(F.when(F.col("line").isNotNull(), F.struct("mkey", "line")))
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.bool_and("interproc").alias("interproc"), first.alias("f")).select("src", "dst", "n", "interproc", "f.mkey", "f.line")

    # --- process boundary
    @cached_property
    def transacting(self) -> Column:
        return (F.col("name") == "transact") & F.col("declared").isin(*TRANSACTED)

    @cached_property
    def reach(self) -> DataFrame:
        """m: methods that make a transaction or lead to one."""
        seeds = self.calls.where(self.transacting).select(F.col("mkey").alias("m")).distinct()
        return settle(fixpoint.reaching(self.sync.select(F.col("mkey").alias("m"), "callee"), seeds), "reach")

    @cached_property
    def outgoing(self) -> DataFrame:
        """mkey, line, held (names), path."""
        held = self.call_held.where(~lk.is_local(F.col("held"))).groupBy("site").agg(F.array_sort(F.collect_set(lk.name(F.col("held")))).alias("held"))
        via = self.sync.join(self.reach.select(F.col("m").alias("callee")), "callee", "left_semi").select("site").distinct().withColumn("via", F.lit(True))
        sites = self.calls.where("not is_async").withColumn("direct", self.transacting).select("site", "mkey", "line", "direct").join(via, "site", "left").where("direct or via")
        found = sites.where(~F.contains("mkey", F.lit("$Stub$Proxy"))).join(held, "site").select("mkey", "line", "held").distinct()
        live = self.sync.select(F.col("mkey").alias("m"), "callee").join(self.reach.select(F.col("m").alias("callee")), "callee", "left_semi")
        ways = fixpoint.chains(live, found.select(F.col("mkey").alias("m")), self.calls.where(self.transacting).select(F.col("mkey").alias("m")))
        return settle(found.join(ways.select(F.col("m").alias("mkey"), "path"), "mkey"), "outgoing")

    def incoming(self) -> DataFrame:
        """mkey, locks, high: entry methods of servers that may take locks."""
        servers = self.supers.where(F.col("sup") == SERVER).select(F.col("sub").alias("class"))
        entries = self.methods.where(names.is_entry(F.col("access"), F.col("name"))).join(servers, "class", "left_semi").select("mkey")
        led = self.led.select(F.col("name").alias("_n"), F.col("lock").alias("_l"))
        may = self.may.where(~lk.is_local(F.col("lock"))).join(led, F.when(lk.kind(F.col("lock")).isin("r", "s"), lk.plain_name(F.col("lock"))) == F.col("_n"), "left")
        may = may.select(F.col("mkey").alias("m"), lk.name(F.when(F.col("_l").isNotNull(), lk.with_mode(F.col("_l"), lk.part(F.col("lock"), 3))).otherwise(F.col("lock"))).alias("lock"))
        found = ipc.incoming(entries.select(F.lit("").alias("component"), F.col("mkey").alias("m")), may, self.outgoing.select(F.col("mkey").alias("m")))
        return found.select(F.col("m").alias("mkey"), "locks", "high")

    # --- races
    @cached_property
    def accesses(self) -> DataFrame:
        acc = self.fact("access").withColumn("id", F.concat_ws("@", "mkey", F.col("seq").cast("string")))
        rows = acc.select("id", "mkey", "class", F.explode("list").alias("held")).where(~lk.is_local(F.col("held")))
        # a parameter's lock, once grounded, is unknown as well
        held = self.resolved(rows, "held", race=True).where(~lk.is_local(F.col("held"))).select(F.col("mkey").alias("m"), F.col("id").alias("off"), lk.name(F.col("held")).alias("held")).distinct()
        field = F.coalesce(F.concat_ws(".", F.when(F.col("b").isNotNull(), F.col("b")), F.when(F.col("b").isNotNull(), F.substring_index("a", ".", -1))), F.col("a"))
        field = F.when(F.col("b").isNotNull(), field).otherwise(F.col("a"))
        points = acc.select(F.lit("").alias("component"), F.col("mkey").alias("m"), F.col("id").alias("off"), "line", F.col("a").alias("plain"), field.alias("field"), F.col("flag").alias("write"))
        return settle(races.guarded(points, held, self.must_races), "accesses")

    @cached_property
    def inferred(self) -> DataFrame:
        """Guards by the accesses of fields that aren't final or volatile."""
        counted = self.accesses.join(self.facts.flags.select(F.col("field").alias("plain")), "plain", "left_anti")
        return settle(races.infer(counted).where("writes > 0 and guarded_writes > 0"), "inferred")

    def races(self, min_writes: int = races.MIN_WRITES, min_coverage: int = races.MIN_COVERAGE, field: str | None = None, guard: str | None = None) -> DataFrame:
        return races.report(self.accesses, races.reported(self.inferred, min_writes, min_coverage, field, guard))

    # --- evidence
    @cached_property
    def takers(self) -> DataFrame:
        """lock (name), m: methods that take a lock themselves."""
        own = self.fact("acquire").where(~lk.is_opaque(F.col("a"))).select("mkey", "class", F.col("a").alias("lock"))
        return settle(self.resolved(own, "lock").select(lk.name(F.col("lock")).alias("lock"), F.col("mkey").alias("m")).distinct(), "takers")

    def locks(self) -> DataFrame:
        """lock: the names of all locks that a method takes or an edge has, with or without an order."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("lock"))
        return self.takers.select("lock").union(ends).distinct()

    def lock_paths(self, wanted: DataFrame, most: int = 16) -> DataFrame:
        """lock, m, path of ``wanted`` (lock, m): the shortest chain of calls from a method to one that takes the lock itself.

        All locks at once: a node is a method beside a lock, so that chains to different
        locks don't mix; a chain has ``most`` steps at most, and who has none no row.
        """
        key = lambda m: F.concat_ws("\0", "lock", m)
        asked = settle(wanted.select("lock", "m").distinct(), "asked")
        edge = settle(self.sync.select("mkey", "callee").distinct(), "edges")
        ends = self.takers.join(asked.select("lock").distinct(), "lock", "left_semi")
        up = grow(ends, lambda d: d.join(edge, d["m"] == edge["callee"]).select("lock", F.col("mkey").alias("m")), most=most, name="leads")
        live = up.withColumnRenamed("m", "callee").join(edge, "callee").select(key("mkey").alias("m"), key("callee").alias("callee"))
        ways = fixpoint.chains(live, asked.join(up, ["lock", "m"], "left_semi").select(key("m").alias("m")), ends.select(key("m").alias("m")), most)
        plain = ways.select(F.split("m", "\0").alias("k"), F.transform("path", lambda x: F.get(F.split(x, "\0"), F.lit(1))).alias("path"))
        found = plain.select(F.get("k", F.lit(0)).alias("lock"), F.get("k", F.lit(1)).alias("m"), "path")
        return found.join(self.takers.select("lock", F.col("m").alias("last")), ["lock"]).where(F.element_at("path", -1) == F.col("last")).drop("last")

    def candidates(self, max_locks: int = 6) -> DataFrame:
        """locks, kind: components of up to ``max_locks`` locks, and of larger ones the minimal cycles of that size without a guard."""
        small = self.deadlocks().where(F.size("locks") <= max_locks).select("locks", F.lit("component").alias("kind"))
        large = self.deadlocks().where(F.size("locks") > max_locks).select("rep")
        cut = self.inversions.join(large, "rep", "left_semi").where((F.size("cycle") <= max_locks) & (F.size("guard") == 0)).select(F.col("cycle").alias("locks"), F.lit("inversion").alias("kind"))
        return small.union(cut)

    def candidate_counts(self, max_locks: int = 6) -> dict[str, int]:
        """How many candidates there are, and how many inversions a common guard or their size leaves out."""
        large = self.deadlocks().where(F.size("locks") > max_locks).select("rep")
        cut = self.inversions.join(large, "rep", "left_semi")
        left = cut.agg(F.count_if(F.size("guard") > 0).alias("gated"), F.count_if((F.size("guard") == 0) & (F.size("cycle") > max_locks)).alias("oversize")).first()
        kinds = {r["kind"]: r["count"] for r in self.candidates(max_locks).groupBy("kind").count().collect()}
        return {"components": kinds.get("component", 0), "inversions": kinds.get("inversion", 0), "gated": left["gated"], "oversize": left["oversize"]}

    def candidate_edges(self, max_locks: int = 6) -> DataFrame:
        """locks, kind, src, dst, n, m, line: the orders among each candidate's locks, joined by one end."""
        each = self.candidates(max_locks).select("locks", "kind", F.explode("locks").alias("src"))
        return each.join(self.order_samples().withColumnRenamed("mkey", "m"), "src").where(F.array_contains("locks", F.col("dst")))

    def located(self, max_locks: int = 6, sources: str | None = None) -> DataFrame:
        """``candidate_edges`` with path (of calls to where the second lock is taken), file, snippet, late, taken, site.

        With ``sources``, the root of a tree, an order's site counts if the file of the
        method's class is there; taken is then the first line that takes the lock in the
        file of the last method's class.  Without, a line number is a site.
        """
        edges = settle(self.candidate_edges(max_locks), "candidate_edges")
        ways = self.lock_paths(edges.where("m is not null").select(F.col("dst").alias("lock"), "m"))
        rows = settle(edges.join(ways.withColumnRenamed("lock", "dst"), ["dst", "m"], "left"), "ways")
        none = F.lit(None).cast("string")
        if sources is None:
            return rows.withColumns({"file": none, "snippet": none, "late": F.lit(False), "taken": none, "site": F.col("line").isNotNull()})
        lines = settle(source_tree.index(self.spark, sources), "sources")
        cls = lambda m: F.regexp_extract(m, r"^(.*)\.[^.:]*(:|$)", 1)
        keyed = rows.withColumns({"class": cls(F.col("m")), "end": cls(F.element_at("path", -1))})
        shown = settle(source_tree.evidence(keyed, lines), "shown").withColumn("site", F.col("file").isNotNull() & F.col("line").isNotNull())
        # where the lock's field is taken in the class that takes it
        target = F.substring_index(names.lock_target(F.col("dst")), ".", -1)
        ends = keyed.where("end is not null").select(F.col("end").alias("class"), target.alias("target")).distinct()
        files = ends.join(source_tree.file_for(ends.select("class"), lines), "class")
        sites = settle(source_tree.taking(files, lines), "taking").groupBy("class", "target").agg(F.min(F.struct("line_no", "path", "text")).alias("t"))
        first = sites.select(F.col("class").alias("end"), "target", F.concat(source_tree.relative(F.col("t.path"), sources), F.lit(":"), F.col("t.line_no"), F.lit("  "), F.trim("t.text")).alias("taken"))
        whole = shown.withColumn("target", target).join(first, ["end", "target"], "left")
        return settle(whole.withColumn("file", source_tree.relative(F.col("file"), sources)).drop("end", "target", "class"), "located")

    def verify(self, max_locks: int = 6, sources: str | None = None) -> DataFrame:
        """locks, kind, edges, located, verdict: of each candidate's orders, how many have both a site and a chain of calls."""
        whole = self.located(max_locks, sources).groupBy("locks", "kind").agg(F.count("*").alias("edges"), F.count_if(F.col("site") & F.col("path").isNotNull()).alias("located"))
        verdict = F.when(F.col("located") >= 2, "both").when(F.col("located") == 1, "one").otherwise("unresolved")
        return whole.withColumn("verdict", verdict)

    def boundary_steps(self, direction: str = "both", lock: str | None = None, holder: str | None = None) -> DataFrame:
        """m, lock, callee: the steps of the chains that hold a lock towards a transaction, and of those from an entry to a lock it may take."""
        way = ipc.direction(direction)
        steps = lambda path, end: F.transform(path, lambda x, i: F.struct(x.alias("m"), F.coalesce(F.get(path, i + 1), end).alias("callee")))
        parts = []
        if way != "in":
            out = ipc.keep(self.outgoing, "held", lock, holder).select(F.get("held", F.lit(0)).alias("lock"), F.explode(steps(F.col("path"), F.lit("transaction"))).alias("s"))
            parts.append(out.select("s.m", "lock", "s.callee"))
        if way != "out":
            asked = ipc.keep(self.incoming(), "locks", lock, holder).select(F.explode("locks").alias("lock"), F.col("mkey").alias("m"))
            into = self.lock_paths(asked).select("lock", F.explode(steps(F.col("path"), F.col("lock"))).alias("s"))
            parts.append(into.select("s.m", "lock", "s.callee"))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
