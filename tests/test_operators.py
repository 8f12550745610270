"""The relational operators against small brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from lockweave.functions import names
from lockweave.operators import alias, calls, fixpoint, graph, held, ipc, races
from lockweave.operators import edges as ed
from lockweave.plans.loop import grow, settle


def edges(spark, pairs):
    return spark.createDataFrame([("", a, b, list(g)) for a, b, g in pairs], "component string, src string, dst string, guard array<string>")


def test_held_sets_against_simulation(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for m in range(15):
        count = {}
        for off in range(40):
            lock = rng.choice("ABCD")
            want |= {(m, off, k) for k, n in count.items() if n}
            d = rng.choice([1, 1, -1, 0])
            if d:
                rows.append((m, off, lock, d))
                count[lock] = max(0, count.get(lock, 0) + d)
    points = spark.createDataFrame([(m, off) for m in range(15) for off in range(40)], "m long, off long")
    got = held.held_at(points, spark.createDataFrame(rows, "m long, off long, lock string, d int")).collect()
    assert {(r["m"], r["off"], r["held"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(
    ("pairs", "cycles"),
    [
        ("AB BC CD DE EA", ["ABCDE"]),
        ("AB BA BC CB", ["AB", "BC"]),
        ("AB BC CD DA BD", ["ABCD", "ABD"]),
    ],
)
def test_minimal_cycles(spark, pairs, cycles):
    e = edges(spark, [(p[0], p[1], "") for p in pairs.split()])
    got = graph.minimal_cycles(e, graph.strong_components(e)).collect()
    assert sorted("".join(r["cycle"]) for r in got) == cycles


def test_guards(spark):
    e = edges(spark, [("A", "B", "GAB"), ("B", "A", "GAB"), ("B", "C", "BC"), ("C", "B", "CB")])
    scc = graph.strong_components(e)
    cycles = graph.minimal_cycles(e, scc)
    assert [("".join(r["cycle"]), r["guard"]) for r in graph.cycle_guard(e, cycles).collect()] == [("AB", ["G"])]
    assert graph.scc_guard(e, scc).collect() == []


def test_must_entry_against_meet(spark):
    rng = random.Random(3)
    for _ in range(3):
        calls_, have = [], []
        for c in range(18):
            a, b = rng.randint(0, 8), rng.randint(0, 8)
            calls_.append((c, a, b))
            have += [(c, k) for k in "XYZ" if rng.random() < 0.5]
        roots = {0, 5}
        must = {m: (set() if m in roots else None) for m in range(9)}
        changed = True
        while changed:
            changed = False
            for c, a, b in calls_:
                if must[a] is not None and b not in roots:
                    new = must[a] | {k for x, k in have if x == c}
                    new = new if must[b] is None else must[b] & new
                    if new != must[b]:
                        must[b], changed = new, True
        got = fixpoint.must_entry(spark.createDataFrame([(m,) for m in range(9)], "m long"), spark.createDataFrame(calls_, "call long, m long, callee long"), spark.createDataFrame(have, "call long, held string"), spark.createDataFrame([(m,) for m in roots], "m long"))
        assert {(r["m"], r["lock"]) for r in got.collect()} == {(m, k) for m, ks in must.items() for k in ks or ()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_settled_tables_stay_off_the_driver(spark):
    """Rounds and what reads their tables shuffle: small files don't make them broadcast."""
    edge = settle(spark.createDataFrame([(i, i, i + 1) for i in range(6)], "call long, m long, callee long"))
    seen = []

    def step(delta):
        news = delta.join(edge, "m").select(F.col("callee").alias("m"))
        seen.append(_plan(news))
        return news

    assert grow(spark.createDataFrame([(0,)], "m long"), step).count() == 7
    have = settle(spark.createDataFrame([(i, k) for i in range(6) for k in "XY"], "call long, held string"))
    methods = settle(spark.createDataFrame([(i,) for i in range(7)], "m long"))
    must = fixpoint.must_entry(methods, edge, have, methods.where("m = 0"))
    assert must.count() == 12
    again = guarded_by(spark, settle(must))
    assert all("Broadcast" not in x for x in [*seen, _plan(must), _plan(again)])


def guarded_by(spark, must):
    acc = settle(spark.createDataFrame([("", 1, 5, "f", True)], "component string, m long, off long, field string, write boolean"))
    got = races.guarded(acc, settle(spark.createDataFrame([(1, 5, "Z")], "m long, off long, held string")), must)
    assert [r["guards"] for r in got.collect()] == [["X", "Y", "Z"]]
    return got


def test_edges_by_calls_stay_off_the_driver(spark):
    sites = settle(spark.createDataFrame([("", 1, 1, 9, 2)], "component string, call long, m long, line long, callee long"))
    have = settle(spark.createDataFrame([(1, "A"), (1, "B")], "call long, held string"))
    may = settle(spark.createDataFrame([(2, "B"), (2, "C"), (2, "D")], "m long, lock string"))
    must = settle(spark.createDataFrame([(1, "D")], "m long, lock string"))
    got = ed.interprocedural(sites, have, may, must)
    assert sorted((r["src"], r["dst"]) for r in got.collect()) == [("A", "C"), ("B", "C")] and "Broadcast" not in _plan(got)


def test_deferring_calls(spark):
    below = spark.createDataFrame([("My", "Base"), ("Sub", "My"), ("Sub", "Base")], "sub string, sup string")
    sites = spark.createDataFrame([(1, "My", "post"), (2, "Sub", "post"), (3, "Base", "post"), (4, "Sub", "other"), (5, "Else", "post")], "site long, declared string, name string")
    bases, none = spark.createDataFrame([("Base", "post")], "base string, name string"), spark.createDataFrame([], "entry string")
    assert {r["site"] for r in calls.deferring(sites, below, bases, none).collect()} == {1, 2, 3}
    assert {r["site"] for r in calls.deferring(sites, below, bases, spark.createDataFrame([("Sub.post",)], "entry string")).collect()} == {1, 3}


def test_dispatch(spark):
    methods = spark.createDataFrame([(c, "f", f"{c}.f") for c in ("A", "B", "D", "E", "G", "H", "I")], "class string, namesig string, mkey string")
    below = spark.createDataFrame([(c, "A") for c in "BD"] + [(c, "Z") for c in "DEGHI"], "sub string, sup string")
    live = spark.createDataFrame([(c,) for c in "BEGHID"], "class string")
    sites = spark.createDataFrame([(1, True, "A", None, "f"), (2, True, "A", "B", "f"), (3, False, "A", None, "f"), (4, True, "Z", None, "f"), (5, True, "A", "none", "f")], "site long, virtual boolean, declared string, receiver string, namesig string")
    got = {}
    for r in calls.dispatch(sites, methods, below, live).collect():
        got.setdefault(r["site"], set()).add(r["target"])
    assert got == {1: {"A.f", "B.f", "D.f"}, 2: {"B.f"}, 3: {"A.f"}, 5: {"A.f", "B.f", "D.f"}}


def test_candidates_are_counted_without_a_row_each(spark):
    """As counting ``candidates``; rows that share a site count their union. No join's rows grow as sites times bodies."""
    methods = spark.createDataFrame([(f"c{i:03}", "fg"[i % 7 == 0], f"c{i:03}") for i in range(200)], "class string, namesig string, mkey string")
    below = spark.createDataFrame([(f"c{i:03}", t) for i in range(200) for t in ("A", "B", "Z") if t != "B" or i < 90], "sub string, sup string")
    live = spark.createDataFrame([(f"c{i:03}",) for i in range(0, 200, 2)] * 2, "class string")
    sites = spark.createDataFrame([(i, "ABN"[i % 3], "fgh"[i % 4 % 3]) for i in range(400)] + [(7, "A", "f"), (7, "B", "f"), (8, None, "f"), (900, "A", None)], "site long, declared string, namesig string")
    got = calls.candidate_counts(sites, methods, below, live)
    want = calls.candidates(sites, methods, below, live).groupBy("site").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    ours, sums = [got._jdf.queryExecution().executedPlan()], []
    got.collect()
    while ours:
        node = ours.pop()
        kids = node.finalPhysicalPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        ours += [kids] if kids else [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            sums.append(node.metrics().apply("numOutputRows").value())
    assert sums and max(sums) < 1200


def test_alias_chains(spark):
    got = alias.follow(spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(9)] + [("x", "x")], "name string, target string")).collect()
    assert {(r["name"], r["target"]) for r in got} == {(f"a{i}", f"a{min(i + 6, 9)}") for i in range(9)}
    facts = spark.createDataFrame([("k", "v"), ("k", "v"), ("u", "v"), ("u", None), ("w", "v"), ("w", "z")], "name string, lock string")
    assert [(r["name"], r["lock"]) for r in alias.unique(facts, ["name"], "lock").collect()] == [("k", "v")]


def test_names(spark):
    df = spark.createDataFrame([("a.b.Cls$In.m:(I)V",), ("Cls.-$$Nest$mgo:()V",)], "k string")
    k = F.col("k")
    rows = df.select(names.class_of(k).alias("c"), names.namesig_of(k).alias("n"), names.short_method(k).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("a.b.Cls$In", "m:(I)V", "Cls$In.m"), ("Cls", "-$$Nest$mgo:()V", "Cls.go")]
    assert [r[0] for r in spark.createDataFrame([("x the y",), ("thex",), ("a.the$",), ("the",)], "t string").select(names.has_word(F.col("t"), "the")).collect()] == [True, False, False, True]


def test_race_ties(spark):
    rows = [("", i, i, "f", w, g) for i, (w, g) in enumerate([(True, ["A"]), (True, ["B"]), (False, ["B"]), (True, []), (False, ["C"])])]
    found = spark.createDataFrame(rows, "component string, m long, line long, field string, write boolean, guards array<string>")
    inferred = races.infer(found)
    assert [(r["accepted"], r["guarded_writes"], r["every"]) for r in inferred.collect()] == [(["B"], 1, False)]
    assert {r["m"] for r in races.violations(found, inferred).collect()} == {0, 3, 4}
    assert races.reported(inferred).collect() == [] and races.reported(inferred, 1, 0, "f", "B").count() == 1 and races.reported(inferred, 1, 0, "f", "A").count() == 0


def test_direction():
    assert [ipc.direction(x) for x in ("out", "incoming", "both")] == ["out", "in", "both"]
    with pytest.raises(ValueError):
        ipc.direction("up")


def test_strong_components_against_brute_force(spark):
    """Random graphs of several programs, and a long ring behind a long chain."""
    import random

    rng = random.Random(4)
    for n, m in ((12, 20), (30, 45), (0, 0)):
        edges = {(c, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for c in ("p", "q") for _ in range(m)}
        if n == 30:
            edges |= {("r", f"c{i:02}", f"c{i + 1:02}") for i in range(20)} | {("r", "c20", "c12")}
        reach = {}
        for c, a, b in edges:
            reach.setdefault((c, a), set()).add(b)
        grown = True
        while grown:
            grown = False
            for (c, _), to in reach.items():
                new = set().union(*[reach.get((c, b), set()) for b in to]) - to
                to |= new
                grown = grown or bool(new)
        want = set()
        for (c, a), to in reach.items():
            own = {b for b in to if a in reach.get((c, b), set())} | {a}
            if len(own) > 1:
                want.add((c, a, min(own), len(own)))
        df = spark.createDataFrame(list(edges), "component string, src string, dst string")
        got = {(r["component"], r["lock"], r["rep"], r["size"]) for r in graph.strong_components(df).collect()}
        assert got == want


def test_small_components_take_no_rounds(spark, monkeypatch):
    """Many programs of few locks are settled at once; larger ones in rounds, with the same result as packed."""
    rng = random.Random(8)
    pairs = {(f"p{c}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for c in range(30) for _ in range(11)}
    pairs |= {("wide", f"w{i:02}", f"w{(i + 1) % 63:02}") for i in range(63)} | {("full", f"f{i}", f"f{j}") for i in range(8) for j in range(8)}
    small = spark.createDataFrame(list(pairs), "component string, src string, dst string")
    names, keep = [], graph.settle

    def noted(df, name="round"):
        names.append(name)
        return keep(df, name)

    monkeypatch.setattr(graph, "settle", noted)
    got = {tuple(r) for r in graph.strong_components(small).collect()}
    assert len(names) <= 5 and {("wide", f"w{i:02}", "w00", 63) for i in range(63)} | {("full", f"f{i}", "f0", 8) for i in range(8)} <= got
    monkeypatch.setattr(graph, "PACKED", 7)
    some = ["full", *[f"p{i}" for i in range(20)]]
    assert {tuple(r) for r in graph.strong_components(small.where(F.col("component").isin(some))).collect()} == {r for r in got if r[0] in some}
    assert "labels" in names
