"""Lock-order graphs: evidence, components, shortest cycles, common guards.

Every table has a ``component`` column first: graphs of different programs never mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lockweave.plans.loop import apart, grow, settle

#: Locks of a component that are packed into one row: the bits of a long. Order edges between so many.
PACKED = 63
DENSE = PACKED * (PACKED - 1)


def nodes(edges: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """component, lock, idx: edge ends and all other locks, numbered by name."""
    ends = edges.select("component", F.explode(F.array("src", "dst")).alias("lock"))
    every = (ends.union(locks.select("component", "lock")) if locks is not None else ends).distinct()
    return every.withColumn("idx", (F.row_number().over(Window.partitionBy("component").orderBy("lock")) - 1).cast("long"))


def evidence(edges: DataFrame) -> DataFrame:
    """component, src, dst, n, and the first place (method, line) that shows the order."""
    first = F.min(F.struct("m", "line"))
    return edges.groupBy("component", "src", "dst").agg(F.count("*").alias("n"), first.alias("f")).select("component", "src", "dst", "n", F.col("f.m").alias("m"), F.col("f.line").alias("line"))


def closure(edges: DataFrame) -> DataFrame:
    """component, src, dst of all non-empty paths, by doubling: rounds grow with the logarithm of the longest."""
    paths = settle(edges.select("component", "src", "dst").distinct(), "closure")
    n = paths.count()
    while True:
        right = paths.select("component", F.col("src").alias("dst"), F.col("dst").alias("to"))
        paths = settle(paths.union(paths.join(right, ["component", "dst"]).select("component", "src", "to")).distinct(), "closure")
        after = paths.count()
        if after == n:
            return paths
        n = after


def _settled(rows: DataFrame, step, name: str) -> DataFrame:
    """``step`` over and over, until none of the rows that it gives has ``moved``."""
    rows = settle(rows, name)
    while True:
        rows = settle(step(rows), name)
        if rows.where("moved").isEmpty():
            return rows.drop("moved")


def _packed(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strong components of the programs of at most ``PACKED`` nodes, each in one row, and the edges of all others.

    A node's successors are the bits of a long; for each node in turn, all that lead to
    it take over what it leads to (Warshall), so a component needs no rounds.
    """
    sizes = left.groupBy("component").agg(F.count("*").alias("n"))
    few = apart(left).join(sizes.where(F.col("n") <= DENSE), "component")
    ends = F.array_sort(F.array_distinct(F.flatten(F.array(F.collect_set("src"), F.collect_set("dst")))))
    rows = few.groupBy("component").agg(ends.alias("nodes"), F.collect_list(F.struct("src", "dst")).alias("edges"))
    small = settle(rows.where(F.size("nodes") <= PACKED), "packed")
    rest = apart(left).join(small.select("component"), "component", "left_anti")
    at = "cast(array_position(nodes, {}) - 1 AS int)"
    bits = f"transform(nodes, x -> aggregate(filter(edges, e -> e.src = x), 0L, (b, e) -> b | shiftleft(1L, {at.format('e.dst')})))"
    reach = "aggregate(sequence(0, size(nodes) - 1), bits, (w, k) -> transform(w, r -> IF(shiftright(r, k) & 1 = 1, r | w[k], r)))"
    own = "filter(nodes, (x, j) -> shiftright(reach[i], j) & 1 = 1 AND shiftright(reach[j], i) & 1 = 1)"
    each = small.select("component", "nodes", F.expr(bits).alias("bits")).select("component", "nodes", F.expr(reach).alias("reach"))
    each = each.select("component", "nodes", "reach", F.posexplode("nodes").alias("i", "lock")).select("component", "lock", F.expr(own).alias("own")).where("size(own) > 1")
    return each.select("component", "lock", F.col("own")[0].alias("rep"), F.size("own").cast("long").alias("size")), rest


def strong_components(edges: DataFrame) -> DataFrame:
    """component, lock, rep, size: nodes on a cycle through another node, with the least name of theirs.

    Programs of few nodes are a row each (``_packed``).  For all others, in each pass nodes without a way in or out are trimmed, the least name flows along
    the edges, and every node whose own name came back to it gathers those of its label
    that lead to it: a component.  What is left of each label goes into the next pass.
    A round holds at most a row a node and a row an edge, however large a component is.
    """
    one, rest = _packed(settle(edges.where("src <> dst").select("component", "src", "dst").distinct(), "left"))
    found = settle(one, "strong")
    left = settle(rest, "left")
    while True:
        while True:  # trim
            n = left.count()
            out = left.select("component", F.col("src").alias("dst")).distinct()
            into = left.select("component", F.col("dst").alias("src")).distinct()
            kept = settle(left.join(out, ["component", "dst"], "left_semi").join(into, ["component", "src"], "left_semi").select("component", "src", "dst"), "left")
            after, left = kept.count(), kept
            if after in (0, n):
                break
        if not after:
            break
        ahead = left.select("component", F.col("src").alias("lock"), "dst")

        def flow(rows: DataFrame) -> DataFrame:
            came = rows.select("component", "lock", "label").join(ahead, ["component", "lock"]).groupBy("component", F.col("dst").alias("lock")).agg(F.min("label").alias("came"))
            both = rows.select("component", "lock", "label").join(came, ["component", "lock"])  # each node left has a way in
            return both.select("component", "lock", F.least("label", "came").alias("label"), (F.col("came") < F.col("label")).alias("moved"))

        start = left.select("component", F.col("src").alias("lock")).distinct()
        label = _settled(start.withColumn("label", F.col("lock")), flow, "labels")
        a, b = label.select("component", F.col("lock").alias("src"), "label"), label.select("component", F.col("lock").alias("dst"), "label")
        same = settle(left.join(a, ["component", "src"]).join(b, ["component", "dst", "label"]), "same")
        roots = label.where("lock = label").select("component", "label", "lock")
        back = same.select("component", "label", F.col("dst").alias("lock"), "src")
        own = settle(grow(roots, lambda d: d.join(back, ["component", "label", "lock"]).select("component", "label", F.col("src").alias("lock")), name="own"), "own")
        many = own.groupBy("component", "label").agg(F.count("*").alias("size")).where("size > 1")
        news = settle(own.join(many, ["component", "label"]).select("component", "lock", F.col("label").alias("rep"), "size"), "strong")
        found = found.union(news)
        done = own.select("component", "label", F.col("lock").alias("src"))
        rest = same.join(done, ["component", "label", "src"], "left_anti").join(done.withColumnRenamed("src", "dst"), ["component", "label", "dst"], "left_anti")
        left = settle(rest.select("component", "src", "dst"), "left")
    return found


def inside(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """The edges between two nodes of one strong component, with its rep."""
    a = scc.select("component", F.col("lock").alias("src"), "rep")
    b = scc.select("component", F.col("lock").alias("dst"), "rep")
    return edges.join(apart(a), ["component", "src"]).join(apart(b), ["component", "dst", "rep"])


def shortest_paths(edges: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """component, start, node, path: the lexicographically least of the shortest paths from each start to each node.

    A breadth-first search of all starts at once; a node is reached once a start, by
    the least path, which extends the least path to the node before.
    """
    step = edges.select("component", F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = settle(starts.select("component", F.col("start"), F.col("start").alias("node"), F.array("start").alias("path")).distinct(), "paths")
    edge = seen
    for _ in range(most):
        news = edge.join(step, ["component", "node"]).groupBy("component", "start", F.col("next").alias("node")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        edge = settle(news.join(seen, ["component", "start", "node"], "left_anti"), "paths")
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen


def _rotated(path: Column) -> Column:
    at = F.array_position(path, F.array_min(path))
    return F.concat(F.slice(path, at.cast("int"), F.size(path)), F.slice(path, 1, (at - 1).cast("int")))


def minimal_cycles(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """component, rep, cycle: for each edge in a strong component the shortest way back, least node first, once each."""
    own = settle(inside(edges.select("component", "src", "dst").distinct(), scc), "inside")
    ways = shortest_paths(own, own.select("component", F.col("dst").alias("start")))
    closed = own.where("src <> dst").join(ways, (own["component"] == ways["component"]) & (own["dst"] == ways["start"]) & (own["src"] == ways["node"]))
    cycle = F.concat(F.array(own["src"]), F.slice("path", 1, F.size("path") - 1))
    return closed.select(own["component"], "rep", _rotated(cycle).alias("cycle")).distinct()


def common_guard(evidence_rows: DataFrame, key: list[str], members: DataFrame) -> DataFrame:
    """key, guard: locks that every evidence row of a key holds (relational division), without the key's members.

    ``evidence_rows``: key, guard; ``members``: key, lock.
    """
    total = evidence_rows.groupBy(*key).agg(F.count("*").alias("total"))
    held = evidence_rows.select(*key, F.explode(F.array_distinct("guard")).alias("lock")).groupBy(*key, "lock").agg(F.count("*").alias("n"))
    every = held.join(total, key).where("n = total").join(apart(members), [*key, "lock"], "left_anti")
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("lock")).alias("guard"))


def scc_guard(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """component, rep, guard of strong components all of whose inner edges share a lock outside of them."""
    return common_guard(inside(edges, scc).select("component", "rep", "guard"), ["component", "rep"], scc.select("component", "rep", "lock"))


def cycle_guard(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """component, cycle, guard of cycles all of whose edges' evidence shares a lock outside of them."""
    steps = cycles.select("component", "cycle", F.posexplode("cycle").alias("i", "src"))
    steps = steps.withColumn("dst", F.element_at("cycle", (F.col("i") + 1) % F.size("cycle") + 1)).drop("i")
    rows = steps.join(edges.select("component", "src", "dst", "guard"), ["component", "src", "dst"]).select("component", "cycle", "guard")
    return common_guard(rows, ["component", "cycle"], cycles.select("component", "cycle", F.explode("cycle").alias("lock")))
