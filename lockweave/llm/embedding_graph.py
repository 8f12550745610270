"""Near-duplicate vectors by a robust-pruned neighbourhood graph over overlapping shards.

1. Equal vectors of one label are one class, with a count.
2. A bounded sample gives medoids, in proportion to the vectors up to ``MEDOIDS``
   (spherical k-means, in two levels when there are many, then the nearest sample vector).
   Every class goes to its nearest medoid's shard (its home) and, as a guest, to each
   other shard that lies within half a link's chord of it, behind the plane that parts
   the two medoids; labels never share a shard.  A link that crosses the plane has an
   end within that half, so each link lies whole in the home of one of its ends; if the
   other end's home lacks it, both are counted here.
3. Each shard builds its part of the graph: every vector's nearest in the shard, robustly
   pruned, so that long edges survive.  The shards' adjacency lists are united.
4. Each shard searches the united graph for every vector at home there, from the vector's
   own node on through all that is within the range widened by ``SLACK``.  What is found
   is verified in double precision and counted; a vector for which the shard holds more,
   by the count taken while pruning, is compared with the whole shard instead.
5. Recall is audited by brute force for the ids divisible by ``AUDIT``, against all
   vectors of their label.

A shard of more than ``SHARD`` vectors -- a dense group that no medoid can part -- is
dealt into blocks, and each pair of blocks is compared exactly, so none is capped.
Links are never rows: a task returns a vector's number of links and, of a shard's
connected vectors, a star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import need, table
from lockweave.llm.components import components

#: Vectors that a medoid should stand for; most medoids; most that are fitted at once, beyond which cells are parted again.
PER_MEDOID, MEDOIDS, FLAT = 1500, 8192, 128
#: Vectors of the sample that medoids are fitted on: so many for each medoid and at least, in expectation; bytes that it has at most.
PER_FIT, SAMPLE, SAMPLE_BYTES = 32, 16_384, 128 << 20
#: Vectors of one shard at most; more are compared in blocks.
SHARD = 4096
#: Medoids keep so many links' chords apart, or a dense group would be a guest in each of its own medoids' shards.
APART = 2
#: Edges of a vector in one shard; the pruning's alpha; candidates that it sees.
DEGREE, ALPHA, NEAR = 24, 1.2, 64
#: How far below the least cosine the search goes on.
SLACK = 0.03
AUDIT = 20


def units(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label and v (doubles) of the vectors that can link, as they are; others aren't among them."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    some = need(df, id_col, vec_col, label_col).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return some.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _matrix(column):
    """The rows of a list column as unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    import numpy as np

    x = np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(x, k: int, rng):
    """The number of each row's cell, of k at most: spherical k-means, beyond ``FLAT`` cells in two levels."""
    import numpy as np

    now = min(k, FLAT, len(x))
    c = x[rng.choice(len(x), now, replace=False)]
    for _ in range(8):
        near = _nearest(x, c)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        norm = np.sqrt((new * new).sum(1, keepdims=True))
        c = np.where(norm > 0, new / np.maximum(norm, 1e-12), c)
    near = _nearest(x, c)
    if k <= FLAT:
        return near
    out, first = np.zeros(len(x), np.int64), 0
    for i in np.unique(near):
        rows = np.flatnonzero(near == i)
        own = _cells(x[rows], max(1, min(FLAT, len(rows), round(k * len(rows) / len(x)))), rng)
        out[rows] = first + own
        first += int(own.max()) + 1
    return out


def _nearest(x, c):
    """The row of c that is nearest to each row of x."""
    import numpy as np

    step = max(1, (1 << 21) // len(c))
    return np.concatenate([(x[at : at + step] @ c.T).argmax(1) for at in range(0, len(x), step)])


def medoids(classes: DataFrame, least: float, seed: int = 5):
    """Of each dimension, the medoids of a bounded sample of the classes (by a hash of the id)."""
    import numpy as np

    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    out = {}
    for dim, n in sizes.items():  # a row for each length of vectors
        k = max(1, min(MEDOIDS, round(n / PER_MEDOID)))
        want = min(max(SAMPLE, PER_FIT * k), max(1, SAMPLE_BYTES // (8 * dim)))
        part = classes.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < math.ceil(1_000_000_000 * min(1.0, want / n))))
        x = np.array([r["v"] for r in part.select("id", "v").orderBy("id").toLocalIterator()])
        if not len(x):
            continue
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        cell = _cells(x, min(k, len(x)), np.random.default_rng(seed))
        kept, m = np.zeros((cell.max() + 1, dim)), 0
        for i in np.unique(cell):
            rows = x[cell == i]
            best = rows[int((rows @ rows.sum(0)).argmax())]
            if not m or (kept[:m] @ best).max() < 1 - APART**2 * (1 - least):
                kept[m] = best
                m += 1
        out[dim] = kept[:m]
    return out


def shards(classes: DataFrame, centres: dict, least: float) -> DataFrame:
    """id, label, n, v, shard, home, places: a row for each shard that a class belongs to; places: the numbers of all of them, its home first."""
    import pyarrow as pa

    half = math.sqrt(max(0.0, 2 - 2 * least)) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for whole in batches:
            sizes = np.array([len(v) for v in whole.column(3)])
            for dim in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == dim))
                x = _matrix(batch.column(3))
                c = centres.get(int(dim), np.zeros((1, dim)))
                # how far a vector is from the plane between its medoid and another, times how far these are apart
                places: list[list[int]] = []
                for at in range(0, len(x), step := max(1, (1 << 21) // len(c))):
                    sim = x[at : at + step] @ c.T
                    first = sim.argmax(1)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * (c[first] @ c.T)))
                    take = sim.max(1)[:, None] - sim <= half * apart + 1e-9
                    places += [[int(h), *(p for p in np.flatnonzero(t).tolist() if p != h)] for h, t in zip(first, take, strict=True)]
                row = np.repeat(np.arange(len(x)), [len(p) for p in places])
                part = batch.take(pa.array(row))
                names = [f"{dim}:{s}" for p in places for s in p]
                home = [i == 0 for p in places for i in range(len(p))]
                every = pa.array(places, pa.list_(pa.int32())).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(home), every], ["id", "label", "n", "v", "shard", "home", "places"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "label", "n", "v").mapInArrow(run, f"id {kind}, label string, n bigint, v array<double>, shard string, home boolean, places array<int>")


def _places(column):
    """Of each row, its home's number; and as a matrix, whether it belongs to the shard of a number."""
    import numpy as np

    rows = column.to_pylist()
    member = np.zeros((len(rows), 1 + max(max(p) for p in rows)), bool)
    for i, p in enumerate(rows):
        member[i, p] = True
    return np.array([p[0] for p in rows]), member


def pruned(x, least: float, degree: int = DEGREE, alpha: float = ALPHA, near: int = NEAR) -> tuple[list, list]:
    """Robust-pruned neighbours of each row of x (unit vectors), as row numbers, and how many rows it links with.

    Of a row's nearest, in order, one is kept unless a kept one is alpha times nearer
    to it than the row is.
    """
    import numpy as np

    out, within = [], []
    n = len(x)
    for at in range(0, n, 512):
        sim = x[at : at + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(at, at + len(sim))] = -2
        within += (sim >= least).sum(1).tolist()
        k = min(near, n - 1)
        best = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(sim), 0), int)
        for i in range(len(sim)):
            cand = best[i][np.argsort(-sim[i, best[i]], kind="stable")]
            d = np.sqrt(np.maximum(0, 2 - 2 * sim[i, cand]))
            y = x[cand]
            between = np.sqrt(np.maximum(0, 2 - 2 * (y @ y.T)))
            alive, kept = np.ones(len(cand), bool), []
            for j in range(len(cand)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > d
            out.append(cand[kept])
    return out, within


def search(x, edges: list, query: int, least: float, slack: float = SLACK):
    """Rows whose cosine with row ``query`` is ``least`` or more, found along the edges from that row."""
    import numpy as np

    q, edge = x[query], np.array([query])
    seen = np.zeros(len(x), bool)
    seen[edge] = True
    while len(edge):  # on through all that is in the wider range
        new = np.unique(np.concatenate([edges[e] for e in edge]))
        new = new[~seen[new]]
        new = new[x[new] @ q >= least - slack] if len(new) else new
        seen[new] = True
        edge = new
    found = np.flatnonzero(seen)
    return found[x[found] @ q >= least]


def _star(x, ids, links):
    """Edges (a, b) of ids that join the linked rows; links: for each row the rows linked."""
    import numpy as np

    root = np.arange(len(ids))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, others in links:
        for j in others:
            a, b = top(i), top(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(ids[top(i)], ids[i]) for i in range(len(ids)) if top(i) != i]


def actual(classes: DataFrame, least: float) -> DataFrame:
    """id, actual: the links of the ids divisible by ``AUDIT``, by brute force over all of their label, a block at a time."""
    import pyarrow as pa

    sizes = table(classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")), "sizes")
    every = classes.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"])
    some = F.ceil(F.col("parts") / AUDIT).cast("bigint")
    asked = every.where(F.col("id") % AUDIT == 0).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.pmod(F.xxhash64("id"), some).alias("j"), F.lit(True).alias("asked"))
    held = every.select("*", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), some - 1)).alias("j"), F.lit(False).alias("asked"))

    def count(t: pa.Table) -> pa.Table:
        import numpy as np

        x, ids, weight, q = _matrix(t.column("v").combine_chunks()), np.array(t.column("id").to_pylist()), np.array(t.column("n").to_pylist()), np.array(t.column("asked").to_pylist())
        b = np.flatnonzero(~q)
        n = [int(weight[b[(x[b] @ x[i] >= least) & (ids[b] != ids[i])]].sum()) for i in np.flatnonzero(q)]
        return pa.table({"id": pa.array(ids[q], pa.int64()), "n": pa.array(n, pa.int64())})

    return asked.union(held).groupBy("label", "dim", "i", "j").applyInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("actual"))


def near_duplicates(df: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", audit: bool = False) -> DataFrame:
    """Per vector: n_links, component_id (smallest id reachable), kept (it is that one).

    Defined cases: a null label or vector, a zero vector, one with a null or
    non-finite component, and vectors of other lengths link with nothing; a null id
    neither links nor is kept; rows that repeat an id and its vector count as one
    vector, and vectors of different rows with one id as that id's; an empty table gives
    no row; further columns are not read.  With ``audit`` the result is the recall
    table instead: per audited id, links by brute force and links found.
    """
    import pyarrow as pa

    whole = table(units(df, id_col, vec_col, label_col).distinct(), "units")
    classes = table(whole.groupBy("label", "v").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n")), "classes")
    centres = medoids(classes, least)
    dealt = table(shards(classes, centres, least), "shards")
    sizes = dealt.groupBy("label", "shard").agg(F.count("*").alias("size"))
    large = table(sizes.where(F.col("size") > SHARD), "large")
    fit = dealt.join(large, ["label", "shard"], "left_anti")

    def build(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v").combine_chunks())
        ids = t.column("id").to_pylist()
        near, within = pruned(x, least)
        within = [w if h else None for w, h in zip(within, t.column("home").to_pylist(), strict=True)]
        return pa.table({"label": [t.column("label")[0].as_py()] * len(ids), "id": ids, "near": [[ids[j] for j in e] for e in near], "within": within}, schema=pa.schema([("label", pa.string()), ("id", pa.int64()), ("near", pa.list_(pa.int64())), ("within", pa.int64())]))

    lists = fit.groupBy("label", "shard").applyInArrow(build, "label string, id bigint, near array<bigint>, within bigint")
    union = table(lists.groupBy("label", "id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("within").alias("within")), "graph")
    held = fit.join(union, ["label", "id"])

    def look(t: pa.Table) -> pa.Table:
        import numpy as np

        x, ids, weight, home = _matrix(t.column("v").combine_chunks()), np.array(t.column("id").to_pylist()), np.array(t.column("n").to_pylist()), np.array(t.column("home").to_pylist())
        order = np.argsort(ids)
        first, member = _places(t.column("places").take(pa.array(order)))
        x, ids, weight, home = x[order], ids[order], weight[order], home[order]
        near, within = t.column("near").to_pylist(), np.array(t.column("within").to_pylist(), object)[order]
        edges: list = [[] for _ in ids]
        for i, o in enumerate(order):
            e = np.array(near[o] or [], np.int64)
            p = np.searchsorted(ids, e)
            p = np.minimum(p, len(ids) - 1)
            edges[i] = p[ids[p] == e]
        back: list = [[] for _ in ids]  # edges are used both ways
        for i, e in enumerate(edges):
            for j in e:
                back[j].append(i)
        edges = [np.unique(np.concatenate((e, np.array(b, np.int64)))) for e, b in zip(edges, back, strict=True)]
        n_links, links = np.zeros(len(ids), np.int64), []
        for i in np.flatnonzero(home):
            found = search(x, edges, int(i), least)
            found = found[found != i]
            if len(found) < within[i]:  # an island among the links: the graph doesn't hold together there
                found = np.flatnonzero(x @ x[i] >= least)
                found = found[found != i]
            n_links[i] += weight[found].sum()
            n_links[found[~home[found] & ~member[i, first[found]]]] += weight[i]
            links.append((int(i), found))
        rows = [(int(ids[i]), None, int(n_links[i])) for i in np.flatnonzero(home | (n_links > 0))] + [(int(a), int(b), 0) for a, b in _star(x, ids, links)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["a", "b", "n_links"])

    shape = "a bigint, b bigint, n_links bigint"
    found = held.groupBy("label", "shard").applyInArrow(look, shape)

    # large shards: each pair of blocks in a task of its own
    blocks = large.withColumn("parts", F.ceil(F.col("size") / (SHARD // 2)).cast("int"))
    placed = dealt.join(blocks, ["label", "shard"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))

    def compare(t: pa.Table) -> pa.Table:
        import numpy as np

        x, ids, weight, home = _matrix(t.column("v").combine_chunks()), np.array(t.column("id").to_pylist()), np.array(t.column("n").to_pylist()), np.array(t.column("home").to_pylist())
        block, lo, hi = np.array(t.column("i").to_pylist()), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        first, member = _places(t.column("places"))
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        n_links, links = np.zeros(len(ids), np.int64), []
        for some in np.array_split(a, max(1, len(a) // 512)):
            near = x[some] @ x[b].T >= least
            for r, i in enumerate(some):
                other = b[near[r]]
                other = other[other != i]
                # a vector counts at home, and as a guest what its home lacks of the other's home
                n_links[i] += weight[other if home[i] else other[home[other] & ~member[other, first[i]]]].sum()
                if lo != hi:
                    n_links[other[home[other] | (home[i] & ~member[i, first[other]])]] += weight[i]
                links.append((int(i), other))
        rows = [(int(ids[i]), None, int(n_links[i])) for i in np.flatnonzero(home | (n_links > 0))] + [(int(p), int(q), 0) for p, q in _star(x, ids, links)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, names=["a", "b", "n_links"])

    found = table(found.union(pairs.groupBy("label", "shard", "lo", "hi").applyInArrow(compare, shape)), "found")
    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n_links").alias("others"))
    if audit:
        return actual(classes, least).join(linked, "id").select(F.col("id").alias(id_col), "actual", F.col("others").alias("found"))
    # the class's own copies link with each other; back to every vector
    met = components(found.where("b is not null").select("a", "b"))
    known = classes.join(linked, "id").join(met.withColumnRenamed("node", "id"), "id", "left").select("label", "v", (F.col("others") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    each = table(whole.join(table(known, "known"), ["label", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    ids = need(df, id_col).select(F.col(id_col).alias("_id"))
    out = ids.join(each, ids["_id"] == each["id"], "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
