"""DuckDB SQL for the queries of ``event_queries``."""

from __future__ import annotations

from lockweave.operators.calls import POLYMORPHIC
from lockweave.operators.ipc import SAMPLE
from lockweave.operators.races import LISTED, MIN_COVERAGE, MIN_WRITES
from lockweave.plans.event_queries import MAX_LOCKS, SUPPORT, TANGLE

#: Named parts; a query names those it needs, each after what it needs itself.
PARTS: dict[str, tuple[str, str]] = {
    "ev": (
        "",
        """SELECT user_id % 10 AS component, user_id AS m, event_id AS off, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line,
  CASE event_type WHEN 'signup' THEN 'enter' WHEN 'purchase' THEN 'exit' WHEN 'view' THEN 'iget' WHEN 'click' THEN 'iput' ELSE 'invoke' END AS op, k,
  'L' || lpad((k % 12)::VARCHAR, 2, '0') AS lock, 'F' || lpad((k % 20)::VARCHAR, 2, '0') AS field
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    ),
    "run": ("ev", "SELECT m, off, lock, sum(CASE WHEN op = 'enter' THEN 1 ELSE -1 END) OVER (PARTITION BY m, lock ORDER BY off) AS s FROM ev WHERE op IN ('enter', 'exit')"),
    "span": ("run", "SELECT * FROM (SELECT m, off, lock, s - least(0, min(s) OVER (PARTITION BY m, lock ORDER BY off)) AS n, lead(off) OVER (PARTITION BY m, lock ORDER BY off) AS upto FROM run) WHERE n > 0"),
    "held": ("span", "SELECT e.component, e.m, e.off, s.lock FROM ev e JOIN span s ON e.m = s.m AND e.off > s.off AND (s.upto IS NULL OR e.off <= s.upto)"),
    "acq": ("held", "SELECT * FROM ev WHERE op = 'enter' AND (m, off, lock) NOT IN (SELECT m, off, lock FROM held)"),
    "ord": ("acq", "SELECT a.component, a.m, a.off, a.line, h.lock AS src, a.lock AS dst, list_sort(list_append(list(h.lock) OVER (PARTITION BY a.m, a.off), a.lock)) AS guard FROM acq a JOIN held h USING (m, off)"),
    "strong": ("ord", f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY component, src, dst) AS n FROM ord) WHERE n >= {SUPPORT}"),
    "closure": ("strong", "SELECT DISTINCT component, src, dst FROM strong UNION SELECT c.component, c.src, s.dst FROM closure c JOIN (SELECT DISTINCT component, src, dst FROM strong) s ON s.component = c.component AND s.src = c.dst"),
    "scc": ("closure", "SELECT component, lock, rep, count(*) OVER (PARTITION BY component, rep) AS size FROM (SELECT a.component, a.src AS lock, least(a.src, min(a.dst)) AS rep FROM closure a JOIN closure b ON a.component = b.component AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.component, a.src)"),
    "within": ("scc", "SELECT s.*, x.rep FROM strong s JOIN scc x ON x.component = s.component AND x.lock = s.src JOIN scc y ON y.component = s.component AND y.lock = s.dst AND y.rep = x.rep"),
    "guards": (
        "within",
        """SELECT component, rep, string_agg(lock, ',' ORDER BY lock) AS guard FROM (
  SELECT component, rep, unnest(guard) AS lock, total FROM (SELECT component, rep, list_distinct(guard) AS guard, count(*) OVER (PARTITION BY component, rep) AS total FROM within))
  t WHERE NOT EXISTS (SELECT 1 FROM scc s WHERE s.component = t.component AND s.rep = t.rep AND s.lock = t.lock)
  GROUP BY component, rep, lock, total HAVING count(*) = total""",
    ),
    "whole": ("scc", "SELECT component, rep, string_agg(lock, ',' ORDER BY lock) AS locks, count(*) AS size FROM scc GROUP BY ALL"),
    "one": ("within", "SELECT DISTINCT component, rep, src, dst FROM within"),
    "dist": ("one", "SELECT component, src, dst, 1 AS d FROM one UNION SELECT a.component, a.src, o.dst, a.d + 1 FROM dist a JOIN one o ON o.component = a.component AND o.src = a.dst WHERE a.d < 12"),
    "short": ("dist", "SELECT component, src, dst, min(d) AS d FROM dist GROUP BY ALL"),
    # from each edge's end, always on to the least neighbour that is one step nearer to its start
    "walk": (
        "short",
        """SELECT component, rep, src AS goal, dst AS node, [src, dst] AS path FROM one WHERE src <> dst
  UNION ALL SELECT w.component, w.rep, w.goal, (SELECT min(o.dst) FROM one o JOIN short n ON n.component = o.component AND n.src = o.dst AND n.dst = w.goal
      WHERE o.component = w.component AND o.src = w.node AND n.d = s.d - 1) AS node,
    list_append(w.path, (SELECT min(o.dst) FROM one o JOIN short n ON n.component = o.component AND n.src = o.dst AND n.dst = w.goal WHERE o.component = w.component AND o.src = w.node AND n.d = s.d - 1))
  FROM walk w JOIN short s ON s.component = w.component AND s.src = w.node AND s.dst = w.goal WHERE s.d > 1""",
    ),
    "cycles": (
        "walk",
        """SELECT DISTINCT w.component, w.rep, list_concat(list_slice(w.path, list_position(w.path, list_min(w.path)), len(w.path)), list_slice(w.path, 1, list_position(w.path, list_min(w.path)) - 1)) AS cycle
  FROM walk w JOIN short s ON s.component = w.component AND s.src = w.node AND s.dst = w.goal WHERE s.d = 1""",
    ),
    "steps": ("cycles", "SELECT component, cycle, src, dst FROM (SELECT component, cycle, unnest(cycle) AS src, unnest(list_append(list_slice(cycle, 2, len(cycle)), cycle[1])) AS dst FROM cycles)"),
    "cycle_guards": (
        "steps",
        """SELECT component, cycle, string_agg(lock, ',' ORDER BY lock) AS guard FROM (
  SELECT component, cycle, unnest(guard) AS lock, total FROM (SELECT t.component, t.cycle, list_distinct(s.guard) AS guard, count(*) OVER (PARTITION BY t.component, t.cycle) AS total
    FROM steps t JOIN strong s ON s.component = t.component AND s.src = t.src AND s.dst = t.dst))
  WHERE NOT list_contains(cycle, lock) GROUP BY component, cycle, lock, total HAVING count(*) = total""",
    ),
    "raw": ("ev", "SELECT component, m, off, line, k, (m + 10 * (1 + k)) % (SELECT (max(m) // 10 + 1) * 10 FROM ev) AS callee FROM ev WHERE op = 'invoke'"),
    "call": (
        "raw",
        """SELECT component, m, off, line, ['direct', 'static', 'virtual', 'interface', 'super'][k % 5 + 1] AS kind, callee, k % 7 = 3 AS is_async, k = 0 AS transact,
  CASE WHEN k % 7 <> 3 THEN row_number() OVER (PARTITION BY m, k % 7 = 3 ORDER BY off) END AS rn FROM raw WHERE callee <> m AND callee IN (SELECT m FROM ev)""",
    ),
    "dag": ("call", "SELECT * FROM call WHERE rn <= 2 AND callee > m"),
    "cyc": ("call", "SELECT * FROM call WHERE rn <= 3"),
    "taken": ("acq", "SELECT DISTINCT m, lock FROM acq WHERE lock < 'L04'"),
    "may": ("taken dag", "SELECT m, lock FROM taken UNION SELECT d.m, a.lock FROM may a JOIN dag d ON d.callee = a.m"),
    "cl": ("held cyc", "SELECT h.off, h.lock FROM held h WHERE off IN (SELECT off FROM cyc)"),
    "strict_root": ("ev", "SELECT DISTINCT m FROM ev WHERE m % 3 = 0"),
    "race_root": ("cyc", "SELECT DISTINCT m FROM ev WHERE m NOT IN (SELECT callee FROM cyc)"),
    "calls_of_ipc": ("call", "SELECT * FROM call WHERE (rn <= 2 AND callee > m) OR transact"),
    "reach": ("calls_of_ipc", "SELECT DISTINCT m FROM calls_of_ipc WHERE transact UNION SELECT c.m FROM reach r JOIN calls_of_ipc c ON c.callee = r.m WHERE NOT c.is_async"),
    "sites": (
        "reach held",
        """SELECT * FROM (SELECT c.component, c.m, c.line, c.callee, c.transact AS direct, h.held, row_number() OVER (PARTITION BY c.component, c.m, c.line, h.held ORDER BY c.transact DESC, c.callee) AS r
  FROM calls_of_ipc c JOIN (SELECT m, off, list_sort(list(lock)) AS held FROM held GROUP BY ALL) h ON h.m = c.m AND h.off = c.off
  WHERE NOT c.is_async AND (c.transact OR c.callee IN (SELECT m FROM reach))) WHERE r = 1""",
    ),
    "steps_to": (
        "reach",
        "SELECT DISTINCT m, 0 AS d FROM calls_of_ipc WHERE transact UNION SELECT c.m, s.d + 1 FROM steps_to s JOIN calls_of_ipc c ON c.callee = s.m AND NOT c.is_async WHERE s.d < 24",
    ),
    "near": (
        "steps_to",
        """SELECT m, min(d) AS d FROM steps_to GROUP BY m""",
    ),
    "trail": (
        "near sites",
        """SELECT component, m, line, direct, callee AS node, CASE WHEN direct THEN [m] ELSE [m, callee] END AS path FROM sites
  UNION ALL SELECT t.component, t.m, t.line, t.direct, x.next, list_append(t.path, x.next) FROM trail t
    JOIN (SELECT a.m, min(c.callee) AS next FROM near a JOIN calls_of_ipc c ON c.m = a.m AND NOT c.is_async JOIN near b ON b.m = c.callee AND b.d = a.d - 1 GROUP BY a.m) x ON x.m = t.node WHERE NOT t.direct""",
    ),
    "mclose": ("ord", "SELECT DISTINCT m, src, dst FROM ord UNION SELECT c.m, c.src, o.dst FROM mclose c JOIN ord o ON o.m = c.m AND o.src = c.dst"),
    "per_method": ("mclose", "SELECT a.m, a.src AS lock, least(a.src, min(a.dst)) AS rep FROM mclose a JOIN mclose b ON a.m = b.m AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.m, a.src"),
    "acc": ("held", "SELECT e.component, e.m, e.off, e.line, e.field, e.op = 'iput' AS write, coalesce(list_sort(list(h.lock) FILTER (h.lock IS NOT NULL)), []) AS guards FROM ev e LEFT JOIN held h ON h.m = e.m AND h.off = e.off WHERE e.op IN ('iget', 'iput') GROUP BY ALL"),
    "tal": ("acc", "SELECT component, field, count(*) FILTER (write) AS writes, count(*) FILTER (NOT write) AS reads FROM acc GROUP BY ALL"),
    "ltal": ("tal", "SELECT component, field, lock, count(*) FILTER (write) AS w, count(*) FILTER (NOT write) AS r FROM (SELECT component, field, write, unnest(guards) AS lock FROM acc) GROUP BY ALL"),
    "every": ("ltal", "SELECT component, field, writes, reads, list_sort(list(lock)) AS accepted, max(w) AS guarded_writes FROM ltal JOIN tal USING (component, field) WHERE w = writes AND writes > 0 GROUP BY component, field, writes, reads"),
    "inferred": (
        "every",
        """SELECT *, true AS every FROM every UNION ALL
  SELECT component, field, writes, reads, [lock] AS accepted, w AS guarded_writes, false FROM (
    SELECT *, row_number() OVER (PARTITION BY component, field ORDER BY w DESC, r DESC, lock) AS rank FROM ltal JOIN tal USING (component, field) WHERE (component, field) NOT IN (SELECT component, field FROM every)) WHERE rank = 1""",
    ),
    "bad": ("inferred", "SELECT a.*, i.accepted FROM acc a JOIN inferred i USING (component, field) WHERE NOT list_has_any(a.guards, i.accepted)"),
    "sup": ("", "SELECT 'c' || c_custkey AS sub, 'n' || c_nationkey AS sup FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"),
    "supc": ("sup", "SELECT sub, sup FROM sup UNION SELECT a.sub, s.sup FROM supc a JOIN sup s ON s.sub = a.sup"),
    "body": ("", "SELECT class, 'f' || f || ':()V' AS namesig, class || '.f' || f || ':()V' AS mkey FROM (SELECT 'c' || c_custkey AS class, c_custkey % 50 AS f FROM customer UNION ALL SELECT 'n' || n_nationkey, n_nationkey % 50 FROM nation)"),
    "live": ("", "SELECT DISTINCT 'c' || o_custkey AS class FROM orders"),
    "vsite": (
        "",
        """SELECT o_orderkey AS site, o_orderkey % 5 <> 4 AS virtual, 'n' || c_nationkey AS declared, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS receiver,
  'f' || (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 50 ELSE o_orderkey % 50 END) || ':()V' AS namesig FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "known": ("vsite body", "SELECT site, mkey AS target FROM vsite JOIN body b ON b.class = receiver AND b.namesig = vsite.namesig WHERE virtual AND receiver IS NOT NULL"),
    "rest": ("known", "SELECT * FROM vsite WHERE site NOT IN (SELECT site FROM known)"),
    "cand": ("rest supc live", "SELECT DISTINCT r.site, b.mkey AS target, r.receiver FROM rest r JOIN supc s ON s.sup = r.declared JOIN body b ON b.class = s.sub AND b.namesig = r.namesig JOIN live l ON l.class = b.class WHERE r.virtual"),
    "few": ("cand", f"SELECT site, target FROM (SELECT *, count(*) OVER (PARTITION BY site) AS n FROM cand) WHERE n <= {POLYMORPHIC}"),
    "own": ("rest body", "SELECT site, mkey AS target FROM rest JOIN body b ON b.class = declared AND b.namesig = rest.namesig"),
    "ncall": ("ev", "SELECT off AS site, 'c' || (m + 1) AS declared, 'post' || (k % 5) AS name FROM ev WHERE op = 'invoke'"),
    "defer": ("ncall supc", "SELECT DISTINCT site, declared, name FROM ncall JOIN supc ON sub = declared JOIN (VALUES ('n3', 'post0'), ('n7', 'post1'), ('r2', 'post3'), ('r4', 'post4')) b(base, bname) ON base = sup AND bname = name"),
    "src": ("", "SELECT doc_id AS path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"),
}


def must(root: str, more: str = "") -> str:
    """The greatest fixpoint's dual, as in the operator, but over all names and methods."""
    return f"""WITH RECURSIVE {_with(f'cl {root} {more}')},
reached AS (SELECT m FROM {root} UNION SELECT c.callee FROM reached r JOIN cyc c ON c.m = r.m),
missing AS (SELECT m, lock FROM {root}, (SELECT DISTINCT lock FROM cl) UNION
  SELECT c.callee, x.lock FROM missing x JOIN cyc c ON c.m = x.m WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.off = c.off AND cl.lock = x.lock)),
must AS (SELECT m, lock FROM reached, (SELECT DISTINCT lock FROM cl) WHERE (m, lock) NOT IN (SELECT m, lock FROM missing))"""


def _with(needs: str) -> str:
    """The parts named, and those they need, in an order that defines each before its use."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in PARTS[name][0].split():
                add(x)
            order.append(name)

    for name in needs.split():
        add(name)
    return ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order)


def _sql(needs: str, select: str) -> str:
    return f"WITH RECURSIVE {_with(needs)}\n{select}"


_WORD = "(^|[^A-Za-z0-9_$]){}([^A-Za-z0-9_$]|$)"

ORACLES: dict[str, str] = {
    "held_set": _sql("held", "SELECT * FROM held"),
    "order_edges": _sql("ord", "SELECT component, m, off, line, src, dst, array_to_string(guard, ',') AS guard FROM ord"),
    "reentrant_skip": _sql("held", "SELECT e.component, e.m, e.off, e.lock FROM ev e JOIN held h ON h.m = e.m AND h.off = e.off AND h.lock = e.lock WHERE e.op = 'enter'"),
    "trylock_no_edge": _sql("acq", "SELECT a.component, h.lock AS src, a.lock AS dst, count(*) AS n FROM acq a JOIN held h USING (m, off) WHERE a.k % 5 <> 4 GROUP BY ALL"),
    "lock_nodes": _sql("ord", "SELECT component, lock, row_number() OVER (PARTITION BY component ORDER BY lock) - 1 AS idx FROM (SELECT component, src AS lock FROM ord UNION SELECT component, dst FROM ord UNION SELECT component, lock FROM ev WHERE op = 'enter')"),
    "edge_evidence": _sql("ord", "SELECT component, src, dst, count(*) AS n, min((m, line))[1] AS m, min((m, line))[2] AS line FROM ord GROUP BY ALL"),
    "blocking_edges": _sql("strong", "SELECT component, src, dst, count(*) AS n FROM strong GROUP BY component, src, dst"),
    "lock_closure": _sql("closure", "SELECT * FROM closure"),
    "scc": _sql("scc", "SELECT * FROM scc"),
    "scc_guard": _sql("whole guards", "SELECT component, rep, locks, size, coalesce(guard, '') AS guard FROM whole LEFT JOIN (SELECT component, rep, string_agg(guard, ',' ORDER BY guard) AS guard FROM guards GROUP BY ALL) USING (component, rep)"),
    "deadlock_cycles": _sql("whole guards", "SELECT * FROM whole WHERE (component, rep) NOT IN (SELECT component, rep FROM guards)"),
    "minimal_cycles": _sql("cycles", "SELECT component, rep, array_to_string(cycle, ',') AS cycle FROM cycles"),
    "inversion_guard": _sql("cycles cycle_guards", "SELECT c.component, array_to_string(c.cycle, ',') AS cycle, len(c.cycle) AS size, coalesce(g.guard, '') AS guard FROM cycles c LEFT JOIN (SELECT component, cycle, string_agg(guard, ',' ORDER BY guard) AS guard FROM cycle_guards GROUP BY ALL) g ON g.component = c.component AND g.cycle = c.cycle"),
    "tangle_split": _sql("whole cycles cycle_guards", f"SELECT component, rep, locks, 'component' AS kind FROM whole WHERE size <= {MAX_LOCKS} UNION ALL SELECT c.component, c.rep, array_to_string(cycle, ','), 'inversion' FROM cycles c JOIN whole w ON w.component = c.component AND w.rep = c.rep WHERE size > {MAX_LOCKS} AND len(cycle) <= {MAX_LOCKS} AND (c.component, cycle) NOT IN (SELECT component, cycle FROM cycle_guards)"),
    "report_counts": _sql("whole guards", f"SELECT (SELECT count(*) FROM strong) AS edges, (SELECT count(DISTINCT m) FROM strong) AS methods, (SELECT count(DISTINCT (component, src, dst)) FROM strong) AS orders, (SELECT count(*) FROM whole) AS components, (SELECT count(*) FROM whole WHERE (component, rep) NOT IN (SELECT component, rep FROM guards)) AS cycles, (SELECT count(*) FROM whole WHERE size > {TANGLE}) AS tangles"),
    "supertypes": _sql("supc", "SELECT * FROM supc"),
    "subtype_pairs": _sql("supc body", "SELECT * FROM (SELECT sub, sup FROM supc UNION SELECT class, class FROM body) WHERE sup LIKE 'n%'"),
    "namesig_index": _sql("body", "SELECT namesig, string_agg(mkey, ',' ORDER BY mkey) AS keys FROM body GROUP BY namesig"),
    "instantiated_types": _sql("live", "SELECT * FROM live"),
    "exact_dispatch": _sql("known own", "SELECT site, target, 'receiver' AS how FROM known UNION ALL SELECT site, target, 'declared' FROM own"),
    "rta_dispatch": _sql("few", "SELECT * FROM few"),
    "megamorphic_cut": _sql("cand own", f"SELECT c.site, c.n, (SELECT count(*) FROM own o WHERE o.site = c.site) AS kept FROM (SELECT site, count(*) AS n FROM cand WHERE receiver IS NULL GROUP BY site) c WHERE n > {POLYMORPHIC}"),
    "call_graph": _sql("call", "SELECT component, m, off, kind, callee, is_async, transact, rn FROM call"),
    "async_by_name": _sql("ncall", "SELECT * FROM ncall WHERE name = 'post1' OR declared || '.' || name = 'c7.post2'"),
    "async_by_hierarchy": _sql("defer", "SELECT site FROM defer"),
    "async_veto": _sql("defer", "SELECT site FROM defer WHERE name <> 'post1' AND declared || '.' || name <> 'c20.post4'"),
    "may_acquire": _sql("may", "SELECT * FROM may"),
    "must_entry_strict": must("strict_root") + " SELECT * FROM must",
    "must_entry_race": must("race_root") + " SELECT * FROM must",
    "race_entry_guards": must("race_root", "ev held")
    + """, acc AS (SELECT e.component, e.m, e.field, e.op = 'iput' AS write, e.off FROM ev e WHERE e.op IN ('iget', 'iput')),
g AS (SELECT off, lock FROM held UNION SELECT a.off, u.lock FROM acc a JOIN must u ON u.m = a.m),
tal AS (SELECT component, field, count(*) FILTER (write) AS writes, count(*) FILTER (NOT write) AS reads FROM acc GROUP BY ALL),
ltal AS (SELECT component, field, lock, count(*) FILTER (write) AS w, count(*) FILTER (NOT write) AS r FROM acc JOIN g USING (off) GROUP BY ALL),
every AS (SELECT component, field, writes, max(w) AS guarded_writes, string_agg(lock, ',' ORDER BY lock) AS accepted FROM ltal JOIN tal USING (component, field) WHERE w = writes AND writes > 0 GROUP BY component, field, writes)
SELECT * FROM every UNION ALL SELECT component, field, writes, w, lock FROM (
  SELECT *, row_number() OVER (PARTITION BY component, field ORDER BY w DESC, r DESC, lock) AS rank FROM ltal JOIN tal USING (component, field) WHERE (component, field) NOT IN (SELECT component, field FROM every)) WHERE rank = 1""",
    "interproc_edges": must("strict_root", "may")
    + """ SELECT DISTINCT d.component, d.m, d.line, d.callee, h.lock AS src, t.lock AS dst FROM dag d JOIN may t ON t.m = d.callee JOIN held h ON h.off = d.off
  WHERE h.lock <> t.lock AND NOT EXISTS (SELECT 1 FROM held x WHERE x.off = d.off AND x.lock = t.lock) AND NOT EXISTS (SELECT 1 FROM must u WHERE u.m = d.m AND u.lock = t.lock)""",
    "method_edges": _sql("dag held", "SELECT DISTINCT d.component, d.m, h.lock, d.callee FROM dag d JOIN (SELECT off, max(lock) AS lock FROM held GROUP BY off) h ON h.off = d.off"),
    "ipc_reach": _sql("reach", "SELECT * FROM reach"),
    "ipc_outgoing": _sql("sites", "SELECT component, m, line, callee, direct, array_to_string(held, ',') AS held FROM sites"),
    "ipc_paths": _sql(
        "trail",
        """SELECT component, m, line, array_to_string(path, '>') AS path FROM trail t WHERE (SELECT d FROM near n WHERE n.m = t.node) = 0 OR direct""",
    ),
    "suppressed_cycles": _sql(
        "per_method",
        """SELECT m, rep, size, string_agg(lock, ',' ORDER BY lock) AS guard FROM (
  SELECT m, rep, size, lock FROM (SELECT m, rep, size, total, unnest(guard) AS lock, locks FROM (
    SELECT o.m, x.rep, x.size, list_append(list_distinct(o.guard), 'M' || o.m) AS guard, x.locks, count(*) OVER (PARTITION BY o.m, x.rep) AS total
    FROM ord o JOIN (SELECT m, rep, count(*) AS size, list(lock) AS locks FROM per_method GROUP BY m, rep) x ON x.m = o.m AND list_contains(x.locks, o.src) AND list_contains(x.locks, o.dst)))
  WHERE NOT list_contains(locks, lock) GROUP BY m, rep, size, lock, total HAVING count(*) = total) GROUP BY m, rep, size""",
    ),
    "ipc_incoming": _sql("may sites", "SELECT m % 10 AS component, m, string_agg(lock, ',' ORDER BY lock) AS locks, m IN (SELECT m FROM sites) AS high FROM may WHERE m % 3 = 0 GROUP BY m"),
    "ipc_rank_by_lock": _sql(
        "sites",
        f"""SELECT component, lock, sites, row_number() OVER (PARTITION BY component ORDER BY sites DESC, lock) AS rank, shown FROM (
  SELECT component, lock, max(n) AS sites, string_agg(m || ':' || line, ',' ORDER BY m, line) FILTER (r <= {SAMPLE}) AS shown FROM (
    SELECT *, count(*) OVER (PARTITION BY component, lock) AS n, row_number() OVER (PARTITION BY component, lock ORDER BY m, line) AS r FROM (SELECT DISTINCT component, unnest(held) AS lock, m, line FROM sites)) GROUP BY component, lock)""",
    ),
    "field_tally": _sql("ltal", "SELECT component, field, lock, w, r, writes, reads FROM ltal JOIN tal USING (component, field)"),
    "field_guard": _sql("inferred", "SELECT component, field, writes, reads, array_to_string(accepted, ',') AS accepted FROM inferred WHERE every"),
    "guard_fallback": _sql("inferred", "SELECT component, field, writes, guarded_writes, array_to_string(accepted, ',') AS accepted FROM inferred WHERE NOT every"),
    "race_violations": _sql("bad", "SELECT component, field, m, off, line, write, array_to_string(guards, ',') AS guards FROM bad"),
    "race_report": _sql(
        "bad",
        f"""SELECT component, field, array_to_string(i.accepted, ',') AS guard, i.writes, i.guarded_writes, count(*) AS shown, count(*) FILTER (write) AS bad_writes, string_agg(m || ':' || line, ',' ORDER BY rank) AS sites FROM (
  SELECT *, row_number() OVER (PARTITION BY component, field ORDER BY write DESC, m, line) AS rank FROM (SELECT DISTINCT component, field, write, m, line FROM bad)) JOIN inferred i USING (component, field)
  WHERE rank <= {LISTED} AND i.writes >= {MIN_WRITES} AND i.guarded_writes * 100 >= i.writes * {MIN_COVERAGE} GROUP BY ALL""",
    ),
    "alias_unique": "SELECT l_orderkey AS field, min(l_returnflag) AS lock FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity >= 45) = 0 AND count(DISTINCT l_returnflag) = 1",
    "alias_closure": "WITH RECURSIVE s AS (SELECT p_partkey AS name, p_partkey // 2 AS target FROM part WHERE p_partkey > 0 AND p_partkey % 2 = 0), f AS (SELECT name, target, 1::BIGINT AS hops FROM s UNION ALL SELECT f.name, s.target, f.hops + 1 FROM f JOIN s ON s.name = f.target WHERE f.hops < 6) SELECT name, max_by(target, hops) AS target, max(hops) AS hops FROM f GROUP BY name",
    "flow_order_edges": _sql("ord", "SELECT m, line, src, dst FROM ord"),
    "flow_field_access": _sql("acc", "SELECT m, line, field, write, array_to_string(guards, ',') AS guards FROM acc"),
    "line_asof": _sql("ev", "SELECT e.m, e.off, x.line FROM (SELECT * FROM ev WHERE op <> 'enter') e ASOF LEFT JOIN (SELECT * FROM ev WHERE op = 'enter') x ON x.m = e.m AND x.off <= e.off"),
    "catch_range": _sql("ev", "SELECT e.m, e.off, r.hi AS handler FROM ev e JOIN (SELECT * FROM (SELECT *, lead(off, 5) OVER (PARTITION BY m ORDER BY off) AS hi FROM ev) WHERE op = 'enter' AND hi IS NOT NULL AND k % 10 = 0) r ON r.m = e.m AND e.off >= r.off AND e.off < r.hi WHERE e.op = 'iput'"),
    "value_summary": "SELECT l_orderkey AS m, min(l_returnflag) AS value FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') = 0 AND count(DISTINCT l_returnflag) = 1",
    "class_filter": "SELECT s_suppkey AS m, 'm' || s_nationkey AS name FROM supplier WHERE s_suppkey & 1 = 1 AND s_suppkey & 8 = 0 AND s_nationkey > 1",
    "short_names": "SELECT p_partkey, 'org.shop.' || b AS class, 'get' || p_size || ':(I)V' AS namesig, b || '.get' || p_size AS short, 'shop.' || b AS lock FROM (SELECT *, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS b FROM part)",
    "access_flags": "SELECT s_suppkey, s_suppkey & 8 <> 0 AS static, s_suppkey & 5 <> 0 AS external, greatest(0, s_suppkey % 7 - s_nationkey % 9) AS this FROM supplier",
    "lock_targets": "SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN 'org.Shop' || p_partkey % 9 WHEN 4 THEN 'org.Shop' || p_partkey % 9 ELSE 'mLock' END AS target FROM part",
    "escaped_labels": r"""SELECT p_partkey, '\"' || p_name || '\\' AS label FROM part""",
    "sample_places": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'a.B.m' || p_size || ':()V' END AS mkey, CASE WHEN p_partkey % 3 > 0 THEN p_partkey::INT END AS line FROM part",
    "dotted_names": "SELECT n_nationkey, 'a.b.' || n_name AS dotted, n_name AS plain FROM nation",
    "first_wins_dedup": "SELECT user_id || ':' || event_type AS mkey, min(event_id) AS event_id FROM events GROUP BY ALL",
    "word_sites": _sql("src", f"SELECT path, line_no FROM src WHERE regexp_matches(text, '{_WORD.format('the')}')"),
    "context_window": _sql("src", f"SELECT s.path, s.line_no AS site, l.line_no, length(l.text) AS n FROM src s JOIN src l ON l.path = s.path AND l.line_no BETWEEN s.line_no - 2 AND s.line_no + 1 WHERE regexp_matches(s.text, '{_WORD.format('edble')}')"),
}
