"""A program's results as JSON, text, Markdown and Graphviz."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import functions as F

from lockweave.operators import edges as ed
from lockweave.operators import ipc, races
from lockweave.plans.program import Program
from lockweave.sinks import profiles

#: Findings drawn in one diagram, unless names are filtered; edges above which a whole graph isn't drawn.
DIAGRAMS, DRAWN = 100, 20_000


def _steps(cycle: list[str]) -> list[tuple[str, str]]:
    return list(zip(cycle, [*cycle[1:], cycle[0]], strict=True))


def deadlocks(p: Program) -> dict:
    """Counts, candidate cycles with their edges and inversions, and what a common guard rules out."""
    sample = {(r["src"], r["dst"]): r for r in p.order_samples().collect()}
    inversions: dict[str, list] = {}
    for r in p.inversions.collect():
        inversions.setdefault(r["rep"], []).append(r)

    def edge(a: str, b: str) -> dict:
        r = sample[a, b]
        return {"from": a, "to": b, "count": r["n"], "interproc": r["interproc"], "sample": r["mkey"] and f"{r['mkey']}:{r['line']}"}

    rows = sorted(p.components().collect(), key=lambda r: (len(r["locks"]), r["locks"]))
    cycles = []
    for r in rows:
        if not r["guard"]:
            own = set(r["locks"])
            inside = sorted(k for k in sample if k[0] in own and k[1] in own)
            ways = sorted(inversions.get(r["rep"], []), key=lambda x: (bool(x["guard"]), len(x["cycle"]), x["cycle"]))
            cycles.append({"locks": r["locks"], "edges": [edge(a, b) for a, b in inside], "inversions": [{"locks": x["cycle"], "edges": [edge(a, b) for a, b in _steps(x["cycle"])], "guard": x["guard"]} for x in ways]})
    nodes = {r["lock"] for r in p.locks().collect()}
    return {
        "node_count": len(nodes),
        "edge_count": p.edges.count(),
        "method_count": p.methods.count(),
        "scc_count": len(cycles),
        "cycles": cycles,
        "suppressed": [{"locks": r["locks"], "guard": r["guard"]} for r in rows if r["guard"]],
        "nodes": sorted(nodes),
    }


def boundary(p: Program, direction: str = "both", lock: str | None = None, holder: str | None = None) -> dict:
    """What both filters let pass: part of a held lock's name, and part of the holder's or entry's."""
    way = ipc.direction(direction)
    out = [r.asDict() for r in ipc.keep(p.outgoing, "held", lock, holder).orderBy("mkey", "line").collect()] if way != "in" else []
    into = [r.asDict() for r in ipc.keep(p.incoming(), "locks", lock, holder).orderBy(F.desc("high"), "mkey").collect()] if way != "out" else []
    return {"outgoing": out, "incoming": into}


def fields(p: Program, min_writes: int = races.MIN_WRITES, min_coverage: int = races.MIN_COVERAGE, field: str | None = None, guard: str | None = None) -> dict:
    rows = p.races(min_writes, min_coverage, field, guard).orderBy(F.desc("bad_writes"), "field").collect()
    return {"fields": [{"field": r["field"], "guard": r["guard"].replace(",", " | "), "writes": r["writes"], "guarded_writes": r["guarded_writes"], "shown": r["shown"], "violating_writes": r["bad_writes"], "sites": r["sites"].split(",")} for r in rows]}


def verified(p: Program, max_locks: int = 6, sources: str | None = None) -> dict:
    """Candidates with their orders' sites, chains of calls and verdicts, and how many were left out."""
    cycles: dict[tuple, dict] = {}
    for r in p.verify(max_locks, sources).orderBy("verdict", "locks").collect():
        cycles[tuple(r["locks"]), r["kind"]] = {"locks": r["locks"], "kind": r["kind"], "verdict": r["verdict"], "located": r["located"], "edges": []}
    for r in p.located(max_locks, sources).orderBy("src", "dst").collect():
        one = {"from": r["src"], "to": r["dst"], "count": r["n"], "sample": r["m"] and f"{r['m']}:{r['line']}", "path": r["path"], "file": r["file"], "snippet": r["snippet"], "late": bool(r["late"]), "taken": r["taken"]}
        cycles[tuple(r["locks"]), r["kind"]]["edges"].append(one)
    return {**p.candidate_counts(max_locks), "candidates": list(cycles.values())}


def verified_text(report: dict) -> str:
    out = [f"{report['components']} components and {report['inversions']} inversions; left out: {report['gated']} under a common guard, {report['oversize']} too large", ""]
    for c in report["candidates"]:
        out.append(f"{c['verdict']}: {' <-> '.join(sorted(c['locks']))} ({c['located']} of {len(c['edges'])} orders located)")
        for e in c["edges"]:
            out.append(f"    {e['from']} -> {e['to']}  x{e['count']}  {e['file'] or ''} {e['sample'] or ''}".rstrip())
            out += [f"        {line}" for line in (e["snippet"] or "").splitlines()]
            out += ["        deferred work near by: is the lock held when it runs?"] * e["late"]
            out.append(f"        calls: {' > '.join(e['path'])}" if e["path"] else "        no chain of calls found")
            out += [f"        taken at {e['taken']}"] * bool(e["taken"])
        out.append("")
    return "\n".join(out)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(edges: Iterable[tuple[str, str, str]], marked: Iterable[str] = (), title: str = "locks") -> str:
    """A digraph of (from, to, label); marked nodes are red."""
    edges, marked = sorted(set(edges)), set(marked)
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    out = [f"digraph {_quoted(title)} {{", "  rankdir=LR;", "  node [shape=box];"]
    out += [f"  {_quoted(n)}{' [color=red]' if n in marked else ''};" for n in names]
    out += [f"  {_quoted(a)} -> {_quoted(b)}{f' [label={_quoted(label)}]' if label else ''};" for a, b, label in edges]
    return "\n".join([*out, "}", ""])


def cycle_dot(report: dict, tangle: int = 12) -> str:
    """The candidates' edges: small components whole, of tangles the inversions without a guard."""
    edges = [e for c in report["cycles"] for e in (c["edges"] if len(c["locks"]) <= tangle else [e for x in c["inversions"] if not x["guard"] for e in x["edges"]])]
    return dot([(e["from"], e["to"], str(e["count"])) for e in edges], {n for c in report["cycles"] for n in c["locks"]}, "cycles")


def text(report: dict, tangle: int = 12) -> str:
    """The deadlock report for reading."""
    out = [f"{report['node_count']} locks, {report['edge_count']} order edges, {report['method_count']} methods, {report['scc_count']} candidate cycles, {len(report['suppressed'])} ruled out by a common guard", ""]
    for i, c in enumerate(report["cycles"], 1):
        big = len(c["locks"]) > tangle
        out.append(f"#{i} {'tangle of ' + str(len(c['locks'])) + ' locks' if big else ' <-> '.join(c['locks'])}")
        if not big:
            out += [f"    {e['from']} -> {e['to']}  x{e['count']}{' through calls' if e['interproc'] else ''}  {e['sample'] or ''}".rstrip() for e in c["edges"]]
        for x in c["inversions"] if big or len(c["inversions"]) > 1 else []:
            out.append(f"    inversion: {' -> '.join([*x['locks'], x['locks'][0]])}" + (f"  (under {', '.join(x['guard'])})" if x["guard"] else ""))
        out.append("")
    out += [f"ruled out: {' <-> '.join(s['locks'])} under {', '.join(s['guard'])}" for s in report["suppressed"]]
    return "\n".join(out)


def boundary_markdown(report: dict, sample: int = ipc.SAMPLE) -> str:
    by: dict[str, list] = {}
    for r in report["outgoing"]:
        for lock in r["held"]:
            by.setdefault(lock, []).append(r)
    out = ["# Locks across process boundaries", "", f"{len(report['outgoing'])} places hold a lock while calling out; {len(report['incoming'])} entry methods take locks.", ""]
    for lock, rows in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        out += [f"## {lock}", "", f"{len(rows)} places", ""]
        out += [f"- `{r['mkey']}` line {r['line']}: {' > '.join(r['path'])}" for r in rows[:sample]] + [""]
    out += ["## Entry methods", ""] + [f"- {'**high** ' if r['high'] else ''}`{r['mkey']}`: {', '.join(r['locks'])}" for r in report["incoming"]]
    return "\n".join([*out, ""])


def fields_markdown(report: dict) -> str:
    out = ["# Inconsistently guarded fields", ""]
    for r in report["fields"]:
        out += [f"## {r['field']}", "", f"guard {r['guard']}: {r['guarded_writes']} of {r['writes']} writes; {r['violating_writes']} writes without", ""] + [f"- {s}" for s in r["sites"]] + [""]
    return "\n".join(out)


def boundary_dot(report: dict) -> str:
    """From each lock over its holder along the chain of calls to the transaction."""
    steps = [(lock, r["path"][0], "held in") for r in report["outgoing"] for lock in r["held"]]
    steps += [(a, b, "") for r in report["outgoing"] for a, b in zip(r["path"], [*r["path"][1:], "transaction"], strict=True)]
    return dot(steps, {lock for r in report["outgoing"] for lock in r["held"]}, "boundary")


def field_dot(report: dict) -> str:
    """From each place that misses a guard to its field, and from there to the guard."""
    steps = [(s, r["field"], "without") for r in report["fields"] for s in r["sites"]] + [(r["field"], r["guard"], f"{r['guarded_writes']} of {r['writes']}") for r in report["fields"]]
    return dot(steps, {r["field"] for r in report["fields"]}, "fields")


def candidate_calls(report: dict) -> list[dict]:
    """m, lock, callee: the steps of the chains between a candidate's locks, under the lock held first."""
    steps = {(a, e["from"], b) for c in report["candidates"] for e in c["edges"] if e["path"] for a, b in zip(e["path"], [*e["path"][1:], e["to"]], strict=True)}
    return [{"m": m, "lock": lock, "callee": callee} for m, lock, callee in sorted(steps)]


def svg(graph: str, to: Path) -> bool:
    """Drawn by Graphviz where that is installed."""
    if not shutil.which("dot"):
        return False
    return subprocess.run(["dot", "-Tsvg", "-o", str(to)], input=graph.encode(), check=False).returncode == 0


def method_edges(p: Program):
    """m, lock, callee: calls under a lock, by the lock's name."""
    from lockweave.functions import locks as lk

    held = p.call_held.select(F.col("site").alias("call"), lk.name(F.col("held")).alias("held"))
    sites = p.sync.select(F.lit("").alias("component"), F.col("site").alias("call"), F.col("mkey").alias("m"), "callee")
    return ed.method_edges(sites, held).drop("component").collect()


def _written(folder: str | Path, files: dict[str, bytes | str], drawn: dict[str, str]) -> list[str]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in files.items():
        (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return sorted([*files, *[name for name, graph in drawn.items() if svg(graph, folder / name)]])


def write_all(p: Program, folder: str | Path) -> list[str]:
    """The deadlock query's artifacts; returns their names."""
    report = deadlocks(p)
    edges = p.order_samples().collect()
    cyclic = {n for c in report["cycles"] for n in c["locks"]}
    calls = method_edges(p)
    whole = dot([(e["src"], e["dst"], str(e["n"])) for e in edges], cyclic)
    files: dict[str, bytes | str] = {
        "lockgraph.json": json.dumps(report, indent=1),
        "deadlock_cycles.txt": text(report),
        "lockgraph.dot": whole,
        "cycles.dot": cycle_dot(report),
        "lock_order.pb.gz": profiles.lock_order(edges, cyclic),
        "methods.pb.gz": profiles.method_calls(calls),
        "methods.hprof": profiles.heap(calls),
    }
    return _written(folder, files, {"lockgraph.svg": whole} if len(edges) <= DRAWN else {})


def write_verified(p: Program, folder: str | Path, max_locks: int = 6, sources: str | None = None) -> list[str]:
    """The verification's artifacts: report, chains of calls, a graph of the candidates."""
    report = verified(p, max_locks, sources)
    calls = candidate_calls(report)
    graph = dot([(e["from"], e["to"], str(e["count"])) for c in report["candidates"] for e in c["edges"]], {n for c in report["candidates"] for n in c["locks"]}, "candidates")
    files: dict[str, bytes | str] = {"verify.json": json.dumps(report, indent=1), "verify.txt": verified_text(report), "candidates.dot": graph, "candidates.pb.gz": profiles.method_calls(calls), "candidates.hprof": profiles.heap(calls)}
    return _written(folder, files, {"candidates.svg": graph})


def write_boundary(p: Program, folder: str | Path, direction: str = "both", lock: str | None = None, holder: str | None = None) -> list[str]:
    """The process boundary's artifacts; without a filter only the first ``DIAGRAMS`` findings are drawn."""
    report = boundary(p, direction, lock, holder)
    steps = p.boundary_steps(direction, lock, holder).distinct().collect()
    shown = report if lock or holder else {**report, "outgoing": report["outgoing"][:DIAGRAMS]}
    graph = boundary_dot(shown)
    files: dict[str, bytes | str] = {"binder.json": json.dumps(report, indent=1), "binder.md": boundary_markdown(report), "binder.dot": graph, "binder.pb.gz": profiles.method_calls(steps), "binder.hprof": profiles.heap(steps)}
    return _written(folder, files, {"binder.svg": graph})


def write_fields(p: Program, folder: str | Path, min_writes: int = races.MIN_WRITES, min_coverage: int = races.MIN_COVERAGE, field: str | None = None, guard: str | None = None) -> list[str]:
    """The guarded fields' artifacts; without a filter only the first ``DIAGRAMS`` fields are drawn."""
    report = fields(p, min_writes, min_coverage, field, guard)
    graph = field_dot(report if field or guard else {"fields": report["fields"][:DIAGRAMS]})
    return _written(folder, {"races.json": json.dumps(report, indent=1), "races.md": fields_markdown(report), "races.dot": graph}, {"races.svg": graph})
