"""Reports and exchange formats."""

import gzip
import json
import struct

from lockweave import cli
from lockweave.sinks import profiles, reports
from tests.asm import call, clazz, method, nested

C = "t.C"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    helper = method(C, "b", nested(C, "B"), access=0xA, ins=0)
    text = clazz(C, [method(C, "m1", nested(C, "A", "B", inner=[call("static", [], C, "b")])), method(C, "m2", nested(C, "B", "A")), helper])
    (tmp_path / "in" / "a.txt").write_text("\n".join(text))
    assert cli.main(["analyze", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0
    assert "t.C.A <-> t.C.B" in capsys.readouterr().out
    report = json.loads((tmp_path / "out" / "lockgraph.json").read_text())
    assert report["scc_count"] == 1 and report["cycles"][0]["locks"] == ["t.C.A", "t.C.B"] and report["cycles"][0]["inversions"][0]["locks"] == ["t.C.A", "t.C.B"]
    assert '"t.C.A" -> "t.C.B"' in (tmp_path / "out" / "cycles.dot").read_text()
    body = gzip.decompress((tmp_path / "out" / "lock_order.pb.gz").read_bytes())
    assert b"t.C.A" in body and b"yes" in body
    assert (tmp_path / "out" / "methods.hprof").read_bytes().startswith(b"JAVA PROFILE 1.0.3\0")
    (tmp_path / "src" / "t").mkdir(parents=True)
    (tmp_path / "src" / "t" / "C.java").write_text("\n".join(["// synchronized (B)", "class C {", "  synchronized (B) {", "  h.post(run);", "  synchronized (A) {"] + ["x"] * 20))
    assert cli.main(["verify", str(tmp_path / "in"), "--source-root", str(tmp_path / "src"), "--out", str(tmp_path / "checked")], spark) == 0
    assert "both: t.C.A <-> t.C.B (2 of 2 orders located)" in capsys.readouterr().out
    report = json.loads((tmp_path / "checked" / "verify.json").read_text())
    assert (report["components"], report["inversions"], report["gated"], report["oversize"]) == (1, 0, 0, 0)
    one, two = report["candidates"][0]["edges"]
    assert one["path"][-1].startswith("t.C.m1:") and one["file"] == "t/C.java" and one["taken"] == "t/C.java:3  synchronized (B) {"
    assert two["path"] == [two["path"][0]] and two["taken"].startswith("t/C.java:5 ") and {e["late"] for e in (one, two)} <= {True, False}
    # without the sources nothing is located
    (tmp_path / "src" / "t" / "C.java").rename(tmp_path / "src" / "t" / "D.java")
    assert cli.main(["verify", str(tmp_path / "in"), "--source-root", str(tmp_path / "src")], spark) == 0
    assert "unresolved: t.C.A <-> t.C.B (0 of 2" in capsys.readouterr().out


def test_profile_is_reproducible():
    edges = [{"src": "a", "dst": "b", "n": 300}, {"src": "b", "dst": "a", "n": 1}]
    one = profiles.lock_order(edges, {"a", "b"})
    assert one == profiles.lock_order(edges[::-1], {"a", "b"})
    body = gzip.decompress(one)
    assert b"\x12\x02\xac\x02" in body  # the packed value 300


def test_heap_records_add_up():
    dump = profiles.heap([{"m": "x", "lock": "L", "callee": "y"}, {"m": "x", "lock": "L", "callee": "z"}])
    at, tags = len(b"JAVA PROFILE 1.0.3\0") + 12, []
    while at < len(dump):
        tag, _, n = struct.unpack_from(">BII", dump, at)
        tags.append(tag)
        at += 9 + n
    assert at == len(dump) and tags[-2:] == [profiles.SEGMENT, profiles.SEGMENT_END] and tags.count(profiles.LOAD_CLASS) == 4


def test_text_and_dot():
    x = {"locks": ["a", "b"], "edges": [], "guard": []}
    report = {"node_count": 13, "edge_count": 14, "method_count": 3, "scc_count": 1, "cycles": [{"locks": [f"l{i}" for i in range(13)], "edges": [], "inversions": [x]}], "suppressed": [{"locks": ["p", "q"], "guard": ["g"]}], "nodes": []}
    shown = reports.text(report)
    assert "tangle of 13 locks" in shown and "inversion: a -> b -> a" in shown and "ruled out: p <-> q under g" in shown
    assert reports.dot([('q"', "b", "1")]).count('\\"') == 2


def test_diagrams():
    out = {"outgoing": [{"mkey": "m", "line": 1, "held": ["L"], "path": ["m", "n"]}], "incoming": [{"mkey": "e", "locks": ["L"], "high": True}]}
    shown = reports.boundary_dot(out)
    assert '"L" -> "m"' in shown and '"n" -> "transaction"' in shown
    assert "**high** `e`: L" in reports.boundary_markdown(out) and "m > n" in reports.boundary_markdown(out)
    races = {"fields": [{"field": "f", "guard": "g", "writes": 3, "guarded_writes": 2, "violating_writes": 1, "sites": ["m:4"]}]}
    assert '"m:4" -> "f"' in reports.field_dot(races) and "2 of 3 writes" in reports.fields_markdown(races)
    report = {"candidates": [{"edges": [{"from": "L", "to": "M", "path": ["a", "b"]}, {"from": "M", "to": "L", "path": None}]}]}
    assert reports.candidate_calls(report) == [{"m": "a", "lock": "L", "callee": "b"}, {"m": "b", "lock": "L", "callee": "M"}]
