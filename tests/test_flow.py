"""The method flow holds one method and a bounded number of facts, whatever a batch has."""

import tracemalloc

import pyarrow as pa

from lockweave.operators import flow


def _methods(n):
    def insn(i, op, **more):
        empty = dict.fromkeys(("dst", "src", "base", "cls", "member", "sig", "kind", "args", "target", "effect", "summary"))
        return {"idx": i, "off": i, "op": op, **empty, **more}

    body = [insn(0, "sget", dst=0, cls="S", member="L"), insn(1, "monitor_enter", src=0), *[insn(i, "iput", src=1, base=7, cls="C", member="F") for i in range(2, 60)]]
    whole = {"class": "C", "name": "m", "access": 1, "registers": 8, "ins": 1, "insns": body, "positions": [{"at": 0, "off": 0, "line": 1}], "catches": []}
    ints = ("idx", "off", "dst", "src", "base", "target")
    one = pa.struct([(k, pa.int32() if k in ints else pa.string()) for k in body[0]])
    shape = pa.schema([("mkey", pa.string()), *[(k, pa.string()) for k in ("class", "name")], *[(k, pa.int32()) for k in ("access", "registers", "ins")], ("insns", pa.list_(one)), ("positions", pa.list_(pa.struct([(k, pa.int32()) for k in ("at", "off", "line")]))), ("catches", pa.list_(pa.struct([(k, pa.int32()) for k in ("lo", "hi", "handler")])))])
    return pa.RecordBatch.from_pylist([{"mkey": f"C.m{i}:()V", **whole} for i in range(n)], shape)


def test_facts_of_a_large_batch_in_bounded_memory():
    batch, want = _methods(1500), 1500 * 59
    tracemalloc.start()
    sizes, held = [], set()
    for out in flow.in_pieces(iter([batch])):
        sizes.append(out.num_rows)
        held |= {tuple(x) for x in out.column("list").to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == want and max(sizes) <= flow.OUT and held == {(), ("s|S|L|",)}
    assert peak < 30 << 20


def test_pieces_end_anywhere():
    batch = _methods(3)
    whole = [r for out in flow.in_pieces(iter([batch])) for r in out.to_pylist()]
    assert [r for out in flow.in_pieces(iter([batch.slice(0, 1), batch.slice(1)]), 7) for r in out.to_pylist()] == whole
    assert [r["seq"] for r in whole if r["mkey"] == "C.m1:()V" and r["fact"] == "access"] == list(range(58))
