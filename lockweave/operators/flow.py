"""What one method does, from its instructions: the only per-method sequential code.

A pass over the instructions follows what each register names; the locks held before
each instruction are then the greatest solution over the control flow (a lock counts
as often as it is taken on every way in).  Facts come out as one wide table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.plans.loop import bounded

if TYPE_CHECKING:
    import pyarrow as pa

#: Access bit of static methods; names and calls of explicit locks.
STATIC = 0x8
LOCK_TYPES = ("Lock", "ReentrantLock", "ReentrantReadWriteLock", "ReadLock", "WriteLock")
TAKING, TRYING, LEAVING = ("lock", "lockInterruptibly", "acquire", "acquireUninterruptibly"), ("tryLock", "tryAcquire"), ("unlock", "release")

#: Facts that a worker holds before it hands them on.
OUT = 4096

FACTS = (
    "mkey string, class string, fact string, seq int, a string, b string, c string, line int, flag boolean, list array<string>, args array<string>"
)


def classified(insns: DataFrame, deferring: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """``insns`` with effect: what an invocation does to locks, or that it defers work.

    ``deferring``: cls, member; ``add`` and ``remove``: entry (tables of a configuration).
    """
    from lockweave.operators.calls import hit

    cls, name = F.col("cls"), F.col("member")
    calls = insns.where("op = 'invoke'").select("cls", "member").distinct()
    based = calls.join(F.broadcast(deferring), ["cls", "member"], "left_semi")
    added = calls.join(F.broadcast(add), hit(F.col("entry"), cls, name), "left_semi")
    late = based.union(added).distinct().join(F.broadcast(remove), hit(F.col("entry"), cls, name), "left_anti").withColumn("late", F.lit(True))
    explicit = F.substring_index("cls", ".", -1).isin(*LOCK_TYPES) | F.contains("cls", F.lit("locks."))
    effect: Column = F.when(F.col("late"), "async").when(name == "readLock", "read").when(name == "writeLock", "write")
    effect = effect.when(explicit & name.isin(*TAKING), "take").when(explicit & name.isin(*TRYING), "try").when(explicit & name.isin(*LEAVING), "leave")
    return insns.join(late, ["cls", "member"], "left").withColumn("effect", F.when(F.col("op") == "invoke", effect)).drop("late")


def _name(lock: tuple) -> str:
    kind, root, fields, mode = lock
    text = {"t": "this", "p": f"$p{root}", "c": f"{root}.class", "a": f"new@{root}", "o": f"?@{root}"}.get(kind, root)
    return ".".join([text, *fields, *([mode] if mode else [])])


def _text(lock: tuple | None) -> str | None:
    return None if lock is None else "|".join((lock[0], lock[1].replace("|", "!"), ".".join(lock[2]), lock[3]))


def _lock(text: str) -> tuple:
    kind, root, fields, mode = text.split("|")
    return kind, root, tuple(fields.split(".")) if fields else (), mode


def held_before(insns: list[dict], effects: dict[int, tuple[str, tuple]], catches: list[dict]) -> list[dict[tuple, int]]:
    """The locks held before each instruction, with how often.

    Unreached instructions hold none.  An exception leaves an instruction after its
    effect.  The first instruction holds none, whatever leads back to it.
    """
    n, at = len(insns), {x["off"]: i for i, x in enumerate(insns)}
    ways: list[list[int]] = []
    for i, x in enumerate(insns):
        after = [i + 1] if i + 1 < n else []
        jump = [at[x["target"]]] if x["op"] in ("goto", "branch") and x["target"] in at else []
        ways.append([] if x["op"] in ("return", "throw") else jump if x["op"] == "goto" else jump + after)
    for c in catches:
        if c["handler"] in at:
            for i, x in enumerate(insns):
                if c["lo"] <= x["off"] < c["hi"]:
                    ways[i].append(at[c["handler"]])
    into: list[list[int]] = [[] for _ in range(n)]
    for i, w in enumerate(ways):
        for j in set(w):
            into[j].append(i)
    state: list[dict | None] = [None] * n
    if n:
        state[0] = {}

    def leaving(i: int) -> dict | None:
        s = state[i]
        if s is None or i not in effects:
            return s
        what, lock = effects[i]
        count = s.get(lock, 0) + (1 if what == "enter" else -1)
        out = {k: v for k, v in s.items() if k != lock}
        if count > 0:
            out[lock] = count
        return out

    # a change at one instruction concerns only those it leads to
    todo = [j for j in (ways[0] if n else []) if j]
    while todo:
        j = todo.pop()
        new: dict | None = None
        for i in into[j]:
            s = leaving(i)
            if s is not None:
                new = dict(s) if new is None else {k: min(v, s[k]) for k, v in new.items() if k in s}
        if new != state[j]:
            state[j] = new
            todo += [k for k in set(ways[j]) if k]
    return [s or {} for s in state]


def method_facts(m: dict) -> Iterator[tuple]:
    """Rows (fact, seq, a, b, c, line, flag, list, args) of one method."""
    key, cls, name = m["mkey"], m["class"], m["name"]
    insns, lines = m["insns"] or [], m["positions"] or []
    first = max(0, m["registers"] - m["ins"])
    regs: dict[int, tuple] = {first + j: ("p", str(j), (), "") for j in range(m["ins"])}
    if not m["access"] & STATIC:
        regs[first] = ("t", "", (), "")
    made: dict[str, str] = {}
    ctor = name == "<init>"
    hushed = name in ("<init>", "<clinit>") or name.startswith(("lambda$", "access$", "-$$")) or "$$Nest" in name
    effects: dict[int, tuple[str, tuple]] = {}
    later: list[tuple] = []
    result: tuple | None = None
    returned: list[tuple | None] = []
    chained = False

    def grounded(lock: tuple) -> tuple:
        if lock[0] == "t":
            return ("r", cls, *lock[2:])
        return ("o", f"{key}#p{lock[1]}", (), "") if lock[0] == "p" else lock

    def line_at(off: int) -> int | None:
        found = None
        for p in lines:
            if p["off"] > off:
                break
            found = p["line"]
        return found

    def through(lock: tuple, args: list[tuple | None]) -> tuple | None:
        """A callee's value in terms of this method."""
        if lock[0] not in "tp":
            return lock
        i = 0 if lock[0] == "t" else int(lock[1])
        arg = args[i] if i < len(args) else None
        if arg is None:
            return None
        long = (arg[0], arg[1], arg[2] + lock[2], lock[3] or arg[3])
        return ("o", f"trunc:{_name(long)}", (), "") if len(long[2]) > 3 else long

    def named(reg: int) -> str | None:
        """A base that is a field or static of its own."""
        v = regs.get(reg)
        return _name(v) if v and v[0] in "rs" and v[2] else None

    def put(reg: int, v: tuple | None) -> None:
        if v is None:
            regs.pop(reg, None)
        else:
            regs[reg] = v

    for i, x in enumerate(insns):
        op, line = x["op"], line_at(x["off"])
        if op == "sget":
            regs[x["dst"]] = ("s", x["cls"], (x["member"],), "")
        elif op in ("iget", "iput"):
            field = f"{x['cls']}.{x['member']}"
            base = regs.get(x["base"])
            fresh, inst = base is not None and base[0] == "a", named(x["base"])
            if op == "iget":
                regs[x["dst"]] = ("r", x["cls"], (x["member"],), "")
            else:
                v = regs.get(x["src"])
                if ctor and v:
                    if v[0] in "tp":
                        yield "capture", 0 if v[0] == "t" else int(v[1]), field, None, None, None, None, None, None
                    if v[0] in "rs" and v[2] and _name(v) != field:
                        yield "alias", None, field, _text(v), None, None, None, None, None
                if v and v[0] == "a" and v[1] in made:
                    yield "store", None, field, made[v[1]], None, None, None, None, None
            if not fresh and not hushed:
                later.append((i, "access", field, inst, line, op == "iput"))
        elif op == "const_class":
            regs[x["dst"]] = ("c", x["cls"], (), "")
        elif op == "new_instance":
            site = f"{key}+{x['off']:04x}"
            regs[x["dst"]], made[site] = ("a", site, (), ""), x["cls"]
            yield "alloc", None, site, x["cls"], None, None, None, None, None
        elif op == "move":
            put(x["dst"], regs.get(x["src"]))
        elif op == "move_result":
            put(x["dst"], result)
            result = None
        elif op == "def":
            regs.pop(x["dst"], None)
        elif op == "return":
            returned.append(regs.get(x["src"]) if x["src"] is not None else None)
        elif op in ("monitor_enter", "monitor_exit"):
            v = regs.get(x["src"])
            if op == "monitor_enter":
                v = v or ("o", f"{key}+{x['off']:04x}", (), "")
                effects[i] = ("enter", grounded(v))
                later.append((i, "acquire", v, line, False))
            elif v:
                effects[i] = ("exit", grounded(v))
        elif op == "invoke":
            result = None
            args = [regs.get(r) for r in x["args"] or []]
            head = args[0] if args else None
            target = f"{x['cls']}.{x['member']}:{x['sig']}"
            if x["member"] == "<init>" and head:
                if head[0] == "a":
                    yield "init", None, head[1], target, None, None, None, None, [_text(a) for a in args]
                elif head[0] == "t" and ctor and not chained:
                    chained = True
                    yield "super", None, target, None, None, None, None, None, [None if a is None or a[0] not in "tp" else "0" if a[0] == "t" else a[1] for a in args]
            effect = x["effect"]
            if effect in ("read", "write"):
                result = head and (*head[:3], effect)
            elif effect in ("take", "try"):
                v = head or ("o", f"{key}+{x['off']:04x}", (), "")
                effects[i] = ("enter", grounded(v))
                later.append((i, "acquire", v, line, effect == "try"))
            elif effect == "leave":
                if head:
                    effects[i] = ("exit", grounded(head))
            else:
                if effect is None and x["summary"]:
                    result = through(_lock(x["summary"]), args)
                known = made.get(head[1]) if head and head[0] == "a" and not head[2] and x["kind"] in ("virtual", "interface") else None
                later.append((i, "call", x["kind"], x["cls"], f"{x['member']}:{x['sig']}", known, [_text(a) for a in args], line, effect == "async"))

    before = held_before(insns, effects, m["catches"] or [])
    number = {"call": 0, "access": 0, "acquire": 0}
    for i, what, *rest in later:
        held = sorted(before[i], key=_name)
        texts = [_text(h) for h in held]
        seq = number[what]
        number[what] += 1
        if what == "access":
            field, inst, line, write = rest
            yield "access", seq, field, inst, None, line, write, texts, None
        elif what == "call":
            kind, dclass, sig, known, args, line, late = rest
            yield "call", seq, kind, dclass, sig, line, late, texts, [known, *args]
        else:
            lock, line, trying = rest
            to = grounded(lock)
            if to in before[i]:
                continue
            yield "acquire", seq, _text(lock), None, None, line, trying, texts, None
            if not trying and to[0] != "o":
                for h in held:
                    if h[0] != "o":
                        yield "edge", seq, _text(h), _text(to), None, line, False, [*texts, _text(to)], None
    if returned and returned[0] and all(r == returned[0] for r in returned) and returned[0][0] in "tprsc":
        yield "value", None, _text(returned[0]), None, None, None, None, None, None


def in_pieces(batches: Iterator[pa.RecordBatch], most: int = OUT) -> Iterator[pa.RecordBatch]:
    """The facts of the methods in ``batches``: one method is unpacked at a time, and ``most`` facts are held."""
    import json

    import pyarrow as pa

    names = ["mkey", "class", "fact", "seq", "a", "b", "c", "line", "flag", "list", "args"]
    types = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 3 + [pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
    rows: list[tuple] = []
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    for batch in batches:
        for i in range(batch.num_rows):
            m = batch.slice(i, 1).to_pylist()[0]
            for x in m["insns"] or []:
                x["args"] = json.loads(x["args"]) if x["args"] else None
            for r in method_facts(m):
                rows.append((m["mkey"], m["class"], *r))
                if len(rows) >= most:
                    yield packed()
                    rows = []
    if rows:
        yield packed()


def facts(methods: DataFrame, insns: DataFrame, positions: DataFrame, catches: DataFrame, getters: DataFrame | None = None) -> DataFrame:
    """All methods' facts; ``insns`` with effect; ``getters``: mkey, a (the value a method returns).

    A key that several methods have is the first one's.
    """
    from lockweave.functions.names import first_wins

    own = first_wins(methods, ["mkey"], "ord").select("mkey", "ord", "class", "name", "access", "registers", "ins")
    target = F.concat(F.col("cls"), F.lit("."), F.col("member"), F.lit(":"), F.col("sig"))
    if getters is None:
        called = insns.withColumn("summary", F.lit(None).cast("string"))
    else:
        known = getters.select(F.col("mkey").alias("called"), F.col("a").alias("summary"))
        called = insns.withColumn("called", F.when(F.col("op") == "invoke", target)).join(known, "called", "left").drop("called")
    columns = ["idx", "off", "op", "dst", "src", "base", "cls", "member", "sig", "kind", "args", "target", "effect", "summary"]
    by = lambda rows, *cols: rows.groupBy("mkey", "ord").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    body = by(called.withColumn("args", F.to_json("args")), *columns).withColumnRenamed("rows", "insns")
    places = positions.groupBy("mkey", "ord").agg(F.array_sort(F.collect_list(F.struct("at", "off", "line"))).alias("positions"))
    ranges = by(catches, "lo", "hi", "handler").withColumnRenamed("rows", "catches")
    whole = own.join(body, ["mkey", "ord"], "left").join(places, ["mkey", "ord"], "left").join(ranges, ["mkey", "ord"], "left").drop("ord")

    return bounded(whole).mapInArrow(in_pieces, FACTS)
