"""Graphs as files that profilers and heap viewers open.  Both take the rows of small result tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable

# Field numbers of the profile message, tags of the heap dump format.
SAMPLE_TYPE, SAMPLE, LOCATION, FUNCTION, STRINGS, TIME, PERIOD_TYPE, PERIOD = 1, 2, 4, 5, 6, 9, 11, 12
STRING, LOAD_CLASS, SEGMENT, SEGMENT_END = 0x01, 0x02, 0x1C, 0x2C
CLASS_DUMP, INSTANCE, OBJECTS, ROOT, OBJECT_TYPE = 0x20, 0x21, 0x22, 0xFF, 2


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(*fields: tuple[int, object]) -> bytes:
    """A protobuf message: numbers as varints, bytes length-delimited, lists of numbers packed."""
    out = bytearray()
    for number, value in fields:
        if isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            body = b"".join(map(_varint, value)) if isinstance(value, list) else value
            out += _varint(number << 3 | 2) + _varint(len(body)) + body
    return bytes(out)


class _Names(dict):
    """Numbers names in the order they come."""

    def __missing__(self, name: str) -> int:
        self[name] = len(self)
        return self[name]


def profile(samples: Iterable[tuple[list[str], int, dict[str, str]]], what: str = "edges", unit: str = "count") -> bytes:
    """A gzipped profile: (stack of names, leaf first; value; labels) per sample.  The same samples give the same bytes."""
    text, place = _Names({"": 0}), _Names()
    kind = _message((1, text[what]), (2, text[unit]))
    rows = []
    for stack, value, labels in samples:
        tags = [(3, _message((1, text[k]), (2, text[v]))) for k, v in labels.items()]
        rows.append((SAMPLE, _message((1, [place[n] + 1 for n in stack]), (2, [value]), *tags)))
    locations = [(LOCATION, _message((1, i + 1), (4, _message((1, i + 1), (2, 0))))) for i in place.values()]
    functions = [(FUNCTION, _message((1, i + 1), (2, text[n]), (3, text[n]), (4, text[n]))) for n, i in place.items()]
    body = _message((SAMPLE_TYPE, kind), *rows, *locations, *functions, *[(STRINGS, s.encode()) for s in text], (TIME, 0), (PERIOD_TYPE, kind), (PERIOD, 1))
    return gzip.compress(body, mtime=0)


def lock_order(edges: Iterable, cyclic: set[str]) -> bytes:
    """``edges``: src, dst, n.  A sample is [held, taken], marked if both are in a cycle."""
    return profile(([e["src"], e["dst"]], e["n"], {"cycle": "yes" if e["src"] in cyclic and e["dst"] in cyclic else "no"}) for e in sorted(edges, key=lambda e: (e["src"], e["dst"])) if e["src"] != e["dst"])


def method_calls(edges: Iterable) -> bytes:
    """``edges``: m, lock, callee.  A sample is [callee, caller], labelled with the lock held."""
    return profile((([e["callee"], e["m"]], 1, {"lock": e["lock"]}) for e in sorted(edges, key=lambda e: (e["m"], e["lock"], e["callee"]))), "calls")


def heap(edges: Iterable) -> bytes:
    """A heap dump of the graph m -lock-> callee: an instance for each method, of a class by its name, that refers to its callees through arrays by lock."""
    calls: dict[str, dict[str, set[str]]] = {}
    for e in edges:
        calls.setdefault(e["m"], {}).setdefault(e["lock"], set()).add(e["callee"])
        calls.setdefault(e["callee"], {})
    ids, text = iter(range(1, 1 << 31)), {}
    strings, loaded, classes, objects, arrays, roots = (bytearray() for _ in range(6))

    def record(tag: int, body: bytes) -> bytes:
        return struct.pack(">BII", tag, 0, len(body)) + body

    def name(s: str) -> int:
        if s not in text:
            text[s] = next(ids)
            strings.extend(record(STRING, struct.pack(">I", text[s]) + s.encode()))
        return text[s]

    def new_class(s: str, fields: list[str]) -> int:
        number, label = next(ids), name(s)
        loaded.extend(record(LOAD_CLASS, struct.pack(">IIII", 0, number, 0, label)))
        parts = [struct.pack(">BII", CLASS_DUMP, number, 0), bytes(24), struct.pack(">IHHH", 4 * len(fields), 0, 0, len(fields))]
        classes.extend(b"".join([*parts, *[struct.pack(">IB", name(f), OBJECT_TYPE) for f in fields]]))
        return number

    me = {m: next(ids) for m in sorted(calls)}
    array_class = new_class("java.lang.Object[]", [])
    for m in sorted(calls):
        held = sorted(calls[m])
        targets = []
        for lock in held:
            array = next(ids)
            to = sorted(me[c] for c in calls[m][lock])
            arrays.extend(struct.pack(f">BIIII{len(to)}I", OBJECTS, array, 0, len(to), array_class, *to))
            targets.append(array)
        cls = new_class(m, held)
        objects.extend(struct.pack(f">BIIII{len(targets)}I", INSTANCE, me[m], 0, cls, 4 * len(targets), *targets))
        roots.extend(struct.pack(">BI", ROOT, me[m]))
    head = b"JAVA PROFILE 1.0.3\0" + struct.pack(">III", 4, 0, 0)
    return head + bytes(strings) + bytes(loaded) + record(SEGMENT, bytes(classes + objects + arrays + roots)) + record(SEGMENT_END, b"")
