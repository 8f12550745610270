"""Lock orders of a stream of events, as they come.

An extension beside the batch rules: each method's held locks are state, and each
acquisition emits an edge from every lock held.  Events of a method must come in the
order of their offsets, as from an ordered log; one at or before the last offset seen
is a repeat and does nothing, so that a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

OUT = "component bigint, m bigint, off bigint, src string, dst string"
STATE = "last bigint, locks array<string>, counts array<int>"


def order_edges(instr: DataFrame) -> DataFrame:
    """``instr``: a stream of component, m, off, op (enter or exit), lock.  Returns a stream of order edges."""
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, names, numbers = state.get if state.exists else (-1, [], [])
        held = dict(zip(names, numbers, strict=True))
        rows = pd.concat(list(batches)).sort_values("off")
        found = []
        for component, off, op, lock in rows[["component", "off", "op", "lock"]].itertuples(index=False):
            if off <= last:
                continue
            last = int(off)
            if op == "enter":
                if lock not in held:
                    found += [(component, key[0], last, h, lock) for h in sorted(held)]
                held[lock] = held.get(lock, 0) + 1
            elif lock in held:
                held[lock] -= 1
                if not held[lock]:
                    del held[lock]
        state.update((last, list(held), list(held.values())))
        yield pd.DataFrame(found, columns=["component", "m", "off", "src", "dst"])

    some = instr.where("op in ('enter', 'exit')").select("component", "m", "off", "op", "lock")
    return some.groupBy("m").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
