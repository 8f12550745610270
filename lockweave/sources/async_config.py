"""Which calls defer work: the built-in bases, and a text file that adds to or takes from them.

File: one entry a line; ``#`` starts a comment; ``pkg.Class.method``, ``Class.method``
or ``method`` defers that call, with ``-`` in front it doesn't; ``extends pkg.Base: m1
m2`` adds methods of a base type, ``-extends pkg.Base`` takes the base out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Public types of the platform and the methods of theirs that defer work.
BASES: dict[str, str] = {
    "android.os.Handler": "post postDelayed postAtTime postAtFrontOfQueue sendMessage sendMessageDelayed sendMessageAtTime sendMessageAtFrontOfQueue sendEmptyMessage sendEmptyMessageDelayed sendEmptyMessageAtTime",
    "java.util.concurrent.Executor": "execute",
    "java.util.concurrent.ExecutorService": "submit",
    "java.util.concurrent.ScheduledExecutorService": "schedule scheduleAtFixedRate scheduleWithFixedDelay",
    "java.lang.Thread": "start",
    "android.os.AsyncTask": "execute executeOnExecutor",
    "android.os.Message": "sendToTarget",
    "android.view.View": "post postDelayed postOnAnimation postOnAnimationDelayed",
    "android.app.Activity": "runOnUiThread",
    "java.util.Timer": "schedule scheduleAtFixedRate",
    "java.util.concurrent.CompletableFuture": "runAsync supplyAsync thenApplyAsync thenAcceptAsync thenRunAsync thenCombineAsync thenComposeAsync whenCompleteAsync handleAsync exceptionallyAsync acceptEitherAsync applyToEitherAsync thenAcceptBothAsync runAfterBothAsync runAfterEitherAsync",
}
# Public types and what they extend, as far as the bases go.
SUPERS: dict[str, tuple[str, ...]] = {
    "android.os.HandlerThread": ("java.lang.Thread",),
    "android.os.HandlerExecutor": ("java.util.concurrent.Executor",),
    "java.util.concurrent.ExecutorService": ("java.util.concurrent.Executor",),
    "java.util.concurrent.ScheduledExecutorService": ("java.util.concurrent.ExecutorService",),
    "java.util.concurrent.AbstractExecutorService": ("java.util.concurrent.ExecutorService",),
    "java.util.concurrent.ThreadPoolExecutor": ("java.util.concurrent.AbstractExecutorService",),
    "java.util.concurrent.ScheduledThreadPoolExecutor": ("java.util.concurrent.ThreadPoolExecutor", "java.util.concurrent.ScheduledExecutorService"),
    "java.util.concurrent.ForkJoinPool": ("java.util.concurrent.AbstractExecutorService",),
}


@dataclass
class AsyncConfig:
    add: set[str] = field(default_factory=set)
    remove: set[str] = field(default_factory=set)
    add_base: dict[str, set[str]] = field(default_factory=dict)
    remove_base: set[str] = field(default_factory=set)

    def bases(self) -> list[tuple[str, str]]:
        """(type, method) pairs by base, without the bases taken out."""
        every = [(b, m) for b, ms in BASES.items() for m in ms.split()] + [(b, m) for b, ms in self.add_base.items() for m in ms]
        return sorted({p for p in every if p[0] not in self.remove_base})

    def known(self) -> list[tuple[str, str]]:
        """(type, method) pairs of the bases and of all known types below them."""
        def ups(t: str, seen: set[str]) -> set[str]:
            for s in SUPERS.get(t, ()):
                if s not in seen:
                    ups(s, seen | {t})
                    found.add(s)
            return found

        out = set(self.bases())
        for t in SUPERS:
            found: set[str] = set()
            ups(t, set())
            out |= {(t, m) for b, m in self.bases() if b in found}
        return sorted(out)


def parse(text: str) -> AsyncConfig:
    config = AsyncConfig()
    for raw in text.splitlines():
        line = raw.partition("#")[0].strip()
        if not line:
            continue
        minus = line.startswith("-")
        body = line[1:].strip() if line[0] in "+-" else line
        if body.startswith("extends "):
            base, colon, methods = body[len("extends ") :].partition(":")
            base = base.strip()
            if "." not in base:
                raise ValueError(f"a base needs its full name: {line}")
            if minus:
                config.remove_base.add(base)
            elif not colon:
                raise ValueError(f"a base needs a colon and methods: {line}")
            elif not methods.split():
                raise ValueError(f"a base needs methods: {line}")
            else:
                config.add_base.setdefault(base, set()).update(methods.replace(",", " ").split())
        else:
            (config.remove if minus else config.add).add(body)
    return config


def load(spark, path: str | None) -> AsyncConfig:
    if path is None:
        return AsyncConfig()
    return parse("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
