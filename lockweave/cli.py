"""Command line: analyze, verify, binder, races over disassembly text, archives or images."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lockweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("analyze", "verify", "binder", "races"):
        one = sub.add_parser(name)
        one.add_argument("path", help="disassembly text (a file or folder), an archive or image, or a folder of these")
        one.add_argument("--scope", help="part of the names of the jars to take from a build's output folder")
        one.add_argument("--async-dispatch", help="file of calls that defer work")
        one.add_argument("--out", help="folder for artifacts")
    sub.choices["analyze"].add_argument("--format", choices=("text", "json", "dot", "none"), default="text")
    sub.choices["verify"].add_argument("--max-locks", type=int, default=6)
    sub.choices["verify"].add_argument("--source-root", help="root of a source tree")
    sub.choices["binder"].add_argument("--direction", default="both")
    sub.choices["binder"].add_argument("--lock", help="part of a lock's name")
    sub.choices["binder"].add_argument("--class", dest="holder", help="part of the holder's or entry method's name")
    sub.choices["races"].add_argument("--field", help="part of a field's name")
    sub.choices["races"].add_argument("--guard", help="part of a guard's name")
    sub.choices["races"].add_argument("--min-writes", type=int, default=2)
    sub.choices["races"].add_argument("--min-coverage", type=int, default=66)
    return top


def lines(spark, path: str, scope: str | None = None):
    """The disassembly of ``path``: text as it is; archives and images go through the disassembler."""
    from pathlib import Path

    from lockweave.sources import archives, disassembly

    here = Path(path)
    binary = here.suffix in (".jar", ".apk", ".dex", ".zip") or here.is_dir() and ((here / "soong").is_dir() or any(f.suffix in (".jar", ".apk", ".dex") for f in here.iterdir()))
    if not binary:
        return disassembly.read(spark, path)
    return disassembly.lines(archives.disassembled(archives.images(archives.files(spark, path, scope))))


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from lockweave.plans.loop import ship
    from lockweave.plans.program import Program
    from lockweave.sinks import reports
    from lockweave.sources import async_config, disassembly

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lockweave").getOrCreate()
    ship(spark)
    p = Program(disassembly.parse(lines(spark, args.path, args.scope)), async_config.load(spark, args.async_dispatch))
    if args.command == "analyze":
        report = reports.deadlocks(p)
        shown = {"text": lambda: reports.text(report), "json": lambda: json.dumps(report, indent=1), "dot": lambda: reports.cycle_dot(report), "none": lambda: ""}[args.format]()
        write = lambda: reports.write_all(p, args.out)
    elif args.command == "verify":
        shown = reports.verified_text(reports.verified(p, args.max_locks, args.source_root))
        write = lambda: reports.write_verified(p, args.out, args.max_locks, args.source_root)
    elif args.command == "binder":
        shown = reports.boundary_markdown(reports.boundary(p, args.direction, args.lock, args.holder))
        write = lambda: reports.write_boundary(p, args.out, args.direction, args.lock, args.holder)
    else:
        shown = reports.fields_markdown(reports.fields(p, args.min_writes, args.min_coverage, args.field, args.guard))
        write = lambda: reports.write_fields(p, args.out, args.min_writes, args.min_coverage, args.field, args.guard)
    if shown:
        print(shown)
    if args.out:
        print("\n".join(write()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
