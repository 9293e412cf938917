"""Command line: python -m snaplake.cli <command>."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import format_size
from .model import COMPRESSION_LEVEL, LakeError
from .repo import Repo
from .sources.worktree import file_list


def table(columns: list[str], rows: list[tuple], out=None, err=None) -> None:
    """The header to stderr, rows padded to stdout."""
    text = [[str(v) for v in r] for r in rows]
    widths = [max(map(len, c)) for c in zip(columns, *text, strict=True)]
    line = lambda r: " ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    print(line(columns), file=err or sys.stderr)
    for r in text:
        print(line(r), file=out or sys.stdout)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="snaplake")
    p.add_argument("--data-dir")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("store")
    c.add_argument("snapshot")
    lists = c.add_mutually_exclusive_group()
    lists.add_argument("--files-from")
    lists.add_argument("--files0-from")
    c = sub.add_parser("pack")
    c.add_argument("name")
    c.add_argument("--frames", type=int, default=0)
    c.add_argument("--compression-level", type=int, default=COMPRESSION_LEVEL)
    lists = c.add_mutually_exclusive_group()
    lists.add_argument("--snapshots-from")
    lists.add_argument("--snapshots0-from")
    c = sub.add_parser("extract")
    c.add_argument("snapshot")
    for flag in ("--reset", "--verify", "--force"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("list")
    c.add_argument("packs", nargs="*")
    c.add_argument("--format", default="%s")
    c = sub.add_parser("list-packs")
    c.add_argument("--format", default="%p")
    c = sub.add_parser("list-files")
    c.add_argument("snapshot")
    c.add_argument("--format", default="%o %b %f")
    c = sub.add_parser("find")
    c.add_argument("term", nargs="?", default="")
    c = sub.add_parser("show")
    c.add_argument("snapshot")
    c.add_argument("paths", nargs="+")
    c = sub.add_parser("gc")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("-s", "--loose-snapshots", action="store_true")
    c.add_argument("-o", "--loose-objects", action="store_true")
    sub.add_parser("update")
    c = sub.add_parser("clone")
    c.add_argument("url")
    c.add_argument("directory")
    c = sub.add_parser("explode")
    c.add_argument("pack")
    c.add_argument("directory", nargs="?", default="exploded")
    return p


def run(a: argparse.Namespace, spark: SparkSession, root: str = ".") -> None:
    if a.command == "clone":
        Repo.clone(spark, a.url, a.directory)
        return
    repo = Repo(spark, root, a.data_dir)
    if a.command == "store":
        path = a.files_from or a.files0_from
        if path == "-":
            end = "\0" if a.files0_from else "\n"
            names = spark.createDataFrame([(n,) for n in sys.stdin.read().split(end) if n], "path string")
        else:
            names = file_list(spark, path, bool(a.files0_from)) if path else None
        repo.store(a.snapshot, names)
    elif a.command == "pack":
        path = a.snapshots_from or a.snapshots0_from
        packs = ["loose/" + r.path.split(":")[-1] for r in file_list(spark, path, bool(a.snapshots0_from)).collect()] if path else None
        repo.pack(a.name, packs, a.frames, a.compression_level)
    elif a.command == "extract":
        n = repo.extract(a.snapshot, a.reset, a.force, a.verify)
        print(f"A {n['A']}\tD {n['D']}\tM {n['M']}", file=sys.stderr)
    elif a.command in ("list", "list-packs", "list-files"):
        lines = repo.list(a.packs or None, a.format) if a.command == "list" else repo.list_packs(a.format) if a.command == "list-packs" else repo.list_files(a.snapshot, a.format)
        for r in lines.toLocalIterator():
            print(r.line)
    elif a.command == "find":
        table(["SNAPSHOT", "PACK"], [(r.tag, r.pack) for r in repo.find(a.term).toLocalIterator()])
    elif a.command == "show":
        sys.stdout.buffer.write(repo.show(a.snapshot, a.paths))
    elif a.command == "gc":
        done = repo.gc(a.loose_snapshots, a.loose_objects, a.dry_run)
        size = spark.range(1).select(format_size(F.lit(done["bytes"]).cast("long"))).first()[0]
        print(f"{len(done['snapshots'])} snapshots, {done['objects']} objects, {size} freed" + (" (dry run)" if a.dry_run else ""))
    elif a.command == "update":
        for name in repo.update():
            print(f"skipped: {name}", file=sys.stderr)
    elif a.command == "explode":
        repo.explode(a.pack, a.directory)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("snaplake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not a.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    try:
        run(a, spark)
    except LakeError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
