"""Command line: index, embed, summarize, dupes, search, similar, symbols, status, pending, store-summary, eval, mcp.

Exit codes: 0 for an answer, 1 for none, 2 for an error.  TESSERAE_STORE, TESSERAE_FLOOR and
TESSERAE_EMBED_BUDGET (seconds, 0 for no limit) stand for options that aren't given.
"""

from __future__ import annotations

import argparse
import json
import os
import shlex
import subprocess
import sys
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from .operators import exact
from .phases import Phases
from .sources import sinks

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .workspace import Workspace


def fraction(value: str) -> float:
    x = float(value)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1")
    return x


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae", description=__doc__)
    p.add_argument("--store", default=os.environ.get("TESSERAE_STORE") or str(Path.home() / ".tesserae"))
    p.add_argument("--root", default=".")
    p.add_argument("--ndjson", action="store_true")
    p.add_argument("--profile", action="store_true", help="where the time went, on standard error")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("index")
    sub.add_parser("status")
    d = sub.add_parser("dupes", aliases=["duplicates"])
    d.add_argument("scope", nargs="?")
    d.add_argument("--min-lines", type=int, default=4)
    d.add_argument("--near", action="store_true")
    d.add_argument("--threshold", type=fraction, default=0.7)
    d.add_argument("--canonical", action="store_true")
    d.add_argument("--include-ignored", action="store_true")
    e = sub.add_parser("embed")
    e.add_argument("scope", nargs="?")
    e.add_argument("--budget", type=float, default=float(os.environ.get("TESSERAE_EMBED_BUDGET") or "0"), help="seconds; 0 is no limit")
    z = sub.add_parser("summarize")
    z.add_argument("scope", nargs="?")
    z.add_argument("--model", required=True)
    z.add_argument("--budget", type=int, default=None, help="answers; none is no limit")
    z.add_argument("--command", required=True, help="asked for each unit: context and source as JSON on its input, a summary on its output")
    v = sub.add_parser("eval")
    v.add_argument("labels", help="a folder with queries.tsv, pairs.tsv, canonical.tsv, similar.tsv; what is absent isn't scored")
    v.add_argument("--min-lines", type=int, default=4)
    sub.add_parser("mcp")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("scope", nargs="?")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--floor", type=fraction, default=fraction(os.environ.get("TESSERAE_FLOOR") or "0"))
    m = sub.add_parser("similar")
    m.add_argument("unit")
    m.add_argument("scope", nargs="?")
    m.add_argument("--limit", type=int, default=10)
    sub.add_parser("symbols").add_argument("file")
    sub.add_parser("pending").add_argument("--limit", type=int, default=20)
    c = sub.add_parser("store-summary")
    c.add_argument("unit")
    c.add_argument("file", help="a JSON file; - for standard input")
    c.add_argument("--model", required=True)
    return p


def duplicates(w: Workspace, args: argparse.Namespace) -> DataFrame:
    """Groups of the exact tier, of both with --near, and with the canonical member of each exact one."""
    found = w.dupes_both(args.scope, min_lines=args.min_lines, threshold=args.threshold)[0] if args.near else w.dupes(args.scope, min_lines=args.min_lines)[0]
    if not args.canonical:
        return found
    picks = w.originals(w.dupes(args.scope, min_lines=args.min_lines)[0])
    return exact.ranked(found.join(picks.withColumnRenamed("grp", "norm_hash"), "norm_hash", "left"))


def command(line: str) -> Callable[[str, str], str | None]:
    """A source of summaries that is a program; None from it if the program fails."""

    def ask(context: str, source: str) -> str | None:
        got = subprocess.run(shlex.split(line), input=json.dumps({"context": context, "source": source}), capture_output=True, text=True)
        return got.stdout if got.returncode == 0 else None

    return ask


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "symbols":
        from .workspace import Workspace

        found = Workspace.symbols(args.file)
        print(json.dumps(found, indent=2))
        return sinks.HIT if found else sinks.MISS
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tesserae").getOrCreate()
    from .workspace import Workspace, policy_of

    try:
        root = str(Path(args.root).resolve(strict=True))
        w = Workspace(spark, args.store, root, policy_of(root, getattr(args, "include_ignored", False)))
        if args.verb == "mcp":
            from .mcp import Server

            Server(spark, args.store, root).serve()
            return sinks.HIT
        phases = Phases()
        with phases("index"):
            state = w.index()
        if args.verb == "index":
            print(json.dumps(state))
            return sinks.HIT
        if args.verb == "embed":
            print(json.dumps({"embedded": w.fill(w.units(args.scope), args.budget)}))
            return sinks.HIT
        if args.verb == "summarize":
            print(json.dumps(w.summarize(command(args.command), model=args.model, budget=args.budget, scope=args.scope)))
            return sinks.HIT
        if args.verb == "eval":
            from .scoring import score

            print(json.dumps(score(w, args.labels, args.min_lines), indent=2))
            return sinks.HIT
        if args.verb == "status":
            print(json.dumps(w.report(), indent=2))
            return sinks.HIT
        if args.verb == "store-summary":
            w.store_summary(args.unit, json.loads(sys.stdin.read() if args.file == "-" else Path(args.file).read_text()), model=args.model)
            return sinks.HIT
        df = {
            "search": lambda: w.search(args.query, args.scope, limit=args.limit, floor=args.floor).select("rank", "unit", "path", "line", "class", "how", "score"),
            "similar": lambda: w.similar(args.unit, args.scope, limit=args.limit).drop("unit"),
            "pending": lambda: w.pending(args.limit),
        }.get(args.verb, lambda: duplicates(w, args))()
        n = 0
        begun = phases.clock()
        for n, row in enumerate(sinks.ndjson(df), 1):  # noqa: B007 - streamed, so no list of answers is held
            print(row if args.ndjson else json.dumps(json.loads(row), indent=2, ensure_ascii=False))
        phases.add("answer", phases.clock() - begun)
        if args.profile:
            print(json.dumps(phases.report()), file=sys.stderr)
        return sinks.HIT if n else sinks.MISS
    except (LookupError, ValueError, OSError, RuntimeError) as e:
        print(f"tesserae: {e}", file=sys.stderr)
        return sinks.ERROR


if __name__ == "__main__":
    sys.exit(main())
