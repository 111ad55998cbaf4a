"""A tool server on standard input and output: JSON-RPC 2.0, one message a line.

Calls run side by side in a few threads; a cancelled call's Spark jobs are interrupted by its tag.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Lock
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession

from .sources import sinks
from .workspace import PROMPT, Workspace, policy_of

#: Fixed values of the protocol: its version and its error codes.
PROTOCOL = "2025-06-18"
PARSE_ERROR, NO_METHOD = -32700, -32601
#: Calls that run at once.
WORKERS = 4

Tool = Callable[["Server", dict], Any]
TOOLS: dict[str, tuple[Tool, dict]] = {}

TEXT, WHOLE, REAL, FLAG, OBJECT = ({"type": t} for t in ("string", "integer", "number", "boolean", "object"))


def tool(about: str, needs: tuple[str, ...] = (), writes: bool = False, **fields: dict) -> Callable[[Tool], Tool]:
    """Register a tool under the name of its function."""

    def put(f: Tool) -> Tool:
        schema = {"type": "object", "properties": fields, "required": list(needs)}
        TOOLS[f.__name__] = (f, {"name": f.__name__, "description": about, "inputSchema": schema, "annotations": {"idempotentHint": True} | {"readOnlyHint": not writes}})
        return f

    return put


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in sinks.ndjson(df)]


class Server:
    """Answers messages about the checkouts of one store."""

    def __init__(self, spark: SparkSession, store: str, root: str) -> None:
        self.spark, self.store, self.root = spark, store, root
        self.indexing = Lock()

    def fresh(self, args: dict) -> Workspace:
        """The checkout that a call is about, indexed as it is now; one call indexes at a time."""
        root = str(Path(args.get("path") or self.root).resolve(strict=True))
        w = Workspace(self.spark, self.store, root, policy_of(root, bool(args.get("include_ignored"))))
        with self.indexing:
            w.index()
        return w

    def answer(self, line: str) -> str | None:
        """The response to a line; None for a notification."""
        try:
            message = json.loads(line)
        except ValueError as e:
            return _wrapped(None, error={"code": PARSE_ERROR, "message": f"not JSON: {e}"})
        if not isinstance(message, dict) or message.get("id") is None:
            return None
        key, method, params = message["id"], message.get("method"), message.get("params") or {}
        if method == "initialize":
            return _wrapped(key, {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tesserae", "version": "1"}})
        if method == "ping":
            return _wrapped(key, {})
        if method == "tools/list":
            return _wrapped(key, {"tools": [about for _, about in TOOLS.values()]})
        if method != "tools/call":
            return _wrapped(key, error={"code": NO_METHOD, "message": f"no method {method!r}"})
        return _wrapped(key, self.called(params, str(key)))

    def called(self, params: dict, key: str) -> dict:
        """A tool's result.  What goes wrong in a tool is a result that says so, for the caller to read."""
        name, args = params.get("name"), params.get("arguments") or {}
        self.spark.addTag(tag(key))
        try:
            if name not in TOOLS:
                raise LookupError(f"no tool {name!r}; there are {', '.join(TOOLS)}")
            run, about = TOOLS[name]
            absent = [k for k in about["inputSchema"]["required"] if k not in args]
            if absent:
                raise ValueError(f"{name} needs {', '.join(absent)}")
            return {"content": [{"type": "text", "text": json.dumps(run(self, args), indent=2, ensure_ascii=False)}]}
        except Exception as e:  # noqa: BLE001 - whatever a tool raises is its answer
            return {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}]}
        finally:
            self.spark.removeTag(tag(key))

    def serve(self, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Answer until the input ends."""
        writing = Lock()

        def one(line: str) -> None:
            said = self.answer(line)
            if said is not None:
                with writing:
                    out.write(said + "\n")
                    out.flush()

        with ThreadPoolExecutor(WORKERS) as pool:
            for line in lines:
                if not line.strip():
                    continue
                gone = cancelled(line)
                if gone is not None:
                    self.spark.interruptTag(tag(gone))
                else:
                    pool.submit(one, line)


def tag(key: str) -> str:
    """A job tag for a message; tags hold no commas."""
    return "mcp-" + key.encode().hex()


def cancelled(line: str) -> str | None:
    """The call that a line cancels."""
    try:
        m = json.loads(line)
    except ValueError:
        return None
    if not isinstance(m, dict) or m.get("method") != "notifications/cancelled":
        return None
    key = (m.get("params") or {}).get("requestId")
    return None if key is None else str(key)


def _wrapped(key: Any, result: dict | None = None, error: dict | None = None) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": key} | ({"error": error} if error else {"result": result}))


@tool("Units found by what they do: names and meaning ranked together. `coverage` says how much of the code has a summary; without any, names alone were searched.", ("query",), query=TEXT, path=TEXT, scope=TEXT, limit=WHOLE, floor=REAL, include_ignored=FLAG)
def search(server: Server, args: dict) -> dict:
    w = server.fresh(args)
    found = w.search(args["query"], args.get("scope"), limit=args.get("limit", 10), floor=args.get("floor", 0.0))
    return {"hits": rows(found.select("rank", "unit", "path", "line", "class", "how", "score")), "coverage": w.coverage().first().asDict()}


@tool("Units like one unit, named by its id or by path:line, each with the tier that found it.", ("unit",), unit=TEXT, path=TEXT, scope=TEXT, limit=WHOLE, include_ignored=FLAG)
def similar(server: Server, args: dict) -> dict:
    return {"neighbours": rows(server.fresh(args).similar(args["unit"], args.get("scope"), limit=args.get("limit", 10)).drop("unit"))}


@tool("Groups of units with equal bodies, and with `near` also nearly equal ones, by what merging would save; `withheld` counts what path policy hides. With `canonical`, who of each exact group is likely the original.", path=TEXT, scope=TEXT, min_lines=WHOLE, near=FLAG, near_threshold=REAL, canonical=FLAG, include_ignored=FLAG)
def dupes(server: Server, args: dict) -> dict:
    w = server.fresh(args)
    lines = args.get("min_lines", 4)
    both = w.dupes_both(args.get("scope"), min_lines=lines, threshold=args.get("near_threshold", 0.7)) if args.get("near") else w.dupes(args.get("scope"), min_lines=lines)
    out = {"groups": rows(both[0]), "withheld": rows(both[1])}
    if args.get("near"):
        out["near"] = w.near_stats(args.get("scope"), min_lines=lines).first().asDict()
    if args.get("canonical"):
        out["canonical"] = rows(w.originals(w.dupes(args.get("scope"), min_lines=lines)[0]))
    return out


@tool("The units of one file in order, read as it is now; needs no index.", ("file",), file=TEXT)
def symbols(server: Server, args: dict) -> list:
    return Workspace.symbols(args["file"])


@tool("What is indexed of each checkout (of the one that holds `path`, if given), whether it is stale, and how much of it has summaries.", path=TEXT)
def status(server: Server, args: dict) -> dict:
    at = str(Path(args["path"]).resolve()) if args.get("path") else None
    return {"checkouts": Workspace(server.spark, server.store, server.root).report(at)}


@tool("Units that this model has not summarised, first places first, each once, with source and context.", ("model",), model=TEXT, path=TEXT, scope=TEXT, limit=WHOLE)
def pending(server: Server, args: dict) -> dict:
    w = server.fresh(args)
    return {"prompt_version": PROMPT, "pending": rows(w.sources_of(w.pending(args.get("limit", 20), model=args["model"], scope=args.get("scope"))).orderBy("path", "line"))}


@tool("Keep a summary of one unit. It is refused unless it has exactly the six fields and the unit's body is still the one indexed.", ("unit", "model", "prompt_version", "summary"), True, unit=TEXT, path=TEXT, root=TEXT, model=TEXT, prompt_version=TEXT, summary=OBJECT)
def store_summary(server: Server, args: dict) -> dict:
    w = server.fresh({"path": args.get("root")})
    w.store_summary(args["unit"], args["summary"], model=args["model"], prompt=args["prompt_version"], path=args.get("path"))
    return {"stored": args["unit"]}


@tool("Make the tables of a checkout current; what is known isn't parsed again.", (), True, path=TEXT)
def index(server: Server, args: dict) -> dict:
    root = str(Path(args.get("path") or server.root).resolve(strict=True))
    with server.indexing:
        return Workspace(server.spark, server.store, root, policy_of(root)).index()
