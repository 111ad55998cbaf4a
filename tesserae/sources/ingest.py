"""Files to tables: listing, content addresses, and parsing only what isn't known."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import blob_oid, map_key
from ..functions.paths import EXTENSIONS, RUBY_NAMES, language
from ..operators.store import to_parse
from .extract import ruby, rust

PARAM = pa.struct([("kind", pa.string()), ("name", pa.string())])
UNIT = pa.schema([("oid", pa.string()), ("lang", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("singleton", pa.bool_()), ("visibility", pa.string()), ("params", pa.list_(PARAM)), ("via", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("norm_hash", pa.string()), ("nodes", pa.int32())])
UNIT_SCHEMA = "oid string, lang string, name string, owner string, singleton boolean, visibility string, params array<struct<kind:string,name:string>>, via string, line int, end_line int, norm_hash string, nodes int"


def tracked(listing: Column) -> Column:
    """The entries of a `git ls-files -s -z` listing: (path, oid) of plain files of a known language."""
    each = F.filter(F.split(listing, "\0"), lambda e: e.rlike(r"^100(644|755) [0-9a-f]{40} 0\t"))
    both = F.transform(each, lambda e: F.struct(F.regexp_extract(e, r"(?s)^[^\t]*\t(.*)$", 1).alias("path"), F.regexp_extract(e, r"^\d+ ([0-9a-f]{40})", 1).alias("oid")))
    return F.filter(both, lambda f: language(f["path"]).isNotNull())


def path_list(listing: Column) -> Column:
    """The entries of a NUL-separated list of paths."""
    return F.filter(F.split(listing, "\0"), lambda p: p != "")


def overlaid(base: DataFrame, dirty: DataFrame) -> DataFrame:
    """(path, oid): the base, with dirty (path, oid) files in place; dirty files without oid are gone."""
    return base.join(dirty, "path", "left_anti").unionByName(dirty.where(F.col("oid").isNotNull()).select(*base.columns))


def git_root(path: str) -> str | None:
    """The top folder of the git checkout that a path is in; None if it is in none."""
    got = subprocess.run(["git", "-C", path, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return got.stdout.strip() or None if got.returncode == 0 else None


def listed(root: str) -> list[str] | None:
    """The paths that git tracks below a folder and the untracked ones it doesn't ignore; None outside of git.

    What is read of them is the working tree, so edits that aren't committed count and files
    that are gone don't.
    """
    if git_root(root) is None:
        return None
    got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    if got.returncode:
        raise OSError(got.stderr.decode(errors="replace").strip())
    return sorted({p for p in got.stdout.decode("utf-8", "surrogateescape").split("\0") if p})


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(root, path, oid, lang, content) of the files below a folder whose language is known.

    In a git checkout those that `listed` names, else all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.expr("path")
    base = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(at, r"^file:/+", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = files.select(F.lit(base).alias("root"), rel.alias("path"), "content").withColumn("lang", language(F.col("path"))).where(F.col("lang").isNotNull())
    names = listed(root)
    if names is not None:
        rows = rows.join(spark.createDataFrame([(n,) for n in names], "path string"), "path", "left_semi")
    return rows.withColumn("oid", blob_oid(F.col("content"))).select("root", "path", "oid", "lang", "content")


def author_times(porcelain: str) -> list[tuple[int, int]]:
    """(line, author time) of the lines in a `git blame --porcelain` answer; a commit tells its time once."""
    times: dict[str, int] = {}
    at: list[tuple[int, str]] = []
    for row in porcelain.split("\n"):
        if row.startswith("\t") or not row:
            continue
        head = row.split(" ")
        if head[0] == "author-time":
            times[at[-1][1]] = int(head[1])
        elif len(head[0]) in (40, 64) and len(head) >= 3 and head[1].isdigit() and head[2].isdigit():
            at.append((int(head[2]), head[0]))
    return [(line, times[commit]) for line, commit in at if commit in times]


def blamed(spark: SparkSession, root: str, spans: DataFrame) -> DataFrame:
    """(path, at, time): when each line of spans' files was written, as git tells on the driver, where the checkout is.

    One question a file.  A file that git can't answer for has no rows, which is "not measured".
    """
    rows: list[tuple[str, int, int]] = []
    if git_root(root) is not None:
        for r in spans.select("path").distinct().orderBy("path").toLocalIterator():
            got = subprocess.run(["git", "-C", root, "blame", "--porcelain", "--", r["path"]], capture_output=True)
            if got.returncode == 0:
                rows += [(r["path"], line, t) for line, t in author_times(got.stdout.decode("utf-8", "replace"))]
    return spark.createDataFrame(rows, "path string, at int, time long")


def fingerprint(files: DataFrame) -> DataFrame:
    """(root, map_key): equal when a checkout's files are, whatever their order."""
    return files.groupBy("root").agg(map_key(F.col("path"), F.col("oid")).alias("map_key"))


def parsed(lang: str, src: str) -> tuple[list[dict], dict[str, list[tuple[int, int, int]]]]:
    """(units, signatures) of a source; Rust has no signatures."""
    if lang == "ruby":
        return ruby.units(src)[:2]
    return (rust.units(src)[0], {}) if lang == "rust" else ([], {})


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    for batch in batches:
        rows = []
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for body, shapes in parsed(lang, (raw or b"").decode("utf-8", "replace"))[1].items():
                rows += [{"norm_hash": body, "subtree_hash": signed(h), "nodes": n, "parent_hash": signed(p) if p else None} for h, n, p in shapes]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("norm_hash", pa.string()), ("subtree_hash", pa.int64()), ("nodes", pa.int32()), ("parent_hash", pa.int64())]))


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, lang, raw in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "content")), strict=True):
            if lang == "ruby":
                rows += [{"path": path, "name": r["name"], "nesting": r["nesting"], "at": r["line"]} for r in ruby.const_reads((raw or b"").decode("utf-8", "replace"))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("nesting", pa.string()), ("at", pa.int32())]))


def signatures(blobs: DataFrame) -> DataFrame:
    """The shapes of each body of blobs (lang, content), once for each body."""
    rows = blobs.select("lang", "content").mapInArrow(_signatures, "norm_hash string, subtree_hash long, nodes int, parent_hash long")
    return rows.dropDuplicates(["norm_hash", "subtree_hash"])


def const_reads(files: DataFrame) -> DataFrame:
    """(path, name, nesting, at): the constants that Ruby files (path, lang, content) read."""
    return files.select("path", "lang", "content").mapInArrow(_reads, "path string, name string, nesting string, at int")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for oid, lang, raw in zip(*(batch.column(c).to_pylist() for c in ("oid", "lang", "content")), strict=True):
            found = parsed(lang, (raw or b"").decode("utf-8", "replace"))[0]
            rows += [{"oid": oid} | u for u in found]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=UNIT)


def extract(blobs: DataFrame) -> DataFrame:
    """The units of blobs (oid, lang, content), each parsed by itself."""
    return blobs.select("oid", "lang", "content").mapInArrow(_extract, UNIT_SCHEMA)


def ingest(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, blobs) to append for files (path, oid, lang, content): one path for each blob that isn't known."""
    new = to_parse(files.select("oid", "path"), known)
    blobs = files.join(new, ["oid", "path"], "left_semi").dropDuplicates(["oid"])
    return extract(blobs), blobs.select("oid", (F.size(F.split(F.decode("content", "UTF-8"), "\n"))).alias("lines"))


def outline(path: str, src: str) -> list[dict]:
    """The units of one file, without tables."""
    name = Path(path).name
    lang = "rust" if name.endswith(".rs") else "ruby" if name in RUBY_NAMES or Path(name).suffix[1:] in EXTENSIONS["ruby"] else ""
    return parsed(lang, src)[0]
