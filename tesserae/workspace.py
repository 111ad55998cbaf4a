"""A checkout and its tables in one place: index it, then ask.

Derived tables (file, blob, unit, signature) can be made again and carry their version in
their folder's name; answers that were paid for (summary) lie apart and are only appended to.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import text
from .functions.hashing import config_key
from .functions.paths import Policy
from .functions.vectors import FLOORS, afford, hash_embed, shortened
from .operators import canonical, caveat, exact, near, search, similar, store, summary
from .sources import ingest

DERIVED, PURCHASED = 2, 1
FILE = "root string, path string, oid string"
BLOB = "oid string, lines int"
SIGNATURE = "norm_hash string, subtree_hash long, nodes int, parent_hash long"
SUMMARY = "norm_hash string, ctx_hash string, prompt string, model string, via string, variant string, level string, json string, created_at long"
VECTOR = "config_key long, text_key string, vec array<float>"
PROMPT = "1"
#: The key of the built-in embedder's vectors, as a signed number.
CONFIG = config_key("hash", "fnv1a") - (1 << 64) if config_key("hash", "fnv1a") >> 63 else config_key("hash", "fnv1a")


class Workspace:
    """The tables of a store folder, seen from one checkout."""

    def __init__(self, spark: SparkSession, store_dir: str, root: str, policy: Policy | None = None) -> None:
        self.spark, self.root, self.store_dir = spark, root.rstrip("/"), store_dir.rstrip("/")
        self.derived, self.purchased = f"{store_dir.rstrip('/')}/derived/v{DERIVED}", f"{store_dir.rstrip('/')}/purchased"
        self.policy = policy or Policy()
        versions = {r["version"] for r in self._read("meta", "version int", self.purchased).collect()}
        if versions and max(versions) > PURCHASED:
            raise RuntimeError(f"the answers in {self.purchased} are of a newer version ({max(versions)})")

    # -- tables
    def _read(self, name: str, schema: str, base: str | None = None) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{base or self.derived}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str, base: str | None = None) -> None:
        df.write.mode("append").parquet(f"{base or self.derived}/{name}")

    def files(self) -> DataFrame:
        return self._read_map().where(F.col("root") == self.root)

    def index(self) -> dict:
        """Make the tables current: parse only blobs that aren't stored; rewrite the file map only if it moved.

        Units and signatures go before their blobs, and a blob that is there means that both are; a run
        that broke off leaves units without a blob, and those oids' rows are read once only.
        """
        found = ingest.read_tree(self.spark, self.root).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._index(found)
        finally:
            found.unpersist()

    def _index(self, found: DataFrame) -> dict:
        blobs = self._read("blob", BLOB).dropDuplicates(["oid"])
        new_units, new_blobs = ingest.ingest(found, blobs)
        parsed = new_blobs.count()
        if parsed:
            fresh = found.join(blobs.select("oid"), "oid", "left_anti").dropDuplicates(["oid"])
            left_over = self._read("unit", ingest.UNIT_SCHEMA).select("oid").distinct()
            self._append(new_units.join(left_over, "oid", "left_anti"), "unit")
            self._append(ingest.signatures(fresh), "signature")
            self._append(new_blobs, "blob")
        now, before = (ingest.fingerprint(f).collect() for f in (found, self.files()))
        changed = [r["map_key"] for r in now] != [r["map_key"] for r in before]
        if changed:
            # a version of the map is a folder of its own, so the last whole one stays readable
            others = self._read_map().where(F.col("root") != self.root)
            version = self._map_version()
            others.unionByName(found.select("root", "path", "oid")).write.mode("overwrite").parquet(f"{self.derived}/file/{version + 1:012d}")
            if version > 1:  # readers that began before keep the version before
                self._drop(f"{self.derived}/file/{version - 1:012d}")
            self._indexed()
        return {"root": self.root, "files": found.count(), "parsed": parsed, "changed": changed}

    def _indexed(self) -> None:
        self._append(self.spark.createDataFrame([(self.root, int(time.time()))], "root string, indexed_at long"), "checkout")

    def _place(self, path: str) -> tuple:
        """A path and its file system, wherever the store lies."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _drop(self, path: str) -> None:
        at, fs = self._place(path)
        fs.delete(at, True)

    def _map_version(self) -> int:
        """The last version of the file map that was written whole; 0 if there is none."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder, fs = self._place(f"{self.derived}/file")
        if not fs.exists(folder):
            return 0
        names = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
        return max((int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(hadoop.Path(p, "_SUCCESS"))), default=0)

    def _read_map(self) -> DataFrame:
        version = self._map_version()
        return self._read(f"file/{version:012d}", FILE) if version else self.spark.createDataFrame([], FILE)

    def stale(self) -> bool:
        """Whether the checkout differs from its stored map."""
        now, before = (ingest.fingerprint(f).collect() for f in (ingest.read_tree(self.spark, self.root), self.files()))
        return [r["map_key"] for r in now] != [r["map_key"] for r in before]

    def units(self, scope: str | None = None) -> DataFrame:
        """Located units, with a number in the order of path and line, and the text each is found by."""
        u = store.located(self.files(), self._read("unit", ingest.UNIT_SCHEMA), root=self.root, scope=scope)
        u = u.withColumn("ctx_hash", F.md5(summary.context(*[F.col(c) for c in ("lang", "owner", "name", "singleton", "via", "params")])))
        said = summary.latest(self.summaries()).select("norm_hash", "ctx_hash", summary.decoded(F.col("json")).alias("summary"))
        u = u.join(said, ["norm_hash", "ctx_hash"], "left")
        t = text.text_of(F.col("summary"), text.identifier_text(F.col("owner"), F.col("name"), F.col("params")))
        return u.withColumn("_t", t).withColumn("text", F.col("_t.text")).withColumn("vec_via", F.col("_t.via")).drop("_t").withColumn("unit", F.concat_ws("\u0001", "path", F.lpad(F.col("line").cast("string"), 9, "0"), "id"))

    def vectors(self) -> DataFrame:
        return self._read("vector", VECTOR)

    def fill(self, units: DataFrame, budget: float | None = 300.0) -> int:
        """Embed and keep the texts of units that have no vector yet; how many. Refused if it would take longer than the budget."""
        wanted = units.where(F.col("text").isNotNull()).withColumn("text_key", F.md5("text"))
        new = store.missing_vectors(wanted, self.vectors(), CONFIG)
        n = new.count()
        afford("hash", n, self.spark.sparkContext.defaultParallelism, budget)
        if n:
            vec = new.withColumn("raw", hash_embed("text")).select(F.lit(CONFIG).alias("config_key"), "text_key", F.transform(shortened(F.col("raw")), lambda x: x.cast("float")).alias("vec"))
            self._append(vec, "vector")
        return n

    def embedded(self, units: DataFrame, budget: float | None = 300.0) -> DataFrame:
        """units with vec and tokens; only texts that were never embedded are."""
        self.fill(units, budget)
        keyed = units.withColumn("text_key", F.md5("text"))
        return store.with_vectors(keyed, self.vectors().dropDuplicates(["config_key", "text_key"]), CONFIG).drop("text_key").withColumn("tokens", text.tokens(text.humanize(F.col("id"))))

    def summaries(self) -> DataFrame:
        return self._read("summary", SUMMARY, self.purchased)

    # -- questions
    def dupes(self, scope: str | None = None, *, min_lines: int = exact.MIN_LINES) -> tuple[DataFrame, DataFrame]:
        """(groups, withheld) of exact duplicates, in report order."""
        found, hidden = exact.groups(self.units(scope), self.policy, scope=scope, min_lines=min_lines)
        return exact.ranked(found), hidden

    def dupes_near(self, scope: str | None = None, *, min_lines: int = exact.MIN_LINES, threshold: float = near.THRESHOLD_F32) -> DataFrame:
        """Near pairs with the first place of each body; what merging saves is the shared nodes."""
        u = exact.candidates(self.units(scope), scope, min_lines)
        sig = self._read("signature", SIGNATURE)
        pairs = near.covered(sig, near.pairs(sig, u.select("norm_hash").distinct(), threshold))
        rep = near.representatives(u.select("norm_hash", "path", "line", "id"))
        for side in ("a", "b"):
            pairs = pairs.join(rep.select(F.col("norm_hash").alias(side), F.col("path").alias(f"path_{side}"), F.col("line").alias(f"line_{side}"), F.col("id").alias(f"id_{side}")), side)
        return pairs.withColumn("similarity", text.round2(F.col("similarity"))).orderBy(F.desc("similarity"), "a", "b")

    def dupes_both(self, scope: str | None = None, *, min_lines: int = exact.MIN_LINES, threshold: float = near.THRESHOLD_F32) -> tuple[DataFrame, DataFrame]:
        """(groups, withheld) of the exact and the near tier as one list in report order."""
        found, hidden = exact.groups(self.units(scope), self.policy, scope=scope, min_lines=min_lines)
        u = exact.candidates(self.units(scope), scope, min_lines)
        sig = self._read("signature", SIGNATURE)
        pairs = near.covered(sig, near.pairs(sig, u.select("norm_hash").distinct(), threshold)).withColumn("similarity", text.round2(F.col("similarity")))
        close, more = exact.near_groups(pairs, u, self.policy)
        return exact.ranked(exact.united(found, close)), exact.merged_withheld(hidden, more)

    def near_stats(self, scope: str | None = None, *, min_lines: int = exact.MIN_LINES) -> DataFrame:
        """How the near tier worked on a scope, with the bodies that it can't compare."""
        u = exact.candidates(self.units(scope), scope, min_lines)
        sig = self._read("signature", SIGNATURE)
        return near.stats(sig, u.select("norm_hash").distinct()).crossJoin(near.uncovered(u, sig))

    def caveats(self, groups: DataFrame, definitions: DataFrame) -> DataFrame:
        """(grp, name): constants that copies of a group may not mean alike; definitions (name, parent) of a finder."""
        m = exact.members(self.units(), groups, min_lines=1).join(self.units().select("path", "line", "owner", "lang"), ["path", "line"])
        m = m.where(F.col("lang") == "ruby").select(F.col("norm_hash").alias("grp"), "path", "line", "end_line", "owner")
        return caveat.caveats(m, ingest.const_reads(ingest.read_tree(self.spark, self.root)), definitions)

    def ages(self, groups: DataFrame) -> DataFrame:
        """(path, line, age) of groups' members: when git says that their oldest line was written; null where it can't."""
        m = exact.members(self.units(), groups, min_lines=1).select("path", "line", "end_line").distinct()
        return caveat.oldest(m, ingest.blamed(self.spark, self.root, m)).select("path", "line", "age")

    def search(self, query: str, scope: str | None = None, *, limit: int = 10, floor: float = FLOORS.get("hash", 0.0)) -> DataFrame:
        """The best units for a query in words."""
        one = self.spark.createDataFrame([(0, query)], "query_id int, q string")
        q = one.withColumn("raw", hash_embed("q")).select("query_id", text.tokens(F.col("q")).alias("tokens"), shortened(F.col("raw")).alias("vec"))
        return search.search(self.embedded(self.units(scope)), q, self.policy, floor=floor, limit=limit).orderBy("rank")

    def similar(self, target: str, scope: str | None = None, *, limit: int = 10) -> DataFrame:
        """Neighbours of a unit, named by id or path:line; an error that suggests ids if it isn't one unit."""
        u = self.units()
        found = similar.resolve(u, target).first()
        if found["status"] != "found":
            close = [r["id"] for r in similar.suggestions(u, target).collect()] if found["status"] == "missing" else []
            raise LookupError(f"{target}: {found['status']}" + (f"; did you mean {', '.join(close)}?" if close else ""))
        e = self.embedded(u)
        at = e.where((F.col("path") == found["path"]) & (F.col("line") == found["line"]))
        within = e if scope is None else e.where(exact.under(F.col("path"), scope))
        return similar.similar(within, self._read("signature", SIGNATURE), at, self.policy, limit=limit).orderBy("rank")

    def canonical(self, groups: DataFrame, ages: DataFrame, references: DataFrame) -> DataFrame:
        """The canonical member of each group; ages (path, line, age), references (id, confirmed, possible)."""
        m = exact.members(self.units(), groups, min_lines=1).join(ages, ["path", "line"], "left").join(references, "id", "left")
        member = F.concat_ws(":", "path", "line")
        return canonical.canonical(m.select(F.col("norm_hash").alias("grp"), member.alias("member"), "age", "confirmed", "possible", canonical.depth(F.col("id")).alias("depth")))

    def originals(self, groups: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """The canonical member of exact groups by git's ages, depth, and a reference counter's JSON answers (id, json) if there are any."""
        told = self.spark.createDataFrame([], "id string, confirmed long, possible long") if answers is None else caveat.references(answers).drop("reason")
        return self.canonical(groups, self.ages(groups), told)

    def status(self) -> DataFrame:
        f = self._read_map()
        return store.status(f.select("root").distinct(), f, self._read("unit", ingest.UNIT_SCHEMA))

    def report(self, path: str | None = None) -> list[dict]:
        """Each checkout that holds a path (all without one): its counts, whether it is stale, and its coverage."""
        at = self._read("checkout", "root string, indexed_at long").groupBy("root").agg(F.max("indexed_at").alias("indexed_at"))
        out = []
        for row in store.holding(self.status(), path).join(at, "root", "left").orderBy("root").toLocalIterator():
            w = Workspace(self.spark, self.store_dir, row["root"], self.policy)
            by = summary.coverage_by_source(w.units(), w.summaries()).orderBy("model", "via").collect()
            out.append(row.asDict() | {"stale": w.stale(), "answerable": w.coverage().first().asDict(), "coverage": [r.asDict() for r in by]})
        return out

    def coverage(self) -> DataFrame:
        return summary.coverage(self.units(), self.summaries())

    def pending(self, limit: int | None = 20, *, model: str | None = None, scope: str | None = None) -> DataFrame:
        """Units that a model has no answer for yet, whatever the way it came; any model without a name."""
        have = self.summaries()
        return summary.pending(self.units(scope), have if model is None else have.where(F.col("model") == model), limit=limit)

    def named(self, name: str) -> DataFrame:
        """The units of a bare name in order."""
        return store.named(self.units(), name).orderBy("path", "line")

    def store_summary(self, unit: str, payload: dict, *, model: str, prompt: str = PROMPT, path: str | None = None) -> None:
        """Keep a contributed summary, if it is exactly one and its unit is one and still there."""
        if prompt != PROMPT:
            raise ValueError(f"prompt {prompt} is not current; {PROMPT} is")
        raw = json.dumps(payload)
        if not self.spark.range(1).select(summary.acceptable(F.lit(raw))).first()[0]:
            raise ValueError("not a summary: six fields, none blank that must not be, known side effects")
        hits = self.units().where((F.col("id") == unit) & (F.lit(path is None) | (F.col("path") == (path or ""))) & F.col("norm_hash").isNotNull()).select("norm_hash", "ctx_hash").distinct().limit(2).collect()
        if len(hits) != 1:
            raise LookupError(f"{unit}: {'ambiguous' if hits else 'no such unit with a body'}")
        if not self._still_there(unit, path, hits[0]["norm_hash"]):
            raise LookupError(f"{unit}: its body has changed since it was indexed")
        row = (hits[0]["norm_hash"], hits[0]["ctx_hash"], prompt, model, "mcp", "body", "unit", raw, int(time.time()))
        if self._read("meta", "version int", self.purchased).count() == 0:
            self._append(self.spark.createDataFrame([(PURCHASED,)], "version int"), "meta", self.purchased)
        self._append(summary.upserted(self.spark.createDataFrame([], SUMMARY), self.spark.createDataFrame([row], SUMMARY)), "summary", self.purchased)

    def _still_there(self, unit: str, path: str | None, norm_hash: str) -> bool:
        """Whether a file that holds the unit, read as it is now, still has a unit of this body."""
        at = self.units().where((F.col("id") == unit) & (F.lit(path is None) | (F.col("path") == (path or ""))) & (F.col("norm_hash") == norm_hash))
        for r in at.select("path").distinct().toLocalIterator():
            file = Path(self.root) / r["path"]
            if file.exists() and any(u["norm_hash"] == norm_hash for u in self.symbols(str(file))):
                return True
        return False

    def sources_of(self, wanted: DataFrame) -> DataFrame:
        """wanted (norm_hash, ctx_hash, path, line) with context and source; source is null if the file no longer holds the body."""
        u = self.units().withColumn("context", summary.context(*[F.col(c) for c in ("lang", "owner", "name", "singleton", "via", "params")]))
        at = wanted.join(u.select("path", "line", "end_line", "norm_hash", "ctx_hash", "context"), ["path", "line", "norm_hash", "ctx_hash"], "left").dropDuplicates(["norm_hash", "ctx_hash"])
        now = ingest.read_tree(self.spark, self.root).join(self.files().select("path", F.col("oid").alias("was")), "path").where(F.col("oid") == F.col("was"))
        body = F.split(F.decode("content", "UTF-8"), "\n")
        lines = F.array_join(F.slice(body, F.col("line"), F.col("end_line") + 1 - F.col("line")), "\n")
        return at.join(now.select("path", "content"), "path", "left").withColumn("source", lines).drop("content")

    def summarize(self, ask: Callable[[str, str], str | None], *, model: str, budget: int | None = None, scope: str | None = None, batch: int = 50) -> dict:
        """Buy summaries for what has none of this model, first places first, `budget` answers at most.

        Answers are kept after each batch, so what is paid for survives a stop.  Units whose file
        has moved on, or whose answer isn't a summary, count as failed and stay pending.
        """
        wanted = summary.pending(self.units(scope), summary.bought(self.summaries(), PROMPT, model, "api"), limit=None)
        place = F.struct("path", "line", "norm_hash", "ctx_hash")
        counts = {"summarized": 0, "shared": 0, "failed": 0, "remaining": wanted.count()}
        if self._read("meta", "version int", self.purchased).count() == 0:
            self._append(self.spark.createDataFrame([(PURCHASED,)], "version int"), "meta", self.purchased)
        left = wanted
        while budget is None or budget > 0:
            part = summary.in_fill_order(left, batch if budget is None else min(batch, budget)).collect()
            if not part:
                break
            asked = self.spark.createDataFrame(part, wanted.schema)
            rows = summary.filled(self.sources_of(asked).where(F.col("source").isNotNull()), ask, prompt=PROMPT, model=model, now=int(time.time())).collect()
            if rows:
                self._append(self.spark.createDataFrame(rows, SUMMARY), "summary", self.purchased)
            got = {(r["norm_hash"], r["ctx_hash"]) for r in rows}
            counts["summarized"] += len(got)
            counts["shared"] += sum(r["units"] - 1 for r in part if (r["norm_hash"], r["ctx_hash"]) in got)
            counts["failed"] += len(part) - len(got)
            counts["remaining"] -= len(got)
            end = part[-1]
            left = wanted.where(place > F.struct(F.lit(end["path"]), F.lit(end["line"]), F.lit(end["norm_hash"]), F.lit(end["ctx_hash"])))
            budget = None if budget is None else budget - len(part)
        return counts

    @staticmethod
    def symbols(path: str) -> list[dict]:
        """The units of one file as it is now."""
        return ingest.outline(path, Path(path).read_text(errors="replace"))


def policy_of(root: str, include_ignored: bool = False) -> Policy:
    """The path policy in a checkout's tesserae.toml, or the conventions."""
    f = Path(root) / "tesserae.toml"
    return Policy.parse(f.read_text(), include_ignored) if f.exists() else Policy(include_ignored=include_ignored)


