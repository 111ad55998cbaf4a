"""Queries over documents as units of content: duplicates, near duplicates, neighbours, status, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import blob_oid
from ..functions.paths import Policy
from ..functions.text import let, round4, tokens
from ..operators import evaluate, exact, near, similar, store, summary
from .registry import query, table

#: Sources stand for directories; some have a class of their own.
POLICY = Policy({"src1": "test", "src2": "vendored", "src3": "generated"})
MIN_LINES = 1

UNITS = r"""
tok AS (SELECT doc_id, lang, source, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS tokens FROM documents),
units AS (SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, 1 AS line, len(string_split(coalesce(text, ''), chr(10))) AS end_line, lang, source AS owner, CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN len(tokens) > 0 THEN substr(md5(lang || ':' || array_to_string(tokens, ' ')), 1, 16) END AS norm_hash, len(tokens) AS nodes, tokens FROM tok),
classed AS (SELECT *, CASE split_part(path, '/', 1) WHEN 'src1' THEN 'test' WHEN 'src2' THEN 'vendored' WHEN 'src3' THEN 'generated' ELSE 'app' END AS class FROM units),
cand AS (SELECT * FROM classed WHERE norm_hash IS NOT NULL)
"""
GROUPS = r"""
heads AS (SELECT norm_hash, count(*) AS copies, min({'path': path, 'line': line, 'lang': lang, 'lines': end_line, 'nodes': nodes, 'class': class}) AS h, min(class) AS lo, max(class) AS hi, bool_or(class NOT IN ('vendored', 'generated', 'migration')) AS shown FROM cand GROUP BY norm_hash HAVING count(*) >= 2)
"""
SHAPES = r"""
sig AS (SELECT DISTINCT norm_hash, unnest(CASE WHEN len(tokens) >= 5 THEN list_transform(range(1, len(tokens) - 3), lambda i: array_to_string(tokens[i:i+4], ' ')) ELSE [] END) AS shape FROM cand),
size AS (SELECT norm_hash, count(*) AS shapes FROM sig GROUP BY norm_hash),
df AS (SELECT shape, count(*) AS df FROM sig GROUP BY shape)
"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units: one for each, named by source and id."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", "source", "text", tokens(F.col("text")).alias("tokens"))
    return rows.select(
        "doc_id", F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.lit(1).alias("line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("end_line"), "lang", F.col("source").alias("owner"), F.col("doc_id").cast("string").alias("id"),
        F.when(F.size("tokens") > 0, F.substring(F.md5(F.concat(F.col("lang"), F.lit(":"), F.array_join("tokens", " "))), 1, 16)).alias("norm_hash"), F.size("tokens").alias("nodes"), "tokens",
    )


def shape_sets(rows: DataFrame, size: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(norm_hash, shapes): the hashes of the runs of `size` tokens of each row with a body; copies repeat."""
    bodies = rows.where(F.col("norm_hash").isNotNull()).select("norm_hash", "tokens", *keep)
    run = lambda t: F.when(F.size(t) >= size, F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: F.xxhash64(*[t[i + k] for k in range(size)]))).otherwise(F.array().cast("array<long>"))
    return bodies.select("norm_hash", *keep, F.array_distinct(let(F.col("tokens"), run)).alias("shapes"))


def signatures(rows: DataFrame, size: int = 5) -> DataFrame:
    """Flat signatures: the hash of each run of `size` tokens of a body."""
    return shape_sets(rows, size).select("norm_hash", F.explode("shapes").alias("subtree_hash"))


def bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(norm_hash, owner, tokens) of documents with a body, copies repeated, and about how many shapes they have, by the characters read."""
    u = units(spark, sf_dir).where(F.col("norm_hash").isNotNull() & (F.col("end_line") >= MIN_LINES))
    chars = table(spark, sf_dir, "documents").agg(F.sum(F.char_length("text"))).first()[0] or 0
    return u.select("norm_hash", "owner", "tokens"), chars // 6


@query("dupes_exact", f"WITH {UNITS}, {GROUPS} SELECT norm_hash, h.lang, copies, h.lines AS lines, h.nodes AS nodes, h.nodes * (copies - 1) AS saves_nodes, CASE WHEN lo = hi THEN lo ELSE 'mixed' END AS population, h.path AS path, h.line AS line FROM heads WHERE shown")
def dupes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.ranked(exact.groups(units(spark, sf_dir), POLICY, min_lines=MIN_LINES)[0])


@query("dupes_exact_withheld", f"WITH {UNITS}, {GROUPS} SELECT h.class AS class, count(*) AS n FROM heads WHERE NOT shown GROUP BY 1")
def dupes_exact_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(units(spark, sf_dir), POLICY, min_lines=MIN_LINES)[1]


@query("dupes_exact_members", f"WITH {UNITS}, {GROUPS} SELECT norm_hash, c.path, c.line, c.end_line, c.id FROM cand c JOIN heads USING (norm_hash) WHERE shown")
def dupes_exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    return exact.members(u, exact.groups(u, POLICY, min_lines=MIN_LINES)[0], min_lines=MIN_LINES)


PAIRS = r"""
post AS (SELECT norm_hash, shape FROM sig JOIN df USING (shape) WHERE df BETWEEN 2 AND 64),
shared AS (SELECT a.norm_hash AS a, b.norm_hash AS b, count(*) AS shared FROM post a JOIN post b ON a.shape = b.shape AND a.norm_hash < b.norm_hash GROUP BY ALL),
sized AS (SELECT a, b, shared, x.shapes AS shapes_a, y.shapes AS shapes_b, shared / CAST(greatest(x.shapes + y.shapes - shared, 1) AS DOUBLE) AS similarity FROM shared JOIN size x ON x.norm_hash = a JOIN size y ON y.norm_hash = b)
"""


@query("dupes_near", f"WITH {UNITS}, {SHAPES}, {PAIRS} SELECT a, b, shared, shapes_a, shapes_b, floor(similarity * 10000 + 0.5) / 10000 AS similarity FROM sized WHERE similarity >= {near.THRESHOLD_F32}")
def dupes_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark, sf_dir).withColumn("similarity", round4(F.col("similarity")))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, rows = bodies(spark, sf_dir)
    return near.pairs_of_sets(shape_sets(b), rows, hexed=True)


@query("near_stats", f"WITH {UNITS}, {SHAPES}, {PAIRS} SELECT (SELECT count(DISTINCT norm_hash) FROM cand) AS bodies, (SELECT count(*) FROM df) AS shapes, (SELECT count(*) FROM df WHERE df > 64) AS dropped_common, (SELECT count(*) FROM shared) AS candidates, (SELECT count(DISTINCT norm_hash) * (count(DISTINCT norm_hash) - 1) // 2 FROM cand) AS exhaustive")
def near_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, rows = bodies(spark, sf_dir)
    return near.stats_of_sets(shape_sets(b), rows, b, hexed=True)


@query("near_neighbors", f"WITH {UNITS}, {SHAPES}, t AS (SELECT DISTINCT norm_hash FROM cand WHERE owner = 'src4'), s AS (SELECT x.norm_hash AS target, y.norm_hash, count(*) AS shared FROM sig x JOIN t ON t.norm_hash = x.norm_hash JOIN sig y ON y.shape = x.shape AND y.norm_hash <> x.norm_hash GROUP BY ALL), j AS (SELECT target, s.norm_hash, shared, shared / CAST(greatest(p.shapes + q.shapes - shared, 1) AS DOUBLE) AS similarity FROM s JOIN size p ON p.norm_hash = target JOIN size q ON q.norm_hash = s.norm_hash) SELECT target, norm_hash, shared, floor(similarity * 10000 + 0.5) / 10000 AS similarity FROM j WHERE similarity >= 0.25")
def near_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies near those of one source, whatever their own; common shapes count here."""
    b, rows = bodies(spark, sf_dir)
    sets = shape_sets(b.withColumn("wanted", F.coalesce(F.col("owner") == "src4", F.lit(False))), keep=("wanted",))
    return near.neighbors_of_sets(sets, rows, 0.25, hexed=True).withColumn("similarity", round4(F.col("similarity")))


@query("blob_oids", "SELECT doc_id, sha1('blob ' || CAST(strlen(coalesce(text, '')) AS VARCHAR) || chr(0) || coalesce(text, '')) AS oid FROM documents")
def blob_oids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", blob_oid(F.coalesce("text", F.lit(""))).alias("oid"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("root"), F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), blob_oid(F.coalesce("text", F.lit(""))).alias("oid"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))


FILES = "files AS (SELECT source AS root, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha1('blob ' || CAST(strlen(coalesce(text, '')) AS VARCHAR) || chr(0) || coalesce(text, '')) AS oid, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents)"


@query("status", f"WITH {FILES} SELECT root, count(path) AS files, count(DISTINCT oid) AS blobs, CAST(sum(lines) AS BIGINT) AS units FROM files GROUP BY root")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each source, its lines standing for units."""
    f = _files(spark, sf_dir)
    return store.status_of_counts(f.select("root").distinct(), f, f.groupBy("oid").agg(F.max("lines").alias("n")))


@query("index_plan", f"WITH {FILES}, known AS (SELECT DISTINCT oid FROM files WHERE root IN ('src0', 'src1')) SELECT oid, min(path) AS path FROM files WHERE oid NOT IN (SELECT oid FROM known) GROUP BY oid")
def index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to parse once two sources are known: one path for each blob."""
    f = _files(spark, sf_dir)
    return store.to_parse(f, f.where(F.col("root").isin("src0", "src1")).select("oid").distinct())


@query("token_counts", r"SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query("distinct_texts", "SELECT md5(text) AS text_key, text, min(doc_id) AS first FROM documents WHERE trim(text) <> '' GROUP BY text")
def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "text", F.col("doc_id").alias("unit"))
    return store.distinct_texts(d)


@query("coverage", f"WITH {UNITS} SELECT count(*) AS summarizable, count(l.doc_id) AS summarized, CASE WHEN count(l.doc_id) = 0 THEN 'none' WHEN count(l.doc_id) < count(*) THEN 'warming' ELSE 'complete' END AS state FROM cand LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a label, labels standing for bought answers."""
    u = units(spark, sf_dir).select("norm_hash", F.col("doc_id").alias("ctx_hash"))
    answered = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ctx_hash")).distinct().join(u, "ctx_hash")
    return summary.coverage(u, answered)


@query("pending", f"WITH {UNITS}, g AS (SELECT norm_hash, min({{'path': path, 'line': line}}) AS f, count(*) AS units FROM cand GROUP BY norm_hash), done AS (SELECT DISTINCT norm_hash FROM cand JOIN labels USING (doc_id)) SELECT norm_hash, f.path AS path, units FROM g WHERE norm_hash NOT IN (SELECT norm_hash FROM done) ORDER BY f.path LIMIT 20")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 distinct texts of which no copy has a label."""
    u = units(spark, sf_dir).withColumn("ctx_hash", F.lit(0))
    done = u.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return summary.pending(u, done, limit=20).select("norm_hash", "path", "units")


TARGET = "t AS (SELECT doc_id, path, norm_hash FROM cand WHERE class NOT IN ('vendored', 'generated') AND norm_hash IN (SELECT norm_hash FROM cand GROUP BY norm_hash HAVING count(*) > 1) ORDER BY path LIMIT 1)"
COSINE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


@query(
    "similar",
    f"""WITH {UNITS}, {SHAPES}, {TARGET}, o AS (SELECT c.* FROM cand c, t WHERE c.path <> t.path AND class NOT IN ('vendored', 'generated')),
ex AS (SELECT 0 AS tier, o.doc_id AS unit, o.path, 1.0 AS s FROM o, t WHERE o.norm_hash = t.norm_hash),
sh AS (SELECT y.norm_hash, count(*) AS shared FROM sig x JOIN t USING (norm_hash) JOIN sig y ON y.shape = x.shape AND y.norm_hash <> x.norm_hash GROUP BY ALL),
nj AS (SELECT sh.norm_hash, shared / CAST(greatest(p.shapes + q.shapes - shared, 1) AS DOUBLE) AS s FROM sh JOIN size p ON p.norm_hash = sh.norm_hash, t JOIN size q ON q.norm_hash = t.norm_hash),
ne AS (SELECT 1 AS tier, o.doc_id AS unit, o.path, s FROM o JOIN nj USING (norm_hash) WHERE s >= {near.THRESHOLD_F32}),
me AS (SELECT 2 AS tier, o.doc_id AS unit, o.path, {COSINE.format(a="v.embedding", b="w.embedding")} AS s FROM o JOIN embeddings v ON v.vec_id = o.doc_id, t JOIN embeddings w ON w.vec_id = t.doc_id),
al AS (SELECT * FROM ex UNION ALL SELECT * FROM ne UNION ALL SELECT * FROM me WHERE s >= 0 AND unit NOT IN (SELECT unit FROM ex UNION SELECT unit FROM ne))
SELECT CASE tier WHEN 0 THEN 'structural' WHEN 1 THEN 'near' ELSE 'semantic' END AS tier, path, 1 AS line, unit, floor(s * 10000 + 0.5) / 10000 AS similarity, row_number() OVER (ORDER BY tier, s DESC, path) AS rank FROM al QUALIFY rank <= 10""",
)
def similar_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 closest to the first document that has a copy: copies, near copies, then by vectors."""
    base = units(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    u = base.drop("tokens").join(vectors, "doc_id", "left").withColumn("unit", F.col("doc_id"))
    hashes = base.select("path", "norm_hash").where(F.col("norm_hash").isNotNull())
    groups = hashes.groupBy("norm_hash").agg(F.count(F.lit(1)).alias("c"), F.min(F.when(POLICY.reported(POLICY.of(F.col("path"))), F.col("path"))).alias("path"))
    first = groups.where("c > 1").agg(F.min("path").alias("p")).first()["p"]
    target = u.where(F.col("path") == F.lit(first).cast("string"))
    return similar.similar(u, None, target, POLICY, bodies=shape_sets(base)).withColumn("similarity", round4(F.col("similarity")))


RESOLVED = "{target!r} AS target, CASE count(*) WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, count(*) AS matches, min({{'path': path, 'line': line}}).path AS path, min({{'path': path, 'line': line}}).line AS line FROM units"
TARGETS = {"7": "id = '7'", "src4": "owner = 'src4'", "nothing#here": "false", "src4/000000000012:1": "path = 'src4/000000000012' AND line = 1"}


@query("resolve", f"WITH {UNITS} " + " UNION ALL ".join(f"SELECT {RESOLVED.format(target=t)} WHERE {w}" for t, w in TARGETS.items()))
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit by id, a source's name that many units answer to, a name that none has, and a place."""
    u = units(spark, sf_dir).select("path", "line", "id", "owner")
    named = u.select("path", "line", "id").unionByName(u.select("path", "line", F.col("owner").alias("id")))
    found = [similar.resolve(named, t).withColumn("target", F.lit(t)) for t in TARGETS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


LONG = 4


@query("dupes_exact_long", f"WITH {UNITS}, tall AS (SELECT * FROM cand WHERE end_line >= {LONG}), heads AS (SELECT norm_hash, count(*) AS copies, min({{'path': path, 'line': line, 'nodes': nodes}}) AS h, bool_or(class NOT IN ('vendored', 'generated', 'migration')) AS shown FROM tall GROUP BY norm_hash HAVING count(*) >= 2) SELECT norm_hash, copies, h.nodes * (copies - 1) AS saves_nodes, h.path AS path FROM heads WHERE shown")
def dupes_exact_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of documents of four lines and more."""
    return exact.groups(units(spark, sf_dir), POLICY, min_lines=LONG)[0].select("norm_hash", "copies", "saves_nodes", "path")


WITHHELD = Policy({f"src{i}": "vendored" for i in range(20)})


@query("dupes_all_withheld", f"WITH {UNITS}, g AS (SELECT norm_hash FROM cand GROUP BY norm_hash HAVING count(*) >= 2) SELECT 'vendored' AS class, count(*) AS n FROM g HAVING count(*) > 0")
def dupes_all_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group is of withheld code if all sources are: their number is disclosed."""
    return exact.groups(units(spark, sf_dir), WITHHELD, min_lines=MIN_LINES)[1]


SCORED = "s AS (SELECT l.doc_id, l.quality = 1 AS t, CASE WHEN l.toxic = 0 THEN (d.n_chars % 100) / 100.0 END AS similarity FROM labels l JOIN documents d USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as pairs that are true or not, with a similarity for those that aren't toxic."""
    d, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return labels.join(d, "doc_id").select((F.col("quality") == 1).alias("is_true"), F.when(F.col("toxic") == 0, (F.col("n_chars") % 100) / 100).alias("similarity"))


@query("confusion", f"WITH {SCORED} SELECT count(*) FILTER (t AND similarity IS NOT NULL) AS tp, count(*) FILTER (NOT t AND similarity IS NOT NULL) AS fp, count(*) FILTER (t AND similarity IS NULL) AS fn, count(*) FILTER (NOT t AND similarity IS NULL) AS tn FROM s")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_scored(spark, sf_dir))


@query("threshold_sweep", f"WITH {SCORED}, h AS (SELECT CAST(x / 100.0 AS DOUBLE) AS threshold FROM range(25, 96, 5) r(x)) SELECT threshold, count(*) FILTER (t AND coalesce(similarity >= threshold, false)) AS tp, count(*) FILTER (NOT t AND coalesce(similarity >= threshold, false)) AS fp, count(*) FILTER (t AND NOT coalesce(similarity >= threshold, false)) AS fn FROM s, h GROUP BY threshold")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(_scored(spark, sf_dir))


ITEMS = r"items AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM benchmark)"
HITS = "hits AS (SELECT q.item_id AS query_id, u.doc_id AS unit, any_value(u.end_line) AS lines, count(*) AS hits FROM (SELECT doc_id, end_line, unnest(list_distinct(tokens)) AS t FROM units) u JOIN (SELECT item_id, unnest(t) AS t FROM items) q USING (t) GROUP BY ALL)"


@query("overlap_ranking", f"WITH {UNITS}, {ITEMS}, {HITS} SELECT query_id, unit, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, lines, unit) AS rank FROM hits QUALIFY rank <= 5")
def overlap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that have most of each benchmark item's words."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"))
    u = units(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.col("end_line").alias("lines"), "tokens")
    return evaluate.overlap_ranking(u, items).where("rank <= 5")


@query("eval_ranking", f"WITH {UNITS}, {ITEMS}, {HITS}, r AS (SELECT query_id, unit, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, lines, unit) AS rank FROM hits), l AS (SELECT item_id, min(doc_id) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id) SELECT count(*) FILTER (expected IS NOT NULL AND rank = 1) AS top1, count(*) FILTER (expected IS NOT NULL AND rank <= 5) AS top5, count(*) FILTER (expected IS NOT NULL AND rank IS NOT NULL) AS found, count(*) FILTER (expected IS NOT NULL) AS total, count(*) FILTER (expected IS NULL) AS unknown FROM l LEFT JOIN r ON r.query_id = l.item_id AND r.unit = l.expected")
def eval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well word overlap finds the first document that holds each item whole; items in none are unknown."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents")
    u = units(spark, sf_dir).select(F.col("doc_id").alias("unit"), F.col("end_line").alias("lines"), "tokens")
    ranking = evaluate.overlap_ranking(u, items.select("query_id", "tokens"))
    # a document that holds an item whole has all of its words, so the candidates are those with every word
    whole = items.select("query_id", "text", F.size(F.array_distinct("tokens")).alias("n"))
    held = ranking.join(whole, "query_id").where(F.col("hits") == F.col("n")).join(docs.select(F.col("doc_id").alias("unit"), F.col("text").alias("doc")), "unit").where(F.contains("doc", "text"))
    first = held.groupBy("query_id").agg(F.min("unit").alias("expected"))
    labels = items.select("query_id").join(first, "query_id", "left")
    return evaluate.labelled_rank(ranking.withColumnRenamed("unit", "id"), labels, docs.select(F.col("doc_id").alias("id")))
