"""Queries over the star schema, events, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.paths import Policy, under, withheld
from ..functions.text import humanize, lexical_score, round2, round4, tokens
from ..functions.vectors import cosine, hash_embed_native, shortened
from ..operators import canonical, caveat, evaluate, search, summary
from ..operators.sizes import bounded
from .documents import COSINE
from .registry import query, table

PAGE_POLICY = Policy({"fr": "vendored", "de": "test", "de/1": "fixture", "es/9": "generated"})
PAGE = "p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages), c AS (SELECT page_id, path, CASE WHEN path = 'de/1' OR path LIKE 'de/1/%' THEN 'fixture' WHEN path = 'es/9' OR path LIKE 'es/9/%' THEN 'generated' WHEN path = 'fr' OR path LIKE 'fr/%' THEN 'vendored' WHEN path = 'de' OR path LIKE 'de/%' THEN 'test' ELSE 'app' END AS class FROM p)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))


@query("path_class", f"WITH {PAGE} SELECT page_id, path, class FROM c")
def path_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("class", PAGE_POLICY.of(F.col("path")))


@query("path_withheld", f"WITH {PAGE} SELECT class, count(*) AS n FROM c WHERE class IN ('migration', 'generated', 'vendored') GROUP BY class")
def path_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return withheld(_pages(spark, sf_dir), PAGE_POLICY)[1]


@query("path_scope", f"WITH {PAGE} SELECT page_id, path FROM p WHERE path = 'en' OR starts_with(path, 'en/')")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(under(F.col("path"), "en/"))


@query("humanized", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_brand || '::' || p_type || '_' || p_name, '[^\p{L}\p{N}]+', ' ', 'g'), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '([\p{L}\p{N}])(\p{Lu}\p{Ll})', '\1 \2', 'g')) AS words FROM part")
def humanized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", humanize(F.concat("p_brand", F.lit("::"), "p_type", F.lit("_"), "p_name")).alias("words"))


WORDS = r"[\p{L}\p{N}]+"
LEXICAL = f"""
q AS (SELECT r_regionkey AS query_id, q FROM (SELECT r_regionkey, regexp_extract_all(lower(CASE r_regionkey WHEN 0 THEN 'small ring' WHEN 1 THEN 'economy red' WHEN 2 THEN 'wid gear' WHEN 3 THEN 'bo sm econ' ELSE 'hot hot bolt' END), '{WORDS}') AS q FROM region)),
n AS (SELECT p_partkey AS unit, regexp_extract_all(lower(p_name || ' ' || p_type), '{WORDS}') AS t FROM part),
s AS (SELECT query_id, unit, list_sum(list_transform(q, lambda x: CASE WHEN list_contains(t, x) THEN 1.0 WHEN length(x) > 2 AND len(list_filter(t, lambda y: starts_with(y, x))) > 0 THEN 0.5 ELSE 0.0 END)) / len(q) AS score FROM n, q)
"""


@query("lexical_rank", f"WITH {LEXICAL} SELECT query_id, unit, floor(score * 10000 + 0.5) / 10000 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10")
def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten parts whose names answer each of five queries best."""
    k = F.col("r_regionkey")
    text = F.when(k == 0, "small ring").when(k == 1, "economy red").when(k == 2, "wid gear").when(k == 3, "bo sm econ").otherwise("hot hot bolt")
    q = F.broadcast(table(spark, sf_dir, "region").select(k.alias("query_id"), tokens(text).alias("q")))
    u = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), tokens(F.concat("p_name", F.lit(" "), "p_type")).alias("t"))
    s = u.crossJoin(q).select("query_id", "unit", lexical_score(F.col("q"), F.col("t")).alias("score")).where("score > 0")
    return s.withColumn("rank", search.rank_by("score", "unit")).where("rank <= 10").withColumn("score", round4(F.col("score")))


TURNS = f"""
u AS (SELECT conv_id * 1000 + turn AS unit, 'c' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS path, turn + 1 AS line, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS tokens, CAST(conv_id AS VARCHAR) AS owner, CASE role WHEN 'system' THEN 'public' ELSE 'private' END AS visibility, CASE role WHEN 'user' THEN 'summary' ELSE 'identifier' END AS vec_via, e.embedding AS vec
  FROM conversations LEFT JOIN embeddings e ON e.vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings)),
q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{WORDS}') AS q, e.embedding AS qv FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id)
"""


@query(
    "search",
    f"""WITH {TURNS},
s AS (SELECT query_id, unit, vec_via, list_sum(list_transform(q, lambda x: CASE WHEN list_contains(tokens, x) THEN 1.0 WHEN length(x) > 2 AND len(list_filter(tokens, lambda y: starts_with(y, x))) > 0 THEN 0.5 ELSE 0.0 END)) / len(q) AS lex, CASE WHEN vec IS NOT NULL THEN {COSINE.format(a="qv", b="vec")} END AS cos FROM u, q),
l AS (SELECT query_id, unit, lex / (60.0 + row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, unit)) AS part, 1 AS src FROM s WHERE lex > 0),
m AS (SELECT query_id, unit, (CASE vec_via WHEN 'summary' THEN 1.0 ELSE 0.7 END) / (60.0 + row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, unit)) AS part, 2 AS src FROM s WHERE cos > 0 AND cos >= 0.1),
h AS (SELECT owner, min(CASE WHEN visibility = 'public' THEN unit END) AS nominee FROM u GROUP BY owner HAVING count(*) >= 2 AND count(*) FILTER (visibility = 'public') = 1),
d AS (SELECT owner, i, avg(CAST(vec[i] AS DOUBLE)) AS x FROM u JOIN h USING (owner), range(1, 65) r(i) WHERE vec IS NOT NULL GROUP BY owner, i),
ce AS (SELECT owner, list(x ORDER BY i) AS centroid FROM d GROUP BY owner),
cc AS (SELECT query_id, nominee AS unit, {COSINE.format(a="qv", b="centroid")} AS cos FROM h JOIN ce USING (owner), q),
n AS (SELECT query_id, unit, cos * 0.7 / (60.0 + row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, unit)) AS part, 3 AS src FROM cc WHERE cos >= 0.1),
f AS (SELECT query_id, unit, sum(part ORDER BY src) AS score, bool_or(src = 1) AS l, bool_or(src = 2) AS s FROM (SELECT * FROM l UNION ALL SELECT * FROM m UNION ALL SELECT * FROM n) GROUP BY ALL)
SELECT query_id, unit, floor(score * 10000 + 0.5) / 10000 AS score, CASE WHEN l AND s THEN 'both' WHEN s THEN 'semantic' ELSE 'lexical' END AS how, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line) AS rank FROM f JOIN u USING (unit) QUALIFY rank <= 10""",
)
def search_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten turns of conversations that answer each benchmark item best, by words, vectors and whole conversations."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = e.count()  # every turn has a vector
    c = table(spark, sf_dir, "conversations")
    u = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("unit"), F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("path"), (F.col("turn") + 1).alias("line"), tokens(F.col("text")).alias("tokens"), F.col("conv_id").cast("string").alias("owner"),
        F.when(F.col("role") == "system", "public").otherwise("private").alias("visibility"), F.lit(None).cast("string").alias("via"), F.when(F.col("role") == "user", "summary").otherwise("identifier").alias("vec_via"), F.lit("ruby").alias("lang"), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(n)).alias("vec_id"),
    ).join(e, "vec_id", "left")
    q = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("tokens"), "vec")
    return search.search(u, q, floor=0.1).select("query_id", "unit", round4(F.col("score")).alias("score"), "how", "rank")


CENTROIDS = "d AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), ce AS (SELECT label, list(x ORDER BY i) AS centroid FROM d GROUP BY label)"


def _with_centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first"))
    u = e.join(bounded(first), "label").select(F.col("vec_id").alias("unit"), F.col("label").cast("string").alias("owner"), F.when(F.col("vec_id") == F.col("first"), "public").otherwise("private").alias("visibility"), F.lit(None).cast("string").alias("via"), F.col("embedding").alias("vec"))
    return e, search.containers(u)


@query("container_centroids", f"WITH {CENTROIDS}, f AS (SELECT label, min(vec_id) AS nominee FROM embeddings GROUP BY label) SELECT CAST(label AS VARCHAR) AS owner, nominee, floor(({COSINE.format(a='embedding', b='centroid')}) * 10000 + 0.5) / 10000 AS cos FROM f JOIN ce USING (label) JOIN embeddings e ON e.vec_id = nominee")
def container_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How close the nominee of each label is to the label's centroid."""
    e, c = _with_centroids(spark, sf_dir)
    return c.join(e.select(F.col("vec_id").alias("nominee"), "embedding"), "nominee").select("owner", "nominee", round4(cosine(F.col("embedding"), F.col("centroid"))).alias("cos"))


@query("centroid_calibration", f"WITH {CENTROIDS}, c AS (SELECT e.label = ce.label AS own, {COSINE.format(a='embedding', b='centroid')} AS cos FROM embeddings e, ce), t AS (SELECT x / 100.0 AS floor FROM range(0, 51, 5) r(x)) SELECT CAST(floor AS DOUBLE) AS floor, count(*) FILTER (own AND cos >= floor) AS answers_kept, count(*) FILTER (NOT own AND cos < floor) AS distractors_cut FROM c, t GROUP BY floor")
def centroid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cosine floor, how many vectors keep their own label's centroid and how many others are cut."""
    e, c = _with_centroids(spark, sf_dir)
    both = e.crossJoin(bounded(c)).select((F.col("label").cast("string") == F.col("owner")).alias("own"), cosine(F.col("embedding"), F.col("centroid")).alias("cosine"))
    return evaluate.floors(both.where("own"), both.where("not own"))


@query("shortened_norms", "WITH s AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s) SELECT vec_id, floor(v[1] / n * 10000 + 0.5) / 10000 AS first, floor(v[32] / n * 10000 + 0.5) / 10000 AS last FROM n")
def shortened_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", shortened(F.col("embedding"), 32).alias("v"))
    return v.select("vec_id", round4(F.col("v")[0]).alias("first"), round4(F.col("v")[31]).alias("last"))


@query("hash_cells", f"WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS t FROM benchmark) SELECT item_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 256 AS INTEGER) AS dim, CAST(sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS value FROM t GROUP BY 1, 2 HAVING value <> 0")
def hash_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_embed_native(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))


MEMBERS = "m AS (SELECT o_custkey AS grp, o_orderkey AS member, CAST(epoch(o_orderdate) AS BIGINT) AS age, count(l_orderkey) FILTER (l_returnflag = 'R') AS confirmed, count(l_orderkey) AS possible, CAST(left(o_orderpriority, 1) AS BIGINT) AS depth FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(
    "canonical",
    f"""WITH {MEMBERS}, x AS (SELECT *, max(confirmed) OVER (PARTITION BY grp) AS top FROM m),
s AS (SELECT grp, member, 'age' AS signal, age AS v FROM x UNION ALL SELECT grp, member, 'references', -(CASE WHEN top > 0 THEN confirmed ELSE possible END) FROM x UNION ALL SELECT grp, member, 'depth', depth FROM x),
b AS (SELECT *, min(v) OVER (PARTITION BY grp, signal) AS best FROM s),
p AS (SELECT grp, signal, CASE WHEN count(*) = 1 THEN min(member) END AS pick FROM b WHERE v = best GROUP BY ALL),
g AS (SELECT grp, min(pick) FILTER (signal <> 'depth') AS lo, max(pick) FILTER (signal <> 'depth') AS hi, max(pick) FILTER (signal = 'depth') AS weak FROM p GROUP BY grp)
SELECT grp, CASE WHEN lo = hi THEN lo WHEN lo IS NULL THEN weak END AS pick, CASE WHEN lo = hi THEN 'agree' WHEN lo IS NOT NULL THEN 'disagree' WHEN weak IS NOT NULL THEN 'weak' ELSE 'nothing' END AS basis FROM g""",
)
def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's canonical order: oldest, most returned lines, highest priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("member"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("age"), F.left("o_orderpriority", F.lit(1)).cast("long").alias("depth"))
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("member")).agg(F.count_if(F.col("l_returnflag") == "R").alias("confirmed"), F.count(F.lit(1)).alias("possible"))
    m = o.join(counts, "member", "left").fillna(0, ["confirmed", "possible"])
    return canonical.canonical(m)


@query("interval_reads", "WITH e AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at, event_type FROM events) SELECT s.event_id AS span, count(*) AS reads FROM e s JOIN e p ON p.user_id = s.user_id AND p.at BETWEEN s.at AND s.at + 86400 WHERE s.event_type = 'purchase' GROUP BY 1")
def interval_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of the same user fall within a day from each purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("at").alias("lo"), (F.col("at") + 86400).alias("hi"))
    return caveat.within(e.select("user_id", "at"), spans, "user_id", "at", "lo", "hi", 86400).groupBy("span").agg(F.count(F.lit(1)).alias("reads"))


@query("scope_resolution", "WITH r AS (SELECT DISTINCT l_returnflag AS name, p_brand || '::' || p_type || '::' || CAST(p_size AS VARCHAR) AS nesting, p_brand AS a, p_brand || '::' || p_type AS b FROM lineitem JOIN part ON p_partkey = l_partkey), d AS (SELECT DISTINCT l_returnflag AS name, CASE WHEN l_linenumber = 1 THEN p_brand ELSE p_brand || '::' || p_type END AS parent FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48) SELECT r.name, nesting, CASE WHEN x.parent IS NOT NULL THEN x.parent ELSE y.parent END AS reached FROM r LEFT JOIN d x ON x.name = r.name AND x.parent = b LEFT JOIN d y ON y.name = r.name AND y.parent = a")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost scope around each read that defines its name; brands enclose types, types enclose sizes."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    reads = j.select(F.col("l_returnflag").alias("name"), F.concat_ws("::", "p_brand", "p_type", F.col("p_size").cast("string")).alias("nesting")).distinct()
    defs = j.where("l_quantity > 48").select(F.col("l_returnflag").alias("name"), F.when(F.col("l_linenumber") == 1, F.col("p_brand")).otherwise(F.concat_ws("::", "p_brand", "p_type")).alias("parent")).distinct()
    return caveat.resolved(reads, defs)


@query("latest_answers", "SELECT user_id AS norm_hash, event_type AS ctx_hash, arg_max(props, {'t': CAST(epoch(date_trunc('second', ts)) AS BIGINT), 'p': props}) AS json FROM events GROUP BY 1, 2")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest properties of each user and kind of event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("norm_hash"), F.col("event_type").alias("ctx_hash"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.col("props").alias("json"))
    return summary.latest(e)


@query("answer_sources", "SELECT DISTINCT role AS model, CASE WHEN turn = 0 THEN 'api' ELSE 'mcp' END AS via FROM conversations")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.sources(table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.when(F.col("turn") == 0, "api").otherwise("mcp").alias("via")))


NOW = 1_000_000_000


@query("order_spans", f"WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS t FROM orders), d AS (SELECT o_orderkey, t, ({NOW} - t) // 86400 AS days FROM o) SELECT o_orderkey, CAST(CAST(to_timestamp(t) AS DATE) AS VARCHAR) AS day, CASE WHEN days >= 365 THEN (days // 365) || ' year' || CASE WHEN days // 365 = 1 THEN '' ELSE 's' END WHEN days >= 30 THEN (days // 30) || ' month' || CASE WHEN days // 30 = 1 THEN '' ELSE 's' END WHEN days >= 1 THEN days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END ELSE 'under a day' END AS age FROM d")
def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day(t).alias("day"), dates.span(F.lit(NOW) - t).alias("age"))


@query("value_distribution", "SELECT count(value) AS n, floor(min(value) * 100 + 0.5) / 100 AS min, floor(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(value) * 100 + 0.5) / 100 AS mean, floor(max(value) * 100 + 0.5) / 100 AS max FROM events")
def value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(table(spark, sf_dir, "events"), "value")


@query("repeat_purchases", "WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), c AS (SELECT a, count(*) AS parts FROM p GROUP BY a) SELECT a AS supplier, parts, floor(parts / CAST((SELECT count(*) FROM part) AS DOUBLE) * 100 + 0.5) / 100 AS share FROM c")
def repeat_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct parts each supplier ships, and their share of all parts."""
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey").distinct().groupBy("supplier").agg(F.count(F.lit(1)).alias("parts"))
    return c.crossJoin(F.broadcast(n)).select("supplier", "parts", round2(F.col("parts") / F.col("n")).alias("share"))
