"""Queries over both duplicate tiers, their scores, ages, answers of outside tools, and checkouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import Policy
from ..functions.text import round4
from ..operators import canonical, caveat, evaluate, exact, near, store, summary
from .documents import FILES, GROUPS, MIN_LINES, PAIRS, POLICY, SHAPES, UNITS, _files, near_pairs, signatures, units
from .registry import query, table

HIDDEN = "('vendored', 'generated', 'migration')"
NEAR_GROUPS = f"""
firsts AS (SELECT norm_hash, min({{'path': path, 'line': line, 'lang': lang, 'lines': end_line, 'nodes': nodes, 'class': class}}) AS u FROM cand GROUP BY norm_hash),
ng AS (SELECT a, b, shared, floor(similarity * 10000 + 0.5) / 10000 AS similarity, x.u AS ua, y.u AS ub FROM sized JOIN firsts x ON x.norm_hash = a JOIN firsts y ON y.norm_hash = b WHERE similarity >= {near.THRESHOLD_F32})
"""


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    u = exact.candidates(units(spark, sf_dir), min_lines=MIN_LINES)
    found, hidden = exact.groups(units(spark, sf_dir), POLICY, min_lines=MIN_LINES)
    pairs = near_pairs(spark, sf_dir).withColumn("similarity", round4(F.col("similarity"))).withColumn("shared_nodes", F.col("shared"))
    return found, hidden, *exact.near_groups(pairs, u, POLICY)


@query(
    "dupes_united",
    f"""WITH {UNITS}, {GROUPS}, {SHAPES}, {PAIRS}, {NEAR_GROUPS}
SELECT 'exact' AS tier, norm_hash, CAST(NULL AS VARCHAR) AS other, h.lang AS lang, copies, h.lines AS lines, h.nodes AS nodes, h.nodes * (copies - 1) AS saves_nodes, CASE WHEN lo = hi THEN lo ELSE 'mixed' END AS population, h.path AS path, h.line AS line, CAST(NULL AS DOUBLE) AS similarity FROM heads WHERE shown
UNION ALL SELECT 'near', a, b, ua.lang, 2, ua.lines, ua.nodes, shared, CASE WHEN ua.class = ub.class THEN ua.class ELSE 'mixed' END, ua.path, ua.line, similarity FROM ng WHERE ua.class NOT IN {HIDDEN} OR ub.class NOT IN {HIDDEN}""",
)
def dupes_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of both tiers in one report order; shared shapes stand for shared nodes."""
    found, _, close, _ = _tiers(spark, sf_dir)
    return exact.ranked(exact.united(found, close))


@query(
    "dupes_united_withheld",
    f"""WITH {UNITS}, {GROUPS}, {SHAPES}, {PAIRS}, {NEAR_GROUPS}
SELECT class, CAST(sum(n) AS BIGINT) AS n FROM (SELECT h.class AS class, count(*) AS n FROM heads WHERE NOT shown GROUP BY 1 UNION ALL SELECT ua.class, count(*) FROM ng WHERE ua.class IN {HIDDEN} AND ub.class IN {HIDDEN} GROUP BY 1) GROUP BY class""",
)
def dupes_united_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both tiers withhold together, by class."""
    _, hidden, _, close = _tiers(spark, sf_dir)
    return exact.merged_withheld(hidden, close)


#: Nearly every source is of a class that isn't reported.
HIDING = Policy({f"src{i}": "generated" if i % 2 == 0 else "vendored" for i in range(100) if i != 4})


@query(
    "dupes_hidden",
    f"""WITH {UNITS}, k AS (SELECT *, CASE WHEN source = 'src4' OR NOT regexp_full_match(source, 'src[0-9]{{1,2}}') THEN 'app' WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'generated' ELSE 'vendored' END AS k FROM cand JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
g AS (SELECT norm_hash, min({{'path': path, 'k': k}}) AS h, bool_or(k = 'app') AS shown FROM k GROUP BY norm_hash HAVING count(*) >= 2) SELECT h.k AS class, count(*) AS n FROM g WHERE NOT shown GROUP BY 1""",
)
def dupes_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups a policy withholds that hides nearly everything."""
    return exact.groups(units(spark, sf_dir), HIDING, min_lines=MIN_LINES)[1]


@query("dupes_min_lines", f"WITH {UNITS} SELECT norm_hash, count(*) AS copies, min(end_line) AS lines FROM (SELECT norm_hash, end_line FROM cand WHERE end_line >= 4) GROUP BY norm_hash HAVING count(*) >= 2")
def dupes_min_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups among documents of 4 lines and more, whatever their class."""
    found, _ = exact.groups(units(spark, sf_dir), Policy(include_ignored=True), min_lines=exact.MIN_LINES)
    return found.join(exact.members(units(spark, sf_dir), found), "norm_hash").groupBy("norm_hash", "copies").agg(F.min("end_line").alias("lines"))


@query("near_uncovered", f"WITH {UNITS}, few AS (SELECT norm_hash, min({{'path': path, 'lang': lang}}) AS u, max(nodes) AS nodes FROM cand GROUP BY norm_hash) SELECT count(*) FILTER (u.lang = 'de') AS uncovered_lang, count(*) FILTER (u.lang IS NULL OR u.lang <> 'de' AND nodes < 100) AS uncovered_small FROM few")
def near_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without shapes, if German had none and a body of fewer than 100 tokens no shape of its own."""
    u = exact.candidates(units(spark, sf_dir), min_lines=MIN_LINES)
    u = u.withColumn("lang", F.when(F.col("lang") == "de", "rust").otherwise(F.coalesce("lang", F.lit("ruby"))))
    return near.uncovered(u, signatures(u.where("lang <> 'rust' AND nodes >= 100")))


AT = "CAST(epoch(date_trunc('second', ts)) AS BIGINT)"


@query("span_ages", f"WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, {AT} // 3600 AS hr, event_id FROM events), s AS (SELECT DISTINCT path, hr AS line, hr + 24 AS end_line FROM e) SELECT s.path, s.line, s.end_line, min(event_id) AS age FROM s LEFT JOIN e ON e.path = s.path AND e.hr BETWEEN s.line AND s.end_line GROUP BY ALL")
def span_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least number of the events that a user has within a day of each; hours stand for lines."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), hour.alias("at"), F.col("event_id").alias("time"))
    return caveat.oldest(e.select("path", F.col("at").alias("line"), (F.col("at") + 24).alias("end_line")), e)


@query("usage_totals", "SELECT coalesce(sum(CASE WHEN role = 'user' THEN length(text) END), 0)::BIGINT AS input_tokens, coalesce(sum(CASE WHEN role <> 'user' THEN length(text) END), 0)::BIGINT AS output_tokens FROM conversations")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that users wrote and that they got back."""
    n, user = F.char_length("text"), F.col("role") == "user"
    return summary.usage(table(spark, sf_dir, "conversations").select(F.when(user, n).alias("input_tokens"), F.when(~user, n).alias("output_tokens")))


@query("fill_order", f"WITH {UNITS} SELECT norm_hash, 0 AS ctx_hash, min(path) AS path, 1 AS line, count(*) AS units FROM cand GROUP BY norm_hash ORDER BY 3, 4, 1 LIMIT 50")
def fill_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fill with a budget of 50 answers asks for first."""
    return summary.in_fill_order(summary.pending(units(spark, sf_dir).withColumn("ctx_hash", F.lit(0)), limit=None), 50)


@query("coverage_by_source", f"WITH {UNITS}, s AS (SELECT doc_id, 'q' || quality AS model, 't' || toxic AS via FROM labels) SELECT model, via, (SELECT count(*) FROM cand) AS summarizable, count(DISTINCT c.doc_id) AS summarized, CASE WHEN count(DISTINCT c.doc_id) = 0 THEN 'none' WHEN count(DISTINCT c.doc_id) < (SELECT count(*) FROM cand) THEN 'warming' ELSE 'complete' END AS state FROM s LEFT JOIN cand c USING (doc_id) GROUP BY model, via")
def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each kind of label covers, kinds standing for sources of answers."""
    u = units(spark, sf_dir).select("norm_hash", F.col("doc_id").alias("ctx_hash"))
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ctx_hash"), F.concat(F.lit("q"), "quality").alias("model"), F.concat(F.lit("t"), "toxic").alias("via")).join(u, "ctx_hash", "left")
    return summary.coverage_by_source(u, s)


@query("units_named", "SELECT p_partkey AS id, p_type AS name FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def units_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the first type by name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return store.named(p, p.agg(F.min("name")).first()[0] or "")


@query("checkout_of", f"WITH {FILES} SELECT root, count(*) AS files FROM files WHERE root = 'src1' GROUP BY root")
def checkout_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source that a path is in; src1 is not where src10 is."""
    f = _files(spark, sf_dir)
    return store.holding(f, "src1/000000000001").groupBy("root").agg(F.count(F.lit(1)).alias("files"))


@query("tier_score", "WITH r AS (SELECT least(l_suppkey, l_partkey) AS lo, greatest(l_suppkey, l_partkey) AS hi, max(l_linenumber) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), l AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_quantity) > 40 AS t FROM lineitem GROUP BY ALL), s AS (SELECT t, lines, coalesce(lines >= 3, false) AS hit, (a % 5 <> 0 AND b % 5 <> 0) AS ok FROM l LEFT JOIN r ON lo = least(a, b) AND hi = greatest(a, b)) SELECT count(*) FILTER (ok AND t AND hit) AS tp, count(*) FILTER (ok AND NOT t AND hit) AS fp, count(*) FILTER (ok AND t AND NOT hit) AS fn, count(*) FILTER (NOT ok) AS unknown, min(lines) FILTER (ok AND t AND hit) AS smallest_true, max(lines) FILTER (ok AND NOT t AND hit) AS largest_false FROM s")
def tier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on pairs held against reported pairs of 3 lines and more; every fifth key is unknown."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    reported = l.where("l_returnflag = 'R'").select(supp.alias("a"), part.alias("b"), F.col("l_linenumber").alias("lines"))
    labels = l.groupBy(part.alias("a"), supp.alias("b")).agg((F.max("l_quantity") > 40).alias("is_true"))
    known = l.select(F.explode(F.array(part, supp)).alias("id")).where("id % 5 <> 0")
    return evaluate.tier_score(reported, labels, known, 3)


@query("measured_sweep", "WITH s AS (SELECT l_returnflag <> 'R' AS t, l_linenumber <= 2 AS short, l_discount * 10 AS nodes, l_tax * 10 AS shapes FROM lineitem), m AS (SELECT t, short, 'nodes' AS measure, nodes AS v FROM s UNION ALL SELECT t, short, 'shapes', shapes FROM s), th AS (SELECT unnest(range(25, 100, 5)) / 100 AS threshold) SELECT measure, threshold, count(*) FILTER (t AND v >= threshold) AS tp, count(*) FILTER (NOT t AND v >= threshold) AS fp, count(*) FILTER (t AND v < threshold) AS fn, count(*) FILTER (short AND t AND v >= threshold) AS short_found, count(*) FILTER (short AND t) AS short_total, count(*) FILTER (short AND NOT t AND v >= threshold) AS short_false FROM m, th GROUP BY ALL")
def measured_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two measures swept over the same labels; discount and tax stand for similarities."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return evaluate.measured_sweep(l.select((F.col("l_returnflag") != "R").alias("is_true"), (F.col("l_linenumber") <= 2).alias("short"), (F.col("l_discount") * 10).alias("nodes"), (F.col("l_tax") * 10).alias("shapes")))


@query("signal_score", "WITH m AS (SELECT o_custkey AS grp, o_orderkey AS member, CAST(epoch(o_orderdate) AS BIGINT) AS v, CAST(floor(o_totalprice) AS BIGINT) AS d FROM orders), l AS (SELECT grp, min(member) AS expected FROM m GROUP BY grp), b AS (SELECT grp, min(v) AS v, min(d) AS d FROM m GROUP BY grp), h AS (SELECT 'age' AS signal, m.grp, CASE WHEN count(*) = 1 THEN min(member) END AS pick FROM m JOIN b ON m.grp = b.grp AND m.v = b.v GROUP BY m.grp UNION ALL SELECT 'depth', m.grp, CASE WHEN count(*) = 1 THEN min(member) END FROM m JOIN b ON m.grp = b.grp AND m.d = b.d GROUP BY m.grp UNION ALL SELECT 'references', grp, NULL FROM b) SELECT signal, count(*) FILTER (pick = expected) AS correct, count(*) FILTER (pick <> expected) AS wrong, count(*) FILTER (pick IS NULL) AS silent FROM h JOIN l USING (grp) GROUP BY signal")
def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each signal picks a customer's order of the least number; references could not be measured."""
    none = F.lit(None).cast("long")
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("member"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("age"), none.alias("confirmed"), none.alias("possible"), F.floor("o_totalprice").alias("depth"))
    return evaluate.signal_score(canonical.signals(m), m.groupBy("grp").agg(F.min("member").alias("expected")))
