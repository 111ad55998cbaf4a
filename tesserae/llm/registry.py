"""The queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontaminate, html, langid, lm, quality, suffix, topk, warc
from .jaccard import jaccard_components
from .vocabulary import vocabulary_path

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by integer inner product, for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of token ids and of decoded texts, from a round trip through the vocabulary."""
    out = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    n, ids = F.octet_length("ids"), F.sha2("ids", 256)
    return out.select("doc_id", (n / 4).cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, and where."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document under all bigrams of all documents, its own included."""
    return lm.scores(table(spark, sf_dir, "documents"), leave_out=False)


@query
def lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stupid-backoff score of every document by trigrams; what no other document has backs off to bigrams, and they to words."""
    return lm.scores(table(spark, sf_dir, "documents"), leave_out=True, order=3)


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What WARC records of all pages say after being written and read back."""
    read = warc.through_archives(table(spark, sf_dir, "pages"), least=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    forest = quality.train(docs, labels.where(~out))
    return quality.score(docs, forest).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 100-byte strings leaves of every document."""
    out = suffix.repeated_passages(table(spark, sf_dir, "documents"), width=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: 3-word shingles, Jaccard 0.90 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, threshold=(90, 100))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


ORACLES["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS q FROM i WHERE len(w) >= 5),
hits AS (SELECT doc_id, item_id, p - q AS shift FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) * 100 >= any_value(least(13, n)) * 80),
laid AS (SELECT h.doc_id, h.item_id, h.shift, iw.n, iw.q, CASE WHEN dw.word = iw.word THEN 1 ELSE 0 END AS eq FROM hits h JOIN iw USING (item_id) LEFT JOIN dw ON dw.doc_id = h.doc_id AND dw.p = iw.q + h.shift),
runs AS (SELECT doc_id, item_id, shift, n, q, CASE WHEN n >= 13 THEN sum(eq) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) ELSE sum(eq) OVER (PARTITION BY doc_id, item_id, shift) END AS m FROM laid),
best AS (SELECT doc_id, item_id, CAST(m AS INTEGER) AS matched, CAST(least(13, n) AS INTEGER) AS window_words, CAST(shift + q AS INTEGER) AS doc_start, CAST(q AS INTEGER) AS item_start FROM runs WHERE q <= n - least(13, n) AND m * 100 >= least(13, n) * 80)
SELECT doc_id, item_id, matched, window_words, doc_start, item_start FROM best
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start, item_start) = 1
"""

ORACLES["op6_lm_scores"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS b, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS a, b FROM e),
one AS (SELECT b, count(*) AS n FROM g GROUP BY b),
two AS (SELECT a, b, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b),
s AS (SELECT g.doc_id, CASE WHEN g.a IS NULL THEN ln(o.n / CAST((SELECT count(*) FROM g) AS DOUBLE)) WHEN two.n IS NOT NULL THEN ln(two.n / CAST(c.n AS DOUBLE)) ELSE ln(0.4 * o.n / (SELECT count(*) FROM g)) END AS l
  FROM g JOIN one o ON o.b = g.b LEFT JOIN two ON two.a = g.a AND two.b = g.b LEFT JOIN one c ON c.b = g.a),
d AS (SELECT doc_id, count(*) AS n_words, sum(l) AS s FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(s, 0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(s / n_words, 4) END AS mean_log_score FROM documents LEFT JOIN d USING (doc_id)
"""

ORACLES["lm_backoff"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM t),
f AS (SELECT doc_id, lag(c, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS b, c FROM e),
g AS (SELECT doc_id, a, b, c, count(*) OVER (PARTITION BY doc_id, b, c) AS own_2, count(*) OVER (PARTITION BY doc_id, a, b, c) AS own_3 FROM f),
one AS (SELECT c, count(*) AS n FROM f GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM f WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM f WHERE a IS NOT NULL GROUP BY a, b, c),
p AS (SELECT g.doc_id, g.a, g.b, g.own_2, g.own_3, o.n / CAST((SELECT count(*) FROM f) AS DOUBLE) AS p_1, two.n AS n_2, two.n / CAST(ctx_1.n AS DOUBLE) AS p_2, three.n AS n_3, three.n / CAST(ctx_2.n AS DOUBLE) AS p_3
  FROM g JOIN one o ON o.c = g.c LEFT JOIN one ctx_1 ON ctx_1.c = g.b LEFT JOIN two ON two.b = g.b AND two.c = g.c LEFT JOIN two ctx_2 ON ctx_2.b = g.a AND ctx_2.c = g.b LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c),
s AS (SELECT doc_id, CASE WHEN b IS NULL THEN ln(p_1) WHEN a IS NOT NULL AND n_3 > own_3 THEN ln(p_3)
  ELSE CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN n_2 > own_2 THEN ln(p_2) ELSE ln(0.4) + ln(p_1) END END AS l FROM p),
d AS (SELECT doc_id, count(*) AS n_words, sum(l) AS s FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(s, 0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(s / n_words, 4) END AS mean_log_score FROM documents LEFT JOIN d USING (doc_id)
"""

_DOC_WORDS = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
"""
ORACLES["op10_jaccard_join"] = (
    _DOC_WORDS
    + r"""
s AS (SELECT doc_id, len(w) AS n_words, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
)

ORACLES["op1_pivot_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

ORACLES["op9_suffix_dedup"] = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
h AS (SELECT doc_id, octet_length(raw) AS n, hex(raw) AS x, raw FROM b),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, x FROM h WHERE n >= 100),
k AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 200)) AS g FROM w),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM late),
n AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m),
spans AS (SELECT doc_id, run, min(s) AS lo, max(s) + 100 AS hi FROM n GROUP BY ALL),
edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM edge JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN gone IS NULL THEN raw ELSE unhex(kept || substr(x, 2 * last + 1)) END) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""
