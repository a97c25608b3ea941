"""The engine's queries over the test tables, and the same in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, run_search
from .functions import text as T
from .functions import vectors as V
from .functions.ring import plan_rebalance, shard_column
from .operators import dense, lexical, mutations, quantize, rag, topk
from .plans.filters import compile_filter, index_numbers, index_tokens, payload_variant
from .types import CollectionConfig, Metric, SearchRequest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_json(F.struct("label")).alias("payload"))


def asked(spark, d) -> DataFrame:
    """Every row whose id is divisible by 20, as a query."""
    return _t(spark, d, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))


def texts(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def hybrid(spark, d) -> DataFrame:
    docs = texts(spark, d)
    return points(spark, d).join(docs, "id")


def words(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, text string")


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


E_SQL = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
Q_SQL = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0"
SCORES = {"cosine": "list_cosine_similarity(v, q)", "dot": "list_inner_product(v, q)", "euclidean": "0 - list_inner_product(list_transform(list_zip(v, q), lambda p: p[1] - p[2]), list_transform(list_zip(v, q), lambda p: p[1] - p[2]))"}


def dense_sql(metric="cosine", k=10, where="true", extra="") -> str:
    return f"""WITH s AS (SELECT query_id, id, {SCORES[metric]} AS score FROM (SELECT * FROM ({E_SQL}) WHERE {where}) e, ({Q_SQL}) q)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k} {extra}"""


@query(dense_sql("cosine"))
def dense_cosine_topk(spark, d):
    return _out(dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 10))


@query(dense_sql("euclidean"))
def dense_euclidean_topk(spark, d):
    return _out(dense.exact(points(spark, d), asked(spark, d), Metric.EUCLIDEAN, 10))


@query(dense_sql("dot"))
def dense_dot_topk(spark, d):
    return _out(dense.exact(points(spark, d), asked(spark, d), Metric.DOT, 10))


@query(dense_sql("cosine"))
def dense_batch_topk(spark, d):
    return _out(dense.batch(points(spark, d), asked(spark, d), Metric.COSINE, 10))


@query(dense_sql("euclidean"))
def dense_batch_euclidean(spark, d):
    return _out(dense.batch(points(spark, d), asked(spark, d), Metric.EUCLIDEAN, 10))


@query(dense_sql("cosine", 20))
def dense_overfetch_2k(spark, d):
    return _out(dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 2 * 10))


@query(f"""WITH e AS ({E_SQL} UNION ALL SELECT 'zero', list_transform(range(64), lambda x: 0.0::DOUBLE), 0)
SELECT query_id, id, round(CASE WHEN list_inner_product(v, v) = 0 THEN 0.0 ELSE list_cosine_similarity(v, q) END, 6) AS score FROM e, ({Q_SQL}) q""")
def dense_cosine_zero_norm(spark, d):
    zero = spark.range(1).select(F.lit("zero").alias("id"), F.array_repeat(F.lit(0.0), 64).alias("values"))
    both = points(spark, d).select("id", V.doubles("values").alias("values")).unionByName(zero)
    return dense.pairs(both, asked(spark, d), Metric.COSINE, 6)


@query(f"SELECT id, round(list_cosine_similarity(v, q), 6) AS score FROM ({E_SQL}), ({Q_SQL}) WHERE query_id = 0 ORDER BY list_cosine_similarity(v, q) DESC, id LIMIT 7")
def dense_single_query_limit(spark, d):
    one = asked(spark, d).where("query_id = 0")
    s = points(spark, d).crossJoin(F.broadcast(one)).select("id", V.cosine(V.doubles("values"), F.col("query")).alias("s"))
    return s.orderBy(F.desc("s"), "id").limit(7).select("id", F.round("s", 6).alias("score"))


def _filtered(spark, d, rule, k=10):
    p = points(spark, d)
    return _out(dense.exact(p.where(compile_filter(rule, payload_variant(F.col("payload")))), asked(spark, d), Metric.COSINE, k))


@query(dense_sql(where="label = 3"))
def filtered_dense_match(spark, d):
    return _filtered(spark, d, {"must": [{"key": "label", "match": 3}]})


@query(dense_sql(where="label IN (1, 4, 7)"))
def filtered_dense_any_of(spark, d):
    return _filtered(spark, d, {"must": [{"key": "label", "any_of": [1, 4, 7]}]})


@query(dense_sql(where="label >= 2 AND label < 5"))
def filtered_dense_range(spark, d):
    return _filtered(spark, d, {"must": [{"key": "label", "range": {"gte": 2, "lt": 5}}]})


@query(dense_sql(where="label IS NOT NULL"))
def filtered_dense_exists(spark, d):
    return _filtered(spark, d, {"must": [{"key": "label", "exists": True}, {"key": "none.such", "exists": False}]})


@query(dense_sql(where="label <> 0 AND label NOT IN (5, 6)"))
def filtered_dense_must_not(spark, d):
    return _filtered(spark, d, {"must_not": [{"key": "label", "match": 0}, {"key": "label", "any_of": [5, 6]}]})


@query(dense_sql(where="label = 1 OR label > 7"))
def filtered_dense_should(spark, d):
    return _filtered(spark, d, {"should": [{"key": "label", "match": 1}, {"key": "label", "range": {"gt": 7}}]})


@query(dense_sql(where="label < 8 AND (label = 2 OR NOT label < 6)"))
def filtered_dense_nested(spark, d):
    inner = {"should": [{"key": "label", "match": 2}, {"filter": {"must_not": [{"key": "label", "range": {"lt": 6}}]}}]}
    return _filtered(spark, d, {"must": [{"key": "label", "range": {"lt": 8}}, {"filter": inner}]})


@query(dense_sql(extra="AND CAST(id AS BIGINT) % 2 = 0"))
def filter_ids_semi(spark, d):
    allowed = points(spark, d).where("cast(id as long) % 2 = 0").select("id")
    return _out(topk.restrict(dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 10), allowed))


def _events(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.to_variant_object(F.struct(F.try_parse_json("props").alias("props"), "event_type", "value", F.array("event_type", F.lit("any")).alias("tags"))).alias("p"))


def _event_filter(spark, d, rule):
    return _events(spark, d).where(compile_filter(rule, F.col("p"))).select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'purchase'")
def filter_payload_scan_match(spark, d):
    return _event_filter(spark, d, {"must": [{"key": "event_type", "match": "purchase"}]})


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE CAST(props->>'$.k' AS DOUBLE) >= 20 AND CAST(props->>'$.k' AS DOUBLE) < 60")
def filter_payload_scan_range(spark, d):
    return _event_filter(spark, d, {"must": [{"key": "props.k", "range": {"gte": 20, "lt": 60}}]})


@query("""SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE coalesce(event_type <> 'view', true) AND NOT coalesce(CAST(props->>'$.k' AS DOUBLE) > 90, false)
AND (coalesce(value > 50, false) OR coalesce(event_type IN ('click', 'error'), false))""")
def filter_payload_bool_tree(spark, d):
    return _event_filter(spark, d, {"must_not": [{"key": "event_type", "match": "view"}, {"key": "props.k", "range": {"gt": 90}}], "should": [{"key": "value", "range": {"gt": 50}}, {"key": "tags", "any_of": ["click", "error"]}]})


@query("SELECT doc_id, quality IS NOT NULL AND quality <> 1 AS passes FROM documents LEFT JOIN labels USING (doc_id)")
def filter_payload_missing_payload(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), F.to_json(F.struct("quality"))).alias("payload"))
    return rows.select("doc_id", compile_filter({"must_not": [{"key": "quality", "match": 1}]}, payload_variant(F.col("payload"))).alias("passes"))


@query("SELECT event_type AS token, count(*) AS points FROM events WHERE event_type IS NOT NULL GROUP BY 1 UNION ALL SELECT 'any', count(*) FROM events")
def payload_index_keyword(spark, d):
    return _events(spark, d).select(F.explode(index_tokens(F.try_variant_get("p", "$.tags", "variant"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("points"))


@query("SELECT CAST(props->>'$.k' AS DOUBLE) AS number, count(*) AS points FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY 1")
def payload_index_numeric(spark, d):
    return _events(spark, d).select(F.explode(index_numbers(F.try_variant_get("p", "$.props.k", "variant"))).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("points"))


@query("SELECT CAST(toxic = 1 AS VARCHAR) AS token, count(*) AS points FROM labels GROUP BY 1")
def payload_index_bool(spark, d):
    rows = _t(spark, d, "labels").select(F.to_variant_object(F.struct((F.col("toxic") == 1).alias("toxic"))).alias("p"))
    return rows.select(F.explode(index_tokens(F.try_variant_get("p", "$.toxic", "variant"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("points"))


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
POSTINGS = f"SELECT id, length, term, count(*) AS tf FROM (WITH listed AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, {TOKENS} AS t FROM documents) SELECT id, len(t) AS length, unnest(t) AS term FROM listed) GROUP BY id, length, term"


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS INT) AS n_tokens, CAST(len(list_distinct({TOKENS})) AS INT) AS n_terms FROM documents")
def tokenize_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(f"SELECT count(*) AS docs, round(avg(len({TOKENS})), 6) AS avg_length FROM documents")
def bm25_doc_stats(spark, d):
    return lexical.corpus_stats(texts(spark, d)).select("docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"SELECT term, count(*) AS df FROM ({POSTINGS}) GROUP BY term")
def bm25_term_df(spark, d):
    return lexical.document_frequency(lexical.term_postings(texts(spark, d)))


def bm25_sql(asked: list, k: int) -> str:
    rows = ", ".join(f"({q}, '{t}', {n})" for q, t, n in asked)
    return f"""p AS MATERIALIZED ({POSTINGS}), w(query_id, term, times) AS (VALUES {rows}), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    st AS MATERIALIZED (SELECT count(*) AS n, avg(len({TOKENS})) AS avgdl FROM documents),
    b AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / greatest(tf + 1.2 * (1 - 0.75 + 0.75 * length / greatest(avgdl, 1)), 1e-6)) AS score FROM p JOIN w USING (term) JOIN df USING (term), st GROUP BY 1, 2),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= {k})"""


BM_OUT = "SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM bm"
ASK = [(0, "the", 1), (0, "idiot", 1), (0, "released", 1)]


@query(f"WITH {bm25_sql(ASK, 10)} {BM_OUT}")
def bm25_topk(spark, d):
    return _out(lexical.bm25_search(texts(spark, d), words(spark, [(0, "The idiot, released")]), 10))


@query(f"WITH {bm25_sql([(0, 'the', 2), (0, 'idiot', 1)], 10)} {BM_OUT}")
def bm25_duplicate_terms(spark, d):
    return _out(lexical.bm25_search(texts(spark, d), words(spark, [(0, "the the idiot")]), 10))


@query(f"WITH {bm25_sql([(0, 'the', 1), (1, 'que', 1), (1, 'la', 1), (2, 'und', 1), (2, 'die', 1)], 5)} {BM_OUT}")
def bm25_batch(spark, d):
    return _out(lexical.bm25_search(texts(spark, d), words(spark, [(0, "the"), (1, "que la"), (2, "Und DIE"), (3, "!!")]), 5))


@query(f"WITH {bm25_sql(ASK, 20)} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM bm JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10")
def bm25_filtered(spark, d):
    hits = lexical.bm25_search(texts(spark, d), words(spark, [(0, "The idiot, released")]), 20)
    rows = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct("lang")).alias("payload"))
    passed = rows.where(compile_filter({"must": [{"key": "lang", "match": "en"}]}, payload_variant(F.col("payload"))))
    return _out(topk.ranked(hits.drop("rank").join(passed.select("id"), "id", "left_semi"), 10))


SPARSE = f"SELECT id, CAST(len(term) AS BIGINT) AS idx, CAST(sum(tf) AS DOUBLE) AS weight FROM ({POSTINGS}) GROUP BY 1, 2"


def _sparse_points(spark, d):
    """Token lengths as indices, their counts as weights."""
    p = lexical.length_postings(texts(spark, d)).select("id", F.col("size").alias("index"), F.col("tf").cast("float").alias("weight"))
    return p.groupBy("id").agg(V.sparse_from_pairs(F.collect_list(F.struct("index", "weight"))).alias("sparse"))


@query(f"""WITH p AS ({SPARSE}), q(idx, w) AS (VALUES (2, 1.0), (7, 0.5), (19, 4.0)), s AS (SELECT id, sum(weight * w) AS score FROM p JOIN q USING (idx) GROUP BY id)
SELECT CAST(0 AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 10""")
def sparse_topk(spark, d):
    q = spark.createDataFrame([(0, 2, 1.0), (0, 7, 0.5), (0, 19, 4.0)], "query_id long, idx long, weight double")
    return _out(lexical.sparse_search(lexical.sparse_postings(_sparse_points(spark, d)), q, 10))


@query(f"WITH p AS MATERIALIZED ({SPARSE}) SELECT a.id AS a, b.id AS b, round(sum(a.weight * b.weight), 6) AS product FROM p a JOIN p b ON a.idx = b.idx WHERE CAST(a.id AS BIGINT) % 20 = 0 GROUP BY 1, 2")
def sparse_dot_pairs(spark, d):
    """Documents whose id is divisible by 20 with all documents that share an index, by matrix products."""
    p, n = _sparse_points(spark, d), _t(spark, d, "documents").count()
    found = lexical.sparse_pairs(p.where("cast(id as long) % 20 = 0"), p, -(-n * n // (20 * lexical.TASK_PAIRS)))
    return found  # of counts: whole numbers, nothing to round


@query(f"""WITH p AS MATERIALIZED ({SPARSE}) SELECT a.id AS id, round(sum(a.weight * a.weight), 6) AS product FROM p a GROUP BY 1""")
def sparse_dot_expression(spark, d):
    """Each document with itself, by the expression on two sparse vectors."""
    return _sparse_points(spark, d).select("id", F.round(V.sparse_dot(F.col("sparse"), F.col("sparse")), 6).alias("product"))


def _fusion_lists(spark, d, k=20):
    h, q = hybrid(spark, d), asked(spark, d)
    dense_hits = dense.batch(h, q, Metric.COSINE, k)
    return dense_hits, lexical.bm25_search(texts(spark, d), q.select("query_id", F.lit("The idiot, released").alias("text")), k)


FUSION = f"""{bm25_sql(ASK, 20)}, lx AS (SELECT q.query_id, bm.id, bm.score, bm.rank FROM bm, ({Q_SQL}) q),
ds AS (SELECT query_id, id, list_cosine_similarity(v, q) AS score FROM ({E_SQL}) JOIN documents ON CAST(doc_id AS VARCHAR) = id, ({Q_SQL})),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= 20)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
RRF = f"WITH {FUSION}, u AS (SELECT query_id, id, rank FROM dn UNION ALL SELECT query_id, id, rank FROM lx), f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM u GROUP BY query_id, id), r AS (SELECT query_id, id, score, {RANK} AS rank FROM f)"
HITS = "query_id, id, round(score, 6) AS score"


@query(f"{RRF} SELECT {HITS}, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def hybrid_rrf(spark, d):
    return _out(topk.rrf(list(_fusion_lists(spark, d)), 10))


@query(f"WITH {FUSION} SELECT {HITS}, CAST(rank AS INT) AS rank FROM dn WHERE rank <= 10")
def hybrid_rrf_single_list(spark, d):
    dense_hits, other = _fusion_lists(spark, d)
    return _out(topk.rrf([dense_hits, other.where("false")], 10))


@query(f"{RRF}, t AS (SELECT * FROM r WHERE rank <= 10) SELECT {HITS}, CAST({RANK} AS INT) AS rank FROM t JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE lang = 'en'")
def hybrid_rrf_filtered(spark, d):
    hits = topk.rrf(list(_fusion_lists(spark, d)), 10)
    passed = _t(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"))
    return _out(topk.ranked(hits.drop("rank").join(passed, "id", "left_semi"), 10))


SPAN = "(score - min(score) OVER w) / greatest(max(score) OVER w - min(score) OVER w, 1e-6)"


def weighted_sql(alpha: float) -> str:
    return f"""WITH {FUSION}, n AS (SELECT query_id, id, {alpha} * {SPAN} AS s FROM dn WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, id, {1 - alpha} * {SPAN} FROM lx WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, id, sum(s) AS score FROM n GROUP BY query_id, id) SELECT {HITS}, CAST({RANK} AS INT) AS rank FROM f QUALIFY {RANK} <= 10"""


@query(weighted_sql(0.5))
def hybrid_weighted(spark, d):
    a, b = _fusion_lists(spark, d)
    return _out(topk.weighted(a, [b], 0.5, 10))


@query(weighted_sql(0.75))
def hybrid_weighted_dense(spark, d):
    a, b = _fusion_lists(spark, d)
    return _out(topk.weighted(a, [b], 0.75, 10))


@query(f"""WITH {FUSION}, l AS (SELECT query_id, id, score, 0 AS n FROM dn UNION ALL SELECT query_id, id, score, 1 FROM lx),
m AS (SELECT query_id, id, n, {SPAN} AS s FROM l WINDOW w AS (PARTITION BY query_id)), o AS (SELECT query_id, id, arg_max(s, n) AS score FROM m GROUP BY query_id, id)
SELECT {HITS}, CAST({RANK} AS INT) AS rank FROM o QUALIFY {RANK} <= 10""")
def hybrid_weighted_lexical_concat(spark, d):
    a, b = _fusion_lists(spark, d)
    return _out(topk.weighted(a.where("false"), [a, b], 0.0, 10))


@query(f"""WITH s AS (SELECT query_id, id, {SCORES['cosine']} AS score FROM ({E_SQL}), ({Q_SQL}))
SELECT query_id, id, round({SPAN}, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id)""")
def minmax_normalize(spark, d):
    return dense.pairs(points(spark, d), asked(spark, d), Metric.COSINE, 6, normal=True)


@query(dense_sql())
def shard_merge_topk(spark, d):
    p = points(spark, d)
    return _out(topk.merge_top_k([dense.exact(p.where(F.expr(f"pmod(cast(id as long), 4) = {part}")), asked(spark, d), Metric.COSINE, 20) for part in range(4)], 10))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings WHERE CAST(vec_id AS VARCHAR) > '25' ORDER BY 1 LIMIT 33")
def scroll_page(spark, d):
    p = points(spark, d).where(F.col("id") > "25").orderBy("id").limit(33)
    return p.select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(len(embedding) AS INT) AS dimension FROM embeddings WHERE vec_id = 42")
def get_point(spark, d):
    return points(spark, d).where("id = '42'").select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"), F.size("values").alias("dimension"))


def _log(spark, d):
    """Three rounds over the embeddings: all upserted, thirds upserted again, sevenths deleted."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), "label")
    first = e.select(F.col("vec_id").alias("seq"), F.lit("upsert").alias("op"), "id", F.col("label").alias("value"))
    again = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("seq"), F.lit("upsert").alias("op"), "id", (F.col("label") + 100).alias("value"))
    gone = e.where("vec_id % 7 = 0").select((F.col("vec_id") + 999_990).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("int").alias("value"))
    return first.unionByName(again).unionByName(gone)


LOG = """l AS (SELECT vec_id AS seq, 'upsert' AS op, CAST(vec_id AS VARCHAR) AS id, label AS value FROM embeddings
UNION ALL SELECT vec_id + 1000000, 'upsert', CAST(vec_id AS VARCHAR), label + 100 FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id + 999990, 'delete', CAST(vec_id AS VARCHAR), NULL FROM embeddings WHERE vec_id % 7 = 0),
fold AS (SELECT id, op, value FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


@query(f"WITH {LOG} SELECT id, value FROM fold WHERE op = 'upsert'")
def upsert_fold_lww(spark, d):
    return mutations.fold(_log(spark, d)).select("id", "value")


@query(f"WITH {LOG} SELECT DISTINCT id FROM l WHERE id NOT IN (SELECT id FROM fold WHERE op = 'upsert')")
def delete_tombstones(spark, d):
    log = _log(spark, d)
    return log.select("id").distinct().join(mutations.fold(log).select("id"), "id", "left_anti")


@query(f"WITH {LOG} SELECT (SELECT count(*) FROM l) AS entries_before, count(*) AS live, CAST(ceil(count(*) / 50.0) AS BIGINT) AS entries_after FROM fold WHERE op = 'upsert'")
def compact_stats(spark, d):
    return mutations.log_stats(_log(spark, d), 50)


@query("SELECT chunk, count(*) AS points, min(id) AS first_id, max(id) AS last_id FROM (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(floor((row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) - 1) / 64) AS INT) AS chunk FROM embeddings) GROUP BY chunk")
def bulk_chunks(spark, d):
    return mutations.numbered_chunks(points(spark, d).select("id"), 64).groupBy("chunk").agg(F.count(F.lit(1)).alias("points"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT 'embeddings' AS name, count(*) AS count, CAST(max(len(embedding)) AS INT) AS dimension, 'cosine' AS metric FROM embeddings")
def describe_collection(spark, d):
    return points(spark, d).agg(F.lit("embeddings").alias("name"), F.count(F.lit(1)).alias("count"), F.max(F.size("values")).alias("dimension"), F.lit("cosine").alias("metric"))


@query("SELECT DISTINCT source AS name FROM documents")
def list_collections(spark, d):
    """The union over shards of what each lists."""
    parts = [_t(spark, d, "documents").where(F.expr(f"pmod(doc_id, 3) = {n}")).select(F.col("source").alias("name")) for n in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


DIMS = "SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings"


@query(f"SELECT CAST(dim AS INT) AS dim, min(x) AS low, max(x) AS high FROM ({DIMS}) GROUP BY dim")
def quantize_train(spark, d):
    return quantize.bounds(points(spark, d))


CODES = f"WITH x AS ({DIMS}), b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM x GROUP BY dim), c AS (SELECT id, dim, x, lo, hi, CAST(round(least(greatest((x - lo) / greatest(hi - lo, 1e-8), 0), 1) * 255) AS INT) AS code FROM x JOIN b USING (dim))"


@query(f"{CODES} SELECT id, CAST(dim AS INT) AS dim, code FROM c")
def quantize_encode(spark, d):
    return quantize.codes(points(spark, d)).select("id", "dim", "code")


@query(f"{CODES} SELECT CAST(dim AS INT) AS dim, round(max(abs(lo + code / 255.0::DOUBLE * (hi - lo) - x)), 6) AS worst FROM c GROUP BY dim")
def quantize_decode(spark, d):
    return quantize.codes(points(spark, d)).groupBy("dim").agg(F.round(F.max(F.abs(F.col("decoded") - F.col("x"))), 6).alias("worst"))


@query(f"""WITH x AS ({DIMS}), b AS (SELECT id, dim, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM x WINDOW w AS (PARTITION BY dim ORDER BY vec_id))
SELECT id, CAST(dim AS INT) AS dim, CAST(round(least(greatest((x - lo) / greatest(hi - lo, 1e-8), 0), 1) * 255) AS INT) AS code FROM b""")
def quantize_online(spark, d):
    return quantize.online_codes(points(spark, d).withColumn("seq", F.col("id").cast("long")))


@query(f"""WITH s AS (SELECT query_id, id, label, {SCORES['cosine']} AS score FROM ({E_SQL}), ({Q_SQL}) WHERE id <> CAST(query_id AS VARCHAR)),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 15) SELECT query_id, label, count(*) AS votes FROM t GROUP BY 1, 2""")
def knn_label_vote(spark, d):
    """An extension: labels among a vector's neighbours."""
    hits = dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 16).where(F.col("id") != F.col("query_id").cast("string"))
    hits = topk.ranked(hits.drop("rank"), 15)
    labels = points(spark, d).select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))
    return hits.join(labels, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))


@query(f"""WITH s AS (SELECT query_id, id, {SCORES['cosine']} AS score FROM ({E_SQL}), ({Q_SQL})), t AS (SELECT query_id, id FROM s QUALIFY {RANK} <= 10)
SELECT 1.0::DOUBLE AS recall, count(*) AS neighbours, md5(string_agg(query_id || ':' || id, ',' ORDER BY query_id || ':' || id)) AS digest FROM t""")
def recall_ground_truth(spark, d):
    """The true neighbours, and the share of them that matrix blocks find."""
    truth = dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 10)
    found = dense.recall(truth, dense.batch(points(spark, d), asked(spark, d), Metric.COSINE, 10), 10)
    named = F.array_sort(F.collect_list(F.concat(F.col("query_id").cast("string"), F.lit(":"), "id")))
    return found.crossJoin(truth.agg(F.count(F.lit(1)).alias("neighbours"), F.md5(F.array_join(named, ",").cast("binary")).alias("digest")))


#: What the index is registered with.
IVF_LISTS, IVF_PROBES = 16, 10


@query()
def ann_ivf_topk(spark, d):
    return _out(dense.Ivf.build(points(spark, d), IVF_LISTS).search(asked(spark, d), 10, IVF_PROBES))


@query()
def ann_ivf_recall(spark, d):
    """Of the true neighbours, the share that the index finds."""
    truth = dense.batch(points(spark, d), asked(spark, d), Metric.COSINE, 10)
    return dense.recall(truth, ann_ivf_topk(spark, d), 10)


WORDS = "list_distinct(regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{N}}_]+)', 1))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, round(len(list_intersect(['the', 'idiot', 'and', 'la'], {WORDS.format('text')})) / 4.0, 6) AS overlap FROM documents")
def rag_overlap(spark, d):
    return texts(spark, d).select("id", F.round(T.overlap(F.lit("The idiot and la"), F.col("text")), 6).alias("overlap"))


@query(f"""WITH {bm25_sql(ASK, 10)}, o AS (SELECT query_id, id, score, score + len(list_intersect(['the', 'idiot', 'released'], {WORDS.format('text')})) / 3.0 AS reranked FROM bm JOIN documents ON CAST(doc_id AS VARCHAR) = id)
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, round(reranked, 6) AS reranked, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, id) AS INT) AS rank FROM o""")
def rag_overlap_rerank(spark, d):
    hits = lexical.bm25_search(texts(spark, d), words(spark, [(0, "the idiot released")]), 10).drop("rank")
    placed = rag.rerank(hits.join(texts(spark, d), "id").withColumn("query", F.lit("the idiot released")))
    return placed.select("query_id", "id", F.round("score", 6).alias("score"), F.round("reranked", 6).alias("reranked"), "rank")


@query(f"""WITH s AS (SELECT query_id // 60 AS query_id, query_id // 20 % 3 AS variant, id, {SCORES['cosine']} AS score FROM ({E_SQL}), ({Q_SQL})),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY query_id, id HAVING count(*) > 0),
n AS (SELECT query_id FROM s GROUP BY query_id HAVING count(DISTINCT variant) = 3)
SELECT {HITS}, CAST({RANK} AS INT) AS rank FROM f JOIN n USING (query_id) QUALIFY {RANK} <= 10""")
def rag_multi_query_rrf(spark, d):
    """Queries in threes, as three variants of one."""
    hits = dense.exact(points(spark, d), asked(spark, d), Metric.COSINE, 20)
    own = hits.select(F.floor(F.col("query_id") / 60).alias("of"), F.pmod(F.floor(F.col("query_id") / 20), F.lit(3)).alias("variant"), "id", "score")
    whole = own.groupBy("of").agg(F.count_distinct("variant").alias("n")).where("n = 3").select("of")
    lists = [own.join(whole, "of").where(F.col("variant") == n).select(F.col("of").alias("query_id"), "id", "score") for n in range(3)]
    return _out(topk.rrf(lists, 10))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS digest FROM documents")
def normalize_whitespace(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunk_sql(size: int = 512, shared: int = 64) -> str:
    """Chunks one after another: a window, cut back to its last space past the start; idx counts those that aren't blank."""
    def stop(at):
        window = f"substr(t, {at} + 2, {size} - 1)"  # past the start
        return f"CASE WHEN {at} + {size} >= n THEN n WHEN strpos({window}, ' ') > 0 THEN {at} + {size} - strpos(reverse({window}), ' ') ELSE {at} + {size} END"

    following = f"greatest(stop - {shared}, spot + 1)"
    return f"""x AS (SELECT CAST(doc_id AS VARCHAR) AS id, trim(text, {BLANK}) AS t FROM documents), y AS (SELECT id, t, len(t) AS n FROM x WHERE t <> ''),
    c(id, t, n, spot, stop) AS (SELECT id, t, n, 0, {stop('0')} FROM y UNION ALL SELECT id, t, n, {following}, {stop(following)} FROM c WHERE stop < n),
    p AS (SELECT id, spot, trim(substr(t, spot + 1, stop - spot), {BLANK}) AS piece FROM c), k AS (SELECT id, piece, row_number() OVER (PARTITION BY id ORDER BY spot) - 1 AS idx FROM p WHERE piece <> '')"""


@query(f"WITH RECURSIVE {chunk_sql()} SELECT id || '#' || idx AS id, CAST(len(piece) AS INT) AS chars, md5(piece) AS digest FROM k")
def chunk_text(spark, d):
    rows = texts(spark, d).select("id", F.explode(T.chunks(F.col("text"))).alias("c"))
    return rows.select(F.concat_ws("#", "id", "c.idx").alias("id"), F.char_length("c.text").alias("chars"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


@query(f"WITH RECURSIVE {chunk_sql()} SELECT id || '#' || idx AS id, 64 AS dimension, id AS document_id, CAST(idx AS VARCHAR) AS chunk_index, md5(piece) AS digest FROM k")
def rag_ingest(spark, d):
    """Chunks as points: their vectors are checked by hash_embed's test."""
    found = rag.chunk_points(texts(spark, d), 64)
    field = lambda key: F.get_json_object("payload", f"$.{key}")
    return found.select("id", F.size("values").alias("dimension"), field("document_id").alias("document_id"), field("chunk_index").alias("chunk_index"), F.md5(field("text").cast("binary")).alias("digest"))


@query()
def hash_embed(spark, d):
    return texts(spark, d).select("id", T.embedder(64)("text").alias("values"))


@query()
def shard_assignment(spark, d):
    return points(spark, d).select("id", shard_column(F.col("id"), 4).alias("shard"))


@query()
def rebalance_plan(spark, d):
    return plan_rebalance(points(spark, d), 4, 5)


@query("""WITH v AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT round((SELECT avg(value) FROM events), 6) AS avg, max(CASE WHEN i = round((n - 1) * 0.5) THEN x END) AS p50, max(CASE WHEN i = round((n - 1) * 0.95) THEN x END) AS p95, max(CASE WHEN i = round((n - 1) * 0.99) THEN x END) AS p99 FROM v""")
def latency_percentiles(spark, d):
    return mutations.latency_summary(_t(spark, d, "events"), "value").withColumn("avg", F.round("avg", 6))


def _vector(spark, d, id: int = 0) -> list[float]:
    return [float(x) for x in _t(spark, d, "embeddings").where(F.col("vec_id") == id).first().embedding]


def _searched(spark, d, **request) -> DataFrame:
    """One request through the engine's search, over vectors with their documents' text and language."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    rows = _t(spark, d, "embeddings").join(docs, "vec_id").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_json(F.struct("label", "lang", "text")).alias("payload"), F.lit(None).cast("struct<indices:array<bigint>,values:array<float>>").alias("sparse"))
    return _out(run_search(rows, CollectionConfig("vectors", 64, bm25_text_field="text"), SearchRequest(**request)))


#: Queries over the documents that have a vector alone, and for vector 0 alone.
def _joined(sql: str) -> str:
    return sql.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))").replace(Q_SQL, Q_SQL.replace("vec_id % 20 = 0", "vec_id = 0"))


@query(_joined(dense_sql(where="label IN (1, 4) OR label >= 7")))
def search_dense_wire_filter(spark, d):
    rule = {"should": [{"key": "label", "any_of": {"any": [1, 4]}}, {"filter": {"must": [{"key": "label", "range": {"gte": 7}}, {"key": "label", "exists": {"exists": True}}], "must_not": [{"key": "lang", "match": {"value": "none"}}]}}]}
    return _searched(spark, d, vector=_vector(spark, d), filter=rule)


@query(_joined(f"WITH {bm25_sql(ASK, 20)} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM bm JOIN documents ON CAST(doc_id AS VARCHAR) = id WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"))
def search_bm25_filtered(spark, d):
    return _searched(spark, d, text="The idiot, released", mode="lexical", filter={"must": [{"key": "lang", "match": {"value": "en"}}]})


@query(_joined(f"{RRF} SELECT {HITS}, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"))
def search_hybrid_rrf(spark, d):
    return _searched(spark, d, vector=_vector(spark, d), text="The idiot, released", mode="hybrid")


@query(_joined(weighted_sql(0.75)))
def search_hybrid_weighted(spark, d):
    return _searched(spark, d, vector=_vector(spark, d), text="The idiot, released", mode="weighted", alpha=0.75)


def _scratch(spark) -> str:
    """A new folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{root or 'file://' + tempfile.mkdtemp(prefix='vexel-')}/engine-{uuid.uuid4().hex}"


def _stored(spark, d) -> Engine:
    """A collection after upserts, a compaction, upserts of thirds anew and deletes of sevenths."""
    engine = Engine(spark, _scratch(spark))
    engine.create_collection("vectors", 64, payload_indexes={"label": "numeric", "lang": "keyword"}, bm25_text_field="text")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    rows = _t(spark, d, "embeddings").join(docs, "vec_id")
    point = lambda df, label: df.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), F.to_json(F.struct(label.alias("label"), "lang", "text")).alias("payload"))
    engine.bulk_upsert("vectors", point(rows, F.col("label")))
    engine.compact("vectors")
    engine.bulk_upsert("vectors", point(rows.where("vec_id % 3 = 0"), F.col("label") + 100))
    engine.store.append("vectors", "delete", rows.where("vec_id % 7 = 0").select(F.col("vec_id").cast("string").alias("id")))
    return engine


LIVE = "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id IN (SELECT doc_id FROM documents)"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS INT) AS label FROM ({LIVE})")
def engine_live_points(spark, d):
    return _stored(spark, d).store.points("vectors").select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@query(f"SELECT 'vectors' AS name, count(*) AS count, 64 AS dimension, 'cosine' AS metric FROM ({LIVE})")
def engine_describe(spark, d):
    engine = _stored(spark, d)
    found = [engine.describe(name) for name in engine.list_collections()]
    return spark.createDataFrame([(r["name"], r["count"], r["dimension"], r["metric"]) for r in found], "name string, count long, dimension int, metric string")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS INT) AS label FROM ({LIVE}) WHERE label >= 104 AND vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr'))")
def engine_indexed_filter(spark, d):
    """A filter whose bounds on the index columns reach the base's scan."""
    from .plans.filters import index_bounds

    engine = _stored(spark, d)
    rule = {"must": [{"key": "label", "range": {"gte": 104}}, {"key": "lang", "any_of": ["en", "fr"]}]}
    near = engine.store.points("vectors").where(index_bounds(rule, engine.store.config("vectors").payload_indexes))
    return near.where(compile_filter(rule, payload_variant(F.col("payload")))).select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"))


@query(f"WITH {bm25_sql(ASK, 20)} {BM_OUT} WHERE rank <= 10".replace("FROM documents", f"FROM (SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM ({LIVE.replace('FROM documents', 'FROM documents AS x')})))"))
def engine_stored_bm25(spark, d):
    """BM25 from the base's postings and those of what changed since."""
    return _out(_stored(spark, d).search("vectors", text="The idiot, released", mode="bm25"))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id FROM ({LIVE}) WHERE CAST(vec_id AS VARCHAR) > '25' ORDER BY 1 LIMIT 40")
def engine_scroll(spark, d):
    engine, cursor, found = _stored(spark, d), "25", []
    for _ in range(4):
        rows, cursor = engine.scroll("vectors", cursor, 10)
        found += [(r.id,) for r in rows]
        if not cursor:
            break
    return spark.createDataFrame(found, "id string")
