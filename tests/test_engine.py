import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel import catalogue
from vexel.engine import Engine
from vexel.functions import ring
from vexel.functions import text as T
from vexel.functions import vectors as V
from vexel.operators import dense, lexical, mutations, rag, topk
from vexel.plans.filters import compile_filter, index_columns, index_numbers, index_tokens, parse_filter, payload_variant
from vexel.sources.store import Store, read_points
from vexel.types import CollectionExists, IndexKind, InvalidRequest, Metric, PointNotFound

SHIP = {"name": "Aurora", "masts": 3, "length": 41.25, "ports": ["Oslo", "Cork", "Faro"], "sails": True, "captain": {"born": 1801, "home": {"town": "Cork"}}, "note": None, "depths": [[4, [2.5]], "7"]}


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ({}, True),
        ({"must": [{"key": "name", "match": "Aurora"}, {"key": "masts", "match": 3.0}]}, True),
        ({"must": [{"key": "name", "match": {"value": "Aurora"}}]}, True),
        ({"must": [{"key": "name", "match": {"value": "aurora"}}]}, False),
        ({"must": [{"key": "ports", "match": {"value": "Cork"}}]}, True),
        ({"must": [{"key": "sails", "match": {"value": True}}], "must_not": [{"key": "sails", "match": False}]}, True),
        ({"must": [{"key": "note", "match": {"value": None}}, {"key": "note", "exists": {"exists": False}}]}, True),
        ({"must": [{"key": "ports", "any_of": {"any": ["Rome", "Faro"]}}]}, True),
        ({"must": [{"key": "masts", "any_of": [1, 2]}]}, False),
        ({"must": [{"key": "masts", "any_of": {"any": []}}]}, False),
        ({"must": [{"key": "length", "range": {"gt": 41, "lte": 41.25}}]}, True),
        ({"must": [{"key": "length", "range": {"lt": 41.25}}]}, False),
        ({"must": [{"key": "length", "range": {}}, {"key": "length", "range": {"gte": None}}]}, True),
        ({"must": [{"key": "name", "range": {"gte": 0}}]}, False),
        ({"must": [{"key": "captain.home.town", "exists": {"exists": True}}, {"key": "captain.ship", "exists": False}]}, True),
        ({"must": [{"key": "captain", "match": {"value": {"home": {"town": "Cork"}, "born": 1801}}}]}, True),
        ({"must_not": [{"key": "captain.born", "range": {"gte": 1801}}]}, False),
        ({"should": [{"key": "masts", "match": 4}, {"filter": {"must_not": [{"key": "name", "match": {"value": "Terra"}}]}}]}, True),
        ({"should": [{"key": "masts", "match": 4}, {"must": [{"key": "sails", "match": False}]}]}, False),
    ],
)
def test_filter(spark, rule, want):
    df = spark.createDataFrame([(json.dumps(SHIP),)], "p string")
    assert df.select(compile_filter(rule, payload_variant(F.col("p")))).first()[0] is want
    assert df.select(compile_filter(json.dumps(rule), payload_variant(F.col("p")))).first()[0] is want


@pytest.mark.parametrize(
    "rule",
    ["[1]", "{", '{"also": []}', {"must": {"key": "a"}}, {"must": [3]}, {"must": [{"match": 1}]}, {"must": [{"key": "a"}]}, {"must": [{"key": "a", "match": 1, "exists": True}]}, {"must": [{"key": "a", "match": {"values": 1}}]}, {"must": [{"key": "a", "any_of": 3}]}, {"must": [{"key": "a", "any_of": {"all": []}}]}, {"must": [{"key": "a", "exists": "yes"}]}, {"must": [{"key": "a", "range": {"min": 1}}]}, {"must": [{"key": "a", "range": {"gte": "1"}}]}, {"must": [{"filter": {"nope": 1}}]}],
)
def test_malformed_filters_are_refused(rule):
    with pytest.raises(InvalidRequest):
        parse_filter(rule)


def test_rows_without_a_payload(spark):
    df = spark.createDataFrame([(None,), ("no JSON",)], "p string")
    rule = {"must_not": [{"key": "deck", "match": 1}]}
    assert [r[0] for r in df.select(compile_filter(rule, payload_variant(F.col("p")))).collect()] == [False, True]


def test_index_tokens_and_columns(spark):
    df = spark.createDataFrame([(json.dumps(SHIP),), ('{"masts": "x"}',), (None,)], "p string")
    v = payload_variant(F.col("p"))
    field = lambda path: F.try_variant_get(v, path, "variant")
    first = df.select(index_tokens(field("$.ports")), index_tokens(field("$.depths")), index_numbers(field("$.depths")), index_tokens(field("$.captain"))).first()
    assert [list(x) for x in first] == [["Oslo", "Cork", "Faro"], ["4", "2.5", "7"], [4.0, 2.5], []]
    found = df.select(*[c.alias(n) for n, c in index_columns(v, {"masts": IndexKind.NUMERIC, "ports": IndexKind.KEYWORD, "sails": IndexKind.BOOL}).items()]).collect()
    assert [tuple(r) for r in found] == [(3.0, 3.0, "Cork", "Oslo", "true", "true"), (None,) * 6, (None,) * 6]


def bm25(texts, query, k):
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    docs = {i: split(t) for i, t in texts}
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    for term, times in Counter(split(query)).items():
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(term):
                out[i] = out.get(i, 0) + times * math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / max(mean, 1)))
    return sorted(((i, round(s, 6)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))[:k]


def test_bm25_and_fusion(spark, monkeypatch):
    pick = random.Random(2)
    texts = [(f"t{k:02}", " ".join(pick.choice("tide moon salt rope Wind keel".split()) for _ in range(pick.randrange(1, 12)))) for k in range(40)]
    docs, ask = spark.createDataFrame([*texts, ("none", None)], "id string, text string"), "Wind and tide, wind"
    search = lambda: [(r.id, round(r.score, 6)) for r in lexical.bm25_search(docs, spark.createDataFrame([(0, ask)], "query_id long, text string"), 7).orderBy("rank").collect()]
    assert search() == bm25(texts, ask, 7)
    monkeypatch.setattr(lexical, "FEW_TERMS", 1)
    assert search() == bm25(texts, ask, 7)
    one = spark.createDataFrame([(0, "p", 9.0), (0, "q", 4.0), (1, "p", 2.5)], "query_id long, id string, score double")
    two = spark.createDataFrame([(0, "q", 0.3), (0, "r", 0.2)], "query_id long, id string, score double")
    fused = {(r.query_id, r.id): r.score for r in topk.rrf([one, two], 5).collect()}
    assert fused == {(0, "p"): 1 / 61, (0, "q"): 1 / 62 + 1 / 61, (0, "r"): 1 / 62, (1, "p"): 2.5}


def plain_chunks(text, size, shared):
    text, out, at = text.strip(), [], 0
    while text:
        end = min(at + size, len(text))
        if end < len(text):
            end = max([i for i in range(at + 1, end) if text[i] == " "], default=end)
        out += [text[at:end].strip()] * bool(text[at:end].strip())
        if end == len(text):
            break
        at = max(end - shared, at + 1)
    return out


def test_chunks_against_a_plain_loop():
    pick = random.Random(4)
    texts = ["", "  ", "x" * 70, " a " * 30, *("".join(pick.choice("ab é\n ") for _ in range(pick.randrange(120))) for _ in range(150))]
    for t in texts:
        for size, shared in ((9, 4), (1, 0), (6, 8), (40, 39), (500, 10)):
            assert T.chunk_text(t, size, shared) == plain_chunks(t, size, shared)
    assert T.chunk_text(None) == []
    with pytest.raises(ValueError):
        T.chunk_text("a", 0)


def test_page_chunks(spark):
    # without white space an end moves back to four fifths; a space between pages belongs to the one before
    got = T.chunk_pages(["y" * 130, "", "z z"], 100, 30)
    assert [(c["page"], c["char_start"], c["char_end"], len(c["text"])) for c in got] == [(1, 0, 80, 80), (1, 70, 134, 64)]
    words = T.chunk_pages(["ab " * 40, "cd\n\n " * 40], 100, 0)
    assert [c["page"] for c in words] == [1, 1, 2] and all(c["char_end"] - c["char_start"] >= 80 for c in words[:-1]) and [c["idx"] for c in words] == [0, 1, 2]
    assert T.chunk_pages([]) == T.chunk_pages(["", " "]) == [] and T.chunk_pages(["q" * 130], 5, 900)[0]["char_end"] == 80
    pages = spark.createDataFrame([("log", 3, "cd " * 60), ("log", 1, "ab " * 60), ("none", 1, None)], "id string, page int, text string")
    points = rag.page_points(pages, 16, "body", 100, 10).orderBy("id").collect()
    first = json.loads(points[0].payload)
    assert points[0].id == "log-00000" and (first["source"], first["chunk"], first["page"], first["char_start"]) == ("log", 0, 1, 0) and first["body"].startswith("ab ab")
    assert json.loads(points[-1].payload)["page"] == 3 and all(len(p.values) == 16 for p in points)


def plain_embedding(text, dimension):
    out, found = [0.0] * dimension, re.findall("[a-z0-9_]+", text.lower())

    def add(weight, *parts):
        h = 5381
        for c in "\t".join(parts):
            h = (h * 33 + ord(c)) % (1 << 32)
        out[h % dimension] += weight

    for k, w in enumerate(found):
        add(1.0, "u", w)
        for i in range(len(w) - 2):
            add(0.3, "c", w[i : i + 3])
        if k:
            add(0.7, "b", found[k - 1], w)
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_embeddings_against_a_plain_loop(spark):
    pick = random.Random(5)
    texts = ["", "!", "one", "One two", "É_9 zz", *(" ".join("".join(pick.choice("abcXY_3é-") for _ in range(pick.randrange(1, 9))) for _ in range(pick.randrange(25))) for _ in range(80))]
    want = np.array([plain_embedding(t, 48) for t in texts])
    assert np.abs(T.hash_embeddings(texts, 48) - want).max() < 1e-12
    got = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").select("k", T.embedder(48)("t").alias("v")).orderBy("k").collect()
    assert np.abs(np.array([r.v for r in got[:-1]]) - want).max() < 1e-6 and not any(got[-1].v)
    assert (T.embed_strategy(768), T.embed_strategy(64), T.embed_strategy(0)) == ("model", "hash", "hash")


def test_query_variants(spark):
    asked = ["  Salt AND the Sea ", "up to it", "", "Tide", "lower case words"]
    got = [r[0] for r in spark.createDataFrame([(q,) for q in asked], "q string").select(T.expand_query(F.col("q"))).collect()]
    assert got == [["Salt AND the Sea", "salt and the sea"], ["up to it"], [], ["Tide", "tide"], ["lower case words"]]
    assert spark.createDataFrame([("Of Salt or Sea",)], "q string").select(T.expand_query(F.col("q"))).first()[0] == ["Of Salt or Sea", "of salt or sea", "Salt Sea"]


def test_ring_and_routes(spark):
    keys = [f"k{n}" for n in range(300)] + ["", "é", None]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ring.shard_column(F.col("k"), 5).alias("s")).collect()
    assert all(r.s == (None if r.k is None else ring.shard_of(r.k, 5)) for r in got) and {r.s for r in got if r.k} == set(range(5))
    shard = ring.shard_of("k1", 3)
    assert ring.route("k1", 3, ["n0", "n1"]) == (shard, f"n{shard % 2}") and ring.route("k1", 3, [], {shard: ["z"]}) == (shard, "z") and ring.route("k1", 3, []) == (shard, None)
    assert ring.replicas(2, {"a": [1], "b": [], "c": [0, 1]}) == {0: ["c", "b"], 1: ["a", "c", "b"]}
    rows = spark.createDataFrame([("x", 0, 1), ("x", 1, 1), ("y", 0, None)], "collection string, shard_from int, shard_to int")
    assert {r.collection: (r.moved, r.kept, r.failed) for r in ring.rebalance_report(rows).collect()} == {"x": (1, 1, 0), "y": (0, 0, 1), None: (1, 1, 1)}


def test_histogram_and_merge_by_id(spark):
    rows = spark.createDataFrame([(0.5,), (2.0,), (9.0,), (None,)], "x double")
    assert [tuple(r) for r in mutations.histogram(rows, "x", [2, 1]).collect()] == [(1.0, 1, 0.5), (2.0, 2, 2.5), (None, 3, 11.5)]
    a, b = (spark.createDataFrame(r, "id string, address string") for r in ([("n", "old"), ("m", "one")], [("n", "new"), ("o", None)]))
    assert sorted(map(tuple, mutations.merged_by_id(a, b).collect())) == [("m", "one"), ("n", "new"), ("o", None)]


def test_ivf_recall(spark, sf):
    p = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"))
    q = p.limit(40).select(F.col("id").cast("long").alias("query_id"), F.col("values").alias("query"))
    truth = dense.exact(p, q, "cosine", 10)
    assert dense.recall(truth, dense.Ivf.build(p, 8).search(q, 10, 7), 10).first()[0] >= 0.9
    assert dense.recall(truth, dense.batch(p, q, "cosine", 10), 10).first()[0] == 1


def test_many_queries_leave_the_broadcast(spark, monkeypatch):
    p = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(30)], "id string, values array<float>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "query_id long, query array<double>")
    few = sorted(map(tuple, dense.exact(p, q, "dot", 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    assert sorted(map(tuple, dense.exact(p, q, "dot", 3).select("query_id", "id", "rank").collect())) == few


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_equal_vectors_tie_wherever_they_stand(spark, monkeypatch, metric):
    pick = np.random.default_rng(1)
    few = pick.normal(size=(12, 61))
    p = spark.createDataFrame([(f"{k:03}", few[k % 12].tolist()) for k in range(240)], "id string, values array<double>").repartition(3)
    q = spark.createDataFrame([(20 * k, few[k].tolist()) for k in range(12)] + [(240 + 20 * k, pick.normal(size=61).tolist()) for k in range(9)], "query_id long, query array<double>")
    scores = dense._own_scores(*(np.array(x) for x in zip(*((a.query, few[c]) for a in q.collect() for c in range(12)))), Metric.parse(metric)).reshape(21, 12)
    want = [(r.query_id, rank + 1, i) for r, s in zip(q.collect(), scores) for rank, (_, i) in enumerate(sorted((-s[k % 12], f"{k:03}") for k in range(240))[:30])]
    for rows in (7, 13, 1024):
        monkeypatch.setattr(dense, "ROW_BLOCK", rows)
        assert sorted(map(tuple, dense.batch(p, q, metric, 30, block=8).select("query_id", "rank", "id").collect())) == sorted(want)


def test_hits_of_all_blocks_of_queries_are_ranked_at_once(spark):
    p = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(30)], "id string, values array<float>")
    q = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "query_id long, query array<double>")
    hits = dense.batch(p, q, "dot", 3, block=4)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 3 and len(re.findall(r"\bWindow \[", plan)) == 1
    assert sorted(map(tuple, hits.select("query_id", "id", "rank").collect())) == sorted(map(tuple, dense.batch(p, q, "dot", 3).select("query_id", "id", "rank").collect()))


def test_a_task_passes_on_the_best_of_all_its_blocks(spark, monkeypatch):
    p = spark.createDataFrame([(f"{k:02}", [float(min(k, 55)), 1.0]) for k in range(60)], "id string, values array<float>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 0.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0])], "query_id long, query array<double>")
    passed = []
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    monkeypatch.setattr(dense, "ranked", lambda hits, k: passed.append(hits.groupBy("query_id").count().orderBy("query_id").collect()) or topk.ranked(hits, k))
    every = sorted(map(tuple, dense.batch(p, q, "dot", 3).select("query_id", "rank", "id").collect()))
    assert [tuple(r) for r in passed[0]] == [(0, 5), (20, 3), (40, 60)]  # ties are kept
    assert [x[2] for x in every] == ["55", "56", "57", "00", "01", "02", "00", "01", "02"]
    monkeypatch.setattr(dense, "HELD_HITS", 0)
    assert sorted(map(tuple, dense.batch(p, q, "dot", 3).select("query_id", "rank", "id").collect())) == every


@pytest.mark.parametrize("name", ["hybrid_rrf", "hybrid_rrf_filtered", "hybrid_weighted", "hybrid_weighted_dense", "hybrid_weighted_lexical_concat"])
def test_queries_of_the_same_words_are_scored_once(spark, sf, monkeypatch, name):
    scored = []
    monkeypatch.setattr(lexical, "ranked", lambda hits, k, **more: scored.append(hits.count()) or topk.ranked(hits, k, **more))
    who = catalogue.QUERIES[name](spark, sf).select("query_id").distinct().count()
    assert who > 20 and 0 < sum(scored) <= spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["hybrid_rrf_filtered", "hybrid_weighted", "hybrid_weighted_dense", "hybrid_weighted_lexical_concat"])
def test_texts_are_looked_up_with_no_row_for_a_word(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "split(" not in plan


def test_texts_are_read_once_for_counts_and_scores(spark):
    texts = [(f"t{k:02}", "wind " * (k % 3) + "tide " * (k % 5) + "!") for k in range(40)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([*texts, ("none", None), ("empty", "")], "id string, text string").mapInArrow(seen, "id string, text string")
    asked = spark.createDataFrame([(0, "Wind tide"), (20, "tide")], "query_id long, text string")
    hits = lexical.bm25_search(docs, asked, 7).collect()
    assert read.value == 42
    for q, text in ((0, "Wind tide"), (20, "tide")):
        assert [(r.id, round(r.score, 6)) for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] == bm25([*texts, ("empty", "")], text, 7)


def test_terms_of_odd_texts(spark):
    pick = random.Random(6)
    odd = ["\u212a", "\u0130", "\u03a3\u0391\u03a3", "\u017ft", "a\u0301b", "\u2177", "\u24b6x", "\u0663\u0664", "\U0001d54f\U0001f600y", "_a_b", "\u1e9e", "\u0345", "x\u200dy", "\u00aa1", "the THE th\u00e9", "", " "]
    rows = [(str(k), " ".join(pick.choice(odd) for _ in range(pick.randrange(6))) + pick.choice(odd)) for k in range(300)] + [("none", None), (None, "the y"), ("long", "The a " * 400_000)]
    docs = spark.createDataFrame(rows, "id string, text string")
    every = lexical.term_postings(docs)
    some = every.select("term").distinct().orderBy("term").limit(lexical.FEW_TERMS)
    got = lambda x: sorted(map(repr, x.select("id", "length", "term", "tf").collect()))
    assert got(every.join(some, "term", "left_semi")) == got(lexical.wanted_postings(docs, some)) != []
    for d in (docs, docs.limit(0)):
        assert lexical.corpus_stats(d).collect() == lexical.length_stats(lexical.lengths(d)).collect()


def test_alike_and_other_queries_of_bm25(spark):
    pick = random.Random(5)
    texts = [(f"t{k:02}", " ".join(pick.choice("tide moon salt rope Wind keel".split()) for _ in range(pick.randrange(1, 12)))) for k in range(40)]
    asked = [(7, "Wind and tide, wind"), (3, "tide WIND wind and"), (9, "wind tide"), (1, "keel"), (5, "!!"), (2, "Keel?")]
    hits = lexical.bm25_search(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(asked, "query_id long, text string"), 7).collect()
    for q, text in asked:
        assert [(r.id, round(r.score, 6)) for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == q] == bm25(texts, text, 7)


def pairs_and_expressions(spark, metric, normal):
    p = [("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", [-1.0, 2.5]), ("d", [1.0]), ("e", None), ("f", [1.0, None]), (None, [0.25, -8.0])] + [("n", [float("nan"), 1.0])] * (not normal)
    points = spark.createDataFrame(p, "id string, values array<float>")
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, [-2.0, 0.5]), (40, [9.0, 1.0]), (60, [7.0, 7.0, 7.0])], "query_id long, query array<double>")
    every = points.crossJoin(asked).select("query_id", "id", V.score(V.doubles("values"), F.col("query"), metric).alias("score"))
    every = (topk.normalized(every) if normal else every).select("query_id", "id", F.round("score", 6).alias("score"))
    found = dense.pairs(points, asked, metric, 6, normal, block=2)
    assert found.schema == every.schema
    return [sorted(map(str, map(tuple, x.collect()))) for x in (found, every)]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_all_pairs_by_matrix_against_expressions(spark, sf, monkeypatch, metric):
    monkeypatch.setattr(dense, "TASK_PAIRS", 9)
    found, every = pairs_and_expressions(spark, metric, False)
    assert found == every and len(found) == 40
    plan = catalogue.dense_cosine_zero_norm(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # a join would make a row with both vectors of each pair


def test_all_pairs_normalised_in_two_passes(spark, sf, monkeypatch):
    monkeypatch.setattr(dense, "TASK_PAIRS", 9)
    found, every = pairs_and_expressions(spark, "cosine", True)
    assert found == every and len(found) == 35
    plan = catalogue.minmax_normalize(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan  # a window shuffles and sorts all pairs


def ship(id, masts, text, *vector, kind="brig"):
    return {"id": id, "values": list(vector), "payload": json.dumps({"masts": masts, "kind": kind, "log": text})}


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark, f"file://{tmp_path}/root")
    made.create_collection("fleet", 2, payload_indexes={"kind": "keyword", "masts": "numeric"}, bm25_text_field="log", sparse_enabled=True)
    made.upsert("fleet", [ship("s1", 2, "calm sea", 1, 0), ship("s2", 3, "storm at sea", 0.8, 0.6), ship("s3", 1, "harbour", 0, 1, kind="sloop"), {**ship("s4", 3, "storm", -1, 0), "sparse": {"indices": [3, 8], "values": [2.0, 1.0]}}])
    return made


def test_searches_before_and_after_compaction(engine):
    def answers():
        rule = {"must": [{"key": "kind", "match": {"value": "brig"}}, {"key": "masts", "range": {"gte": 3}}]}
        ids = lambda **r: [x.id for x in engine.search("fleet", **r).orderBy("rank").collect()]
        return [ids(vector=[1, 0.1], filter=rule), ids(vector=[1, 0.1], top_k=2), ids(text="storm sea", mode="bm25"), ids(sparse={8: 1.0}, mode="sparse"), sorted(ids(vector=[1, 0], text="storm", mode="hybrid")), ids(text="storm", mode="bm25", filter=rule, filter_mode="pre")]

    fresh = answers()
    best = lambda logs: [i for i, _ in bm25(logs.items(), "storm sea", 10)]
    logs = {"s1": "calm sea", "s2": "storm at sea", "s3": "harbour", "s4": "storm"}
    assert fresh == [["s2", "s4"], ["s1", "s2"], best(logs), ["s4"], ["s1", "s2", "s3", "s4"], ["s4", "s2"]]
    assert engine.compact("fleet") == {"entries_before": 4, "entries_after": 4} and answers() == fresh
    assert engine.reindex("fleet", 2) == 4
    engine.upsert("fleet", [ship("s5", 3, "storm storm", 0.9, 0.3), ship("s1", 5, "wreck", 0, -1)])
    engine.delete("fleet", ["s2"])
    changed = answers()
    assert changed[:3] == [["s5", "s1", "s4"], ["s5", "s3"], best({"s1": "wreck", "s3": "harbour", "s4": "storm", "s5": "storm storm"})]
    near = lambda: [x.id for x in engine.search("fleet", vector=[1, 0.1], exact=False, probes=2).orderBy("rank").collect()]
    assert near() == ["s5", "s3", "s1", "s4"]
    found = engine.snapshot_and_compact("fleet")
    assert found["entries_after"] == 4 and engine.store.manifest("fleet")["checkpoint"] == found["snapshot"] and answers() == changed and near() == ["s5", "s3", "s1", "s4"]


def test_index_columns_reach_the_scan(engine, capsys):
    from vexel.plans.filters import index_bounds

    engine.compact("fleet")
    engine.upsert("fleet", [ship("s9", 9, "x", 1, 1)])
    rule = {"must": [{"key": "masts", "range": {"gte": 3}}, {"key": "kind", "any_of": {"any": ["brig", "yawl"]}}]}
    engine.store.points("fleet").where(index_bounds(rule, engine.store.config("fleet").payload_indexes)).select("id").explain()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ix1_high,3.0\)", capsys.readouterr().out)
    assert index_bounds({"should": [{"key": "masts", "match": 1}]}, engine.store.config("fleet").payload_indexes) is None


def test_life_of_a_collection(engine, spark, tmp_path):
    with pytest.raises(CollectionExists):
        engine.create_collection("fleet", 2)
    with pytest.raises(PointNotFound):
        engine.delete("fleet", ["s7"])
    with pytest.raises(Exception, match="vectors of fleet have 2 numbers"):
        engine.upsert("fleet", [ship("s8", 1, "", 1, 2, 3)])
    id = engine.snapshot("fleet")
    assert engine.delete("fleet", ["s3"]) == 1 and engine.get("fleet", "s3") is None and engine.describe("fleet")["count"] == 3
    pages, cursor = [], ""
    while True:
        rows, cursor = engine.scroll("fleet", cursor, 2)
        pages.append([r.id for r in rows])
        if not cursor:
            break
    assert pages == [["s1", "s2"], ["s4"]]
    assert engine.restore("fleet", id) == 4 and [s["id"] for s in engine.snapshots("fleet")] == [id]
    engine.store.delete_snapshot("fleet", id)
    with pytest.raises(InvalidRequest):
        engine.restore("fleet", id)
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([("new", [0.0, 1.0], None, None)], "id string, values array<float>, payload string, sparse struct<indices:array<bigint>,values:array<float>>").write.parquet(source)
    for _ in range(2):
        engine.import_stream("fleet", source, f"file://{tmp_path}/check")
    assert engine.describe("fleet")["count"] == 5
    engine.delete_collection("fleet")
    engine.delete_collection("fleet")
    assert engine.list_collections() == []


def test_later_batches_win_whatever_their_partitions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/root")
    engine.create_collection("many", 1)
    for n in range(2):
        rows = spark.range(1040).repartition(520).select(F.col("id").cast("string").alias("id"), F.array(F.lit(float(n))).alias("values"))
        assert engine.bulk_upsert("many", rows) == 1040
    live = engine.store.points("many")
    assert live.count() == 1040 and live.where(F.col("values")[0] != 1.0).count() == 0


def test_commits_are_whole_and_none_is_lost(spark, tmp_path, monkeypatch):
    engine = Engine(spark, f"file://{tmp_path}/root")
    engine.create_collection("c", 1)
    put = lambda id, e=engine: e.upsert("c", [{"id": id, "values": [1.0]}])
    put("a")
    # a writer that dies before its manifest is in place
    monkeypatch.setattr(Store, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        put("b")
    monkeypatch.undo()
    assert [r.id for r in engine.store.points("c").collect()] == ["a"]
    # a second writer that comes between reading the manifest and writing the next
    other, write, raced = Engine(spark, engine.store.root), Store._put, []

    def race(self, what, *parts):
        if self is engine.store and "manifests" in parts and not raced:
            raced.append(1)
            put("d", other)
        return write(self, what, *parts)

    monkeypatch.setattr(Store, "_put", race)
    put("c")
    assert raced and sorted(r.id for r in engine.store.points("c").collect()) == ["a", "c", "d"]


def test_rebalance_and_bootstrap(engine, spark, tmp_path):
    target = f"file://{tmp_path}/shards"
    dry = engine.rebalance(target, ["fleet"], 1, 2, dry_run=True).collect()
    assert not (tmp_path / "shards").exists() and {r.collection for r in dry} == {"fleet", None} and sum(r.moved + r.kept for r in dry) == 8
    report = {r.collection: (r.moved, r.kept, r.failed) for r in engine.rebalance(target, ["fleet"], 1, 2).collect()}
    shards = [{r.id for r in Store(spark, f"{target}/shard-{n}").points("fleet").collect()} for n in range(2)]
    assert shards == [{i for i in ("s1", "s2", "s3", "s4") if ring.shard_of(i, 2) == n} for n in range(2)] and report["fleet"] == (len(shards[1]), len(shards[0]), 0)
    assert engine.rebalance(target, ["fleet"], 1, 2, most=0).count() in (0, 1, 2)
    there = Engine(spark, f"file://{tmp_path}/other")
    assert there.bootstrap(engine) == ["fleet"] and there.bootstrap(engine) == [] and there.describe("fleet") == engine.describe("fleet")


def test_points_from_json(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "vector": [1, 2], "payload": {"k": [1]}, "sparse": {"7": 0.5, "2": 1}}\n{"id": "b", "values": [3], "sparse": {"indices": [4], "values": [2.0]}}\n{"id": "c"}\n')
    got = {r.id: r for r in read_points(spark, f"file://{tmp_path}/p.jsonl").collect()}
    assert (got["a"].values, json.loads(got["a"].payload), got["a"].sparse.indices, got["a"].sparse.values) == ([1.0, 2.0], {"k": [1]}, [2, 7], [1.0, 0.5])
    assert got["b"].sparse.indices == [4] and got["c"].sparse is None and got["c"].values is None


def test_retrieval(engine, spark):
    pipeline = rag.RagPipeline(engine, "notes", 32, size=60, overlap_chars=10)
    notes = spark.createDataFrame([("n1", "ropes and knots for the mast " * 5), ("n2", "salt fish and bread in barrels " * 5)], "id string, text string")
    assert pipeline.ingest(notes) == engine.describe("notes")["count"] > 4
    hits = pipeline.query("Salt fish", 3, reranked=True).orderBy("rank").collect()
    assert len(hits) == 3 and all(r.id.startswith("n2#") for r in hits)


def brute_force(rows, score, k=10, keep=lambda r: True):
    """query_id, id, rank of the k best of the rows that keep() lets by, for each row whose id is divisible by 20."""
    found = set()
    some = [r for r in rows if keep(r)]
    x = np.array([r.embedding for r in some], float)
    for q in rows:
        if q.vec_id % 20 == 0:
            scores = score(x, np.array(q.embedding, float))
            order = sorted(range(len(some)), key=lambda i: (-scores[i], str(some[i].vec_id)))
            found |= {(q.vec_id, str(some[i].vec_id), at + 1) for at, i in enumerate(order[:k])}
    return found


def test_whole_searches_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    cosine = lambda x, q: x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
    euclidean = lambda x, q: -((x - q) ** 2).sum(1)
    dot = lambda x, q: x @ q
    got = lambda name: {(r.query_id, r.id, r["rank"]) for r in catalogue.QUERIES[name](spark, sf).collect()}
    nearest = brute_force(rows, cosine)
    assert len({q for q, _, _ in nearest}) == sum(r.vec_id % 20 == 0 for r in rows) > 20
    for name in ("dense_cosine_topk", "dense_batch_topk", "shard_merge_topk"):
        assert got(name) == nearest
    assert got("filter_ids_semi") == {x for x in nearest if int(x[1]) % 2 == 0}
    assert got("dense_euclidean_topk") == got("dense_batch_euclidean") == brute_force(rows, euclidean)
    assert got("dense_dot_topk") == brute_force(rows, dot)
    assert got("dense_overfetch_2k") == brute_force(rows, cosine, 20)
    labels = {"match": lambda n: n == 3, "any_of": lambda n: n in (1, 4, 7), "range": lambda n: 2 <= n < 5, "must_not": lambda n: n not in (0, 5, 6), "should": lambda n: n == 1 or n > 7, "nested": lambda n: n < 8 and n in (2, 6, 7), "exists": lambda n: True}
    for name, law in labels.items():
        assert got(f"filtered_dense_{name}") == brute_force(rows, cosine, keep=lambda r, law=law: law(r.label))
    votes = catalogue.QUERIES["knn_label_vote"](spark, sf).groupBy("query_id").agg(F.sum("votes").alias("n")).collect()
    assert {r.query_id for r in votes} == {q for q, _, _ in nearest} and all(r.n == 15 for r in votes)
    for name in ("hybrid_rrf", "hybrid_rrf_single_list", "hybrid_weighted", "hybrid_weighted_dense", "minmax_normalize", "ann_ivf_topk"):
        who = catalogue.QUERIES[name](spark, sf).select("query_id").distinct().collect()
        assert {r.query_id for r in who} == {q for q, _, _ in nearest}
    assert catalogue.QUERIES["recall_ground_truth"](spark, sf).first()[0] == 1


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_index(spark, d):
    d = f"/root/testdata/{d}"
    hits = catalogue.ann_ivf_topk(spark, d)
    assert hits.groupBy("query_id", "id").count().where("count > 1").count() == 0
    found, truth = ({(r.query_id, r.id) for r in x.collect()} for x in (hits, catalogue.QUERIES["dense_batch_topk"](spark, d)))
    share = len(found & truth) / len(truth)
    assert share >= 0.9 and catalogue.ann_ivf_recall(spark, d).first()[0] == pytest.approx(share)


def test_sparse_pairs_with_all_documents(spark, sf):
    lengths = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("t")).collect():
        lengths[r.doc_id] = Counter(map(len, r.t or []))
    want = {(str(a), str(b)): sum(n * y[k] for k, n in x.items()) for a, x in lengths.items() if a % 20 == 0 for b, y in lengths.items() if x.keys() & y.keys()}
    assert len({b for _, b in want}) > 100
    assert {(r.a, r.b): r["product"] for r in catalogue.QUERIES["sparse_dot_pairs"](spark, sf).collect()} == want


def test_sparse_pairs_by_matrix(spark, sf):
    plan = catalogue.QUERIES["sparse_dot_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # a join on the index shuffles rows for each pair
    rows = [("a", [1, 5], [2.0, -1.0]), ("b", [5], [3.0]), ("c", [1, 5], [1.0, 2.0]), ("d", [8], [1.0]), ("e", [], []), ("f", None, None), (None, [1], [0.5])]
    p = spark.createDataFrame([(i, None if n is None else (n, w)) for i, n, w in rows], "id string, sparse struct<indices:array<bigint>,values:array<float>>")
    found = {(r.a, r.b, r["product"]) for r in lexical.sparse_pairs(p.where("id in ('a', 'd')"), p, 3).collect()}
    assert found == {("a", "a", 5.0), ("a", "b", -3.0), ("a", "c", 0.0), ("a", None, 1.0), ("d", "d", 1.0)}


def test_sparse_pairs_shuffle_no_term(spark, sf):
    plan = catalogue.QUERIES["sparse_dot_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = {x for found in re.findall(r"hashpartitioning\((.*?), \d+\)", plan) for x in re.findall(r"(\w+)#", found)}
    assert keys == {"id", "size"}  # a row for each document and length of a token, none for each term


def test_sparse_pairs_in_runs(spark):
    p = spark.range(400).select(F.col("id").cast("string").alias("id"), F.struct(F.array(F.lit(1), F.col("id") % 7 + 2).cast("array<bigint>").alias("indices"), F.array(F.lit(1), F.col("id") % 10 + 1).cast("array<float>").alias("values")).alias("sparse"))
    rows = lexical.sparse_pairs(p.where("id % 20 = 0"), p, 1).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows}) == 20 * 400
    assert sum(x.a != y.a for x, y in zip(rows, rows[1:])) < 20 * 2  # files hold runs of a, in blocks of right points


@pytest.mark.parametrize("odd", [False, True])
def test_sparse_pairs_over_many_blocks(spark, odd):
    rng = np.random.default_rng(3)
    n, m, columns = 1030, 270, 1100
    made = lambda k: (np.sort(rng.choice(columns, 5)) - 3, rng.integers(1, 9, 5) / 4 * (rng.choice([-1, 0, 1], 5) if odd else 1))  # noqa: E731  # an index may come twice
    left, right = ([made(k) for k in range(c)] for c in (n, m))
    if odd:
        left[7][1][0] = right[8][1][1] = np.inf
        right[9][1][2] = np.nan
    frame = lambda rows: spark.createDataFrame([(str(k), (i.tolist(), w.tolist())) for k, (i, w) in enumerate(rows)], "id string, sparse struct<indices:array<bigint>,values:array<float>>")
    at = {}
    for k, (i, w) in enumerate(right):
        for x, y in zip(i.tolist(), w.tolist()):
            at.setdefault(x, []).append((k, y))
    want = {}
    for k, (i, w) in enumerate(left):
        for x, y in zip(i.tolist(), w.tolist()):
            for b, z in at.get(x, ()):
                want[str(k), str(b)] = want.get((str(k), str(b)), 0.0) + y * z
    rows = lexical.sparse_pairs(frame(left), frame(right), 2).collect()
    found = {(r.a, r.b): r["product"] for r in rows}
    assert len(rows) == len(found) and found.keys() == want.keys()
    np.testing.assert_array_equal([found[k] for k in want], list(want.values()))
