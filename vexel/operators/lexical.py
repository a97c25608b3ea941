"""Sparse products and BM25 over postings tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_points, tokens
from .topk import ranked

#: fixed values of the ranking formula
K1, B = 1.2, 0.75
#: Terms that are looked up in each text's own list of words, at most.
FEW_TERMS = 64
#: Pairs of one task, about.
TASK_PAIRS = 1 << 23
#: Left and right points that are multiplied at once (PAIR_COLUMNS a power of two), and indices; left points of a row that goes to the JVM.
PAIR_ROWS, PAIR_COLUMNS, PAIR_INDICES, NESTED_ROWS = 1 << 10, 1 << 8, 1 << 10, 1 << 4
#: Bytes of text that are cut into tokens at once; the working arrays take about 20 times as much.
TEXT_BLOCK = 1 << 20


def sparse_postings(points: DataFrame) -> DataFrame:
    """id, idx, weight from points (id, sparse)."""
    return points.where(F.col("sparse").isNotNull()).select("id", F.explode(F.arrays_zip(F.col("sparse.indices").alias("idx"), F.col("sparse.values").alias("weight"))).alias("p")).select("id", "p.idx", F.col("p.weight").cast("double").alias("weight"))


def sparse_search(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """queries has query_id, idx, weight; only points that share an index are there."""
    q = queries.select("query_id", "idx", F.col("weight").cast("double").alias("q"))
    return ranked(postings.join(q, "idx").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("weight")).alias("score")), k)


def _products(left: tuple, right: tuple, shape: tuple[int, int, int]) -> np.ndarray:
    """Products of left (row, column, weight) and right points over their columns, shape[1] of them."""
    (a, c, x), (b, d, y) = left, right
    n, columns, m = shape
    out = np.zeros((n, m))
    if not (np.isfinite(x).all() and np.isfinite(y).all()):  # a point without the index has no part in it
        for k in np.intersect1d(c, d):
            i, j = c == k, d == k
            np.add.at(out, (a[i][:, None], b[j]), x[i][:, None] * y[j])
        return out
    for k in range(0, columns, PAIR_INDICES):
        w = min(PAIR_INDICES, columns - k)
        i, j = (c >= k) & (c < k + w), (d >= k) & (d < k + w)
        out += np.bincount(a[i] * w + c[i] - k, x[i], n * w).reshape(n, w) @ np.bincount((d[j] - k) * m + b[j], y[j], w * m).reshape(w, m)
    return out


def sparse_pairs(left: DataFrame, right: DataFrame, tasks: int) -> DataFrame:
    """a, b, product of each left and each right point (id, sparse) that share an index, by matrix products over the indices.

    The left points are sent to all tasks; no pair is shuffled. Points of like weight meet in a task, and pairs leave it by left
    points, so that the columns of a file repeat themselves and are written small.
    """
    own = sparse_postings(left).toArrow()
    who = own["id"].combine_chunks().dictionary_encode()
    x = own["weight"].to_numpy()
    place = np.argsort(np.argsort(np.bincount(who.indices.to_numpy(), x, len(who.dictionary)), kind="stable"))
    names, a = who.dictionary.take(pa.array(np.argsort(place))), place[who.indices.to_numpy()]
    by = np.argsort(a, kind="stable")
    shared = left.sparkSession.sparkContext.broadcast((names, np.searchsorted(a[by], np.arange(len(names) + 1)), a[by], own["idx"].to_numpy()[by], x[by]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ends, a, idx, x = shared.value
        for batch in batches if len(names) else ():
            blocks = list(_light_first(batch))
            for at in range(0, len(names), PAIR_ROWS):
                to = min(at + PAIR_ROWS, len(names))
                some = slice(ends[at], ends[to])
                for ids, used, right in blocks:
                    met = np.isin(idx[some], used)
                    left, shape = (a[some][met] - at, np.searchsorted(used, idx[some][met]), x[some][met]), (to - at, len(used), len(ids))
                    out = _products(left, right, shape)
                    if (left[2] > 1e-150).all() and (right[2] > 1e-150).all():  # no product of these is 0
                        common = out > 0
                    else:
                        common = _products(*((*p[:2], np.ones(len(p[2]))) for p in (left, right)), shape) > 0
                    yield _nested(names.slice(at, to - at), ids, out, common)

    weight = F.aggregate("sparse.values", F.lit(0.0), lambda s, v: s + v)
    spread = right.where(F.col("sparse").isNotNull()).select("id", "sparse").repartitionByRange(max(1, tasks), weight, "id")
    nested = spread.mapInArrow(run, "a array<string>, b array<string>, product array<double>")
    found = nested.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.posexplode("product").alias("at", "product")).where("product is not null")
    return found.select(F.get("_a", F.shiftright("at", PAIR_COLUMNS.bit_length() - 1)).alias("a"), F.get("_b", F.col("at").bitwiseAND(PAIR_COLUMNS - 1)).alias("b"), "product")


def _light_first(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, tuple]]:
    """Ids, indices and (point, index's place, weight) of PAIR_COLUMNS points (id, sparse) at a time, those of least weight first."""
    for k in range(0, batch.num_rows, PAIR_COLUMNS):
        if k == 0:
            sizes, y = batch.column(1).field("values").value_lengths().to_numpy(), batch.column(1).field("values").flatten().to_numpy()
            batch = batch.take(pa.array(np.argsort(np.bincount(np.repeat(np.arange(len(sizes)), sizes), y, len(sizes)), kind="stable")))
        ids, vectors = batch.slice(k, PAIR_COLUMNS).columns
        sizes, y = vectors.field("indices").value_lengths().to_numpy(), vectors.field("values").flatten().to_numpy().astype(float)
        used, place = np.unique(vectors.field("indices").flatten().to_numpy(), return_inverse=True)
        yield ids, used, (np.repeat(np.arange(len(ids)), sizes), place, y)


def _nested(names: pa.Array, ids: pa.Array, out: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
    """Rows of few left points, the right points, and their products, PAIR_COLUMNS of them for each left point; null where none is common."""
    n, m = out.shape
    product, none = np.zeros((n, PAIR_COLUMNS)), np.ones((n, PAIR_COLUMNS), bool)
    product[:, :m], none[:, :m] = out, ~common
    cuts = np.r_[0 : n : NESTED_ROWS, n].astype(np.int32)
    lists = lambda at, v: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), v)
    every = pa.concat_arrays([ids] * (len(cuts) - 1))
    return pa.RecordBatch.from_arrays([lists(cuts, names), lists(np.arange(len(cuts)) * m, every), lists(cuts * PAIR_COLUMNS, pa.array(product.ravel(), mask=none.ravel()))], ["a", "b", "product"])


def term_postings(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, term, tf, length of each document with a text."""
    listed = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return listed.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def length_postings(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, size, tf: how many tokens of so many characters each document has. Tokens are counted before they are shuffled."""
    sizes = F.transform(tokens(F.col(text_col)), lambda t: F.char_length(t).cast("long"))
    listed = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(sizes).alias("size"))
    return listed.groupBy("id", "size").agg(F.count(F.lit(1)).alias("tf"))


def _cut(kept: np.ndarray, terms: list[str], texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many tokens each lower-cased text has; how often each term is one of them. Texts are cut in their UTF-8 bytes."""
    texts = texts.cast(pa.large_string())  # null is not among them
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.frombuffer(bytearray(data.tobytes().translate(kept[:128].tobytes() + bytes(128))), bool)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = (data[lead] >= 0xE0).astype(np.int8) + (data[lead] >= 0xF0) + 1  # bytes that follow
        point = data[lead] & (0x3F >> more).astype(np.uint32)
        for k in (1, 2, 3):
            some = more >= k
            point[some] = point[some] << 6 | data[lead[some] + k] & 0x3F
        own = kept[point]
        for k in (0, 1, 2, 3):
            inside[lead[own & (more >= k)] + k] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begun = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[begun] = inside[begun]  # no token spans two texts
    places, times = np.flatnonzero(first), []
    if terms:
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        initial, following = data[places], np.r_[places[1:], len(data)]
    for term in (t.encode() for t in terms):
        some = np.flatnonzero(initial == term[0])
        at = places[some][following[some] - places[some] >= len(term)]  # up to the next token or the end
        for k, c in enumerate(term[1:], 1):
            at = at[data[at + k] == c]
        at = at[last[at + len(term) - 1]]
        times.append(np.bincount(np.searchsorted(bounds, at, "right") - 1, minlength=len(texts)))
    return np.diff(np.searchsorted(places, bounds)), times


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of about TEXT_BLOCK bytes."""
    for b in batches:
        block = np.cumsum(pc.binary_length(b.column(1)).to_numpy().astype(np.int64)) // TEXT_BLOCK
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.column(0).slice(at, to - at), b.column(1).slice(at, to - at)


def _lowered(documents: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """id, text of each document with a text, lower-cased."""
    return documents.where(F.col(text_col).isNotNull()).select((F.col(id_col) if id_col else F.lit(None).cast("int")).alias("id"), F.lower(F.col(text_col)).alias("text"))


def corpus_stats(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: docs, avg_length."""
    shared = documents.sparkSession.sparkContext.broadcast(token_points(documents.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)]), pa.array([int(_cut(shared.value, [], texts)[0].sum())])], ["docs", "length"])

    found = _lowered(documents, None, text_col).mapInArrow(run, "docs long, length long")
    return found.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), (F.sum("length") / F.sum("docs")).alias("avg_length"))


def lengths(documents: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, length of each document with a text."""
    return documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).alias("length"))


def length_stats(rows: DataFrame) -> DataFrame:
    """One row: docs, avg_length, from lengths()."""
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: repeated words of a query count each time."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def few_terms(terms: DataFrame) -> list[str] | None:
    """The distinct terms, if they are FEW_TERMS at most."""
    few = sorted(r.term for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect())
    return few if len(few) <= FEW_TERMS else None


def _looked_up(documents: DataFrame, few: list[str], id_col: str, text_col: str, totals: bool = False) -> DataFrame:
    """term_postings() of few terms, looked up in each text as it stands, with no row for any other.

    totals: each task adds a row of the term "", which no token is: as length how many texts it had, as tf how many tokens.
    """
    shared = documents.sparkSession.sparkContext.broadcast(token_points(documents.sparkSession))
    listed = _lowered(documents, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, every, kind = 0, 0, pa.null()
        row = lambda ids, length, term, tf: pa.RecordBatch.from_arrays([ids, pa.array(length.astype(np.int32)), pa.array([term] * len(ids), pa.string()), pa.array(tf.astype(np.int64))], ["id", "length", "term", "tf"])
        for ids, texts in _blocks(batches):
            sizes, times = _cut(shared.value, few, texts)
            docs, every, kind = docs + len(texts), every + int(sizes.sum()), ids.type
            for term, n in zip(few, times, strict=True):
                if len(at := np.flatnonzero(n)):
                    yield row(ids.take(pa.array(at)), sizes[at], term, n[at])
        if totals and docs:
            yield row(pa.nulls(1, kind), np.array([docs]), "", np.array([every]))

    return listed.mapInArrow(run, f"id {listed.schema['id'].dataType.simpleString()}, length int, term string NOT NULL, tf bigint")


def wanted_postings(documents: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """term_postings() of the terms given. Few terms are looked up in each text as it stands; more are joined."""
    few = few_terms(terms)
    if few is None:
        return term_postings(documents, id_col, text_col).join(terms.select("term").distinct(), "term", "left_semi")
    return _looked_up(documents, few, id_col, text_col)


def bm25_scores(postings: DataFrame, stats: DataFrame | None, wanted: DataFrame, k: int) -> DataFrame:
    """The k best of each query (query_id, term, times) from all postings of its terms and the one row of stats.

    Without stats the postings must have totals, see _looked_up(). Queries of the same words as often have the same hits: the
    first of them is scored, the others get its hits.
    """
    bags = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("bag"))
    alike = bags.select("query_id", F.min("query_id").over(Window.partitionBy("bag")).alias("first"))
    own = wanted.join(alike.where("query_id = first").select("query_id"), "query_id", "left_semi")
    if stats is None:
        # one pass over the texts: the counts and the scores read the same columns of the same exchange, so that Spark makes it once
        postings = postings.repartition("id")
        counted = postings.groupBy("term").agg(F.count_if((F.col("tf") > 0) | F.col("id").isNotNull()).alias("df"), F.sum("length").alias("docs"), F.sum("tf").alias("tokens"))
        whole = lambda c: F.sum(F.when(F.col("term") == "", F.col(c)))
        one = counted.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs"), whole("docs").alias("docs"), (whole("tokens") / whole("docs")).alias("avg_length"))
        scored = postings.join(own, "term").crossJoin(F.broadcast(one)).withColumn("df", F.col("dfs")[F.col("term")])
    else:
        # as document_frequency(), from the same columns as the scores, so that Spark makes the postings once
        terms = own.join(postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")), "term")
        scored = postings.join(terms, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    room = F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("avg_length", F.lit(1.0))), F.lit(1e-6))
    hits = ranked(scored.groupBy("query_id", "id").agg(F.sum(F.col("times") * idf * F.col("tf") * (K1 + 1) / room).alias("score")), k)
    return hits.withColumnRenamed("query_id", "first").join(alike, "first").select("query_id", "id", "score", "rank")


def bm25_search(documents: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """queries has query_id, text. Frequencies and lengths are those of all documents."""
    wanted = query_terms(queries)
    few = few_terms(wanted)
    if few is None:
        return bm25_scores(wanted_postings(documents, wanted, id_col, text_col), corpus_stats(documents, text_col), wanted, k)
    return bm25_scores(_looked_up(documents, few, id_col, text_col, totals=True), None, wanted, k)
