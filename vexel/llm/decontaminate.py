"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over whole documents.

Text is lower-cased (A-Z only) and cut into words of ASCII digits, ASCII letters and non-ASCII characters. A window is
`size` consecutive words of an item; an item of fewer words, but not none, is one window. Each document's word windows
are hashed in numpy, looked up in the sorted window hashes, and a hit is verified against the item's words.

Items come in blocks of at most BLOCK_BYTES of text, so that what is broadcast is bounded. Nearly always there is one
block. If there are more, the documents are written once with a row number; each block is a pass over numbers and texts
that gives narrow rows of hits, which are joined with the documents once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import written
from ._words import ALNUM, chunks

WINDOW = 10
#: Item text in one broadcast; its index takes about 8 times as much.
BLOCK_BYTES = 4 << 20


class WindowIndex:
    """Windows by length: sorted hashes with a place in the items' normalised words and the items that have the window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        found: dict[int, dict] = {}
        self.words: list[bytes] = []
        texts = pa.array([t for _, t in items], pa.string())
        for at, w in chunks(texts, ALNUM):
            base = len(self.words)
            self.words += [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends, strict=True)]
            hashes: dict[int, np.ndarray] = {}
            for k in range(len(w)):
                a, b = int(w.first[k]), int(w.first[k + 1])
                if b > a:
                    length = min(size, b - a)
                    if length not in hashes:
                        hashes[length] = w.windows(length)
                    for i in range(a, b - length + 1):
                        same = found.setdefault(length, {}).setdefault((int(hashes[length][i]), self._joined(base + i, length)), (base + i, set()))
                        same[1].add(number[items[at + k][0]])
        self.by_length = {}
        for length, windows in found.items():
            rows = sorted((h, place, sorted(own)) for (h, _), (place, own) in windows.items())
            self.by_length[length] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])

    def _joined(self, place: int, length: int) -> bytes:
        return b" ".join(self.words[place : place + length])

    def hits(self, w, first: int, last: int, looked: dict[int, np.ndarray]) -> Iterator[tuple[int, int, list[int]]]:
        """(word, length, item numbers) of each window in words first to last. A window is verified once for all its items."""
        for length, (keys, places, items) in self.by_length.items():
            spots = looked[length]
            for i in spots[np.searchsorted(spots, first) : np.searchsorted(spots, last - length, "right")]:
                own, h = w.text(i, i + length), w.all_windows[length][i]
                for k in range(np.searchsorted(keys, h), np.searchsorted(keys, h, "right")):
                    if own == self._joined(places[k], length):
                        yield int(i), length, items[k]

    def look(self, w) -> dict[int, np.ndarray]:
        """Words at which a window's hash occurs, by length."""
        w.all_windows = {length: w.windows(length) for length in self.by_length}
        out = {}
        for length, (keys, _, _) in self.by_length.items():
            mine = w.all_windows[length]
            at = np.searchsorted(keys, mine)
            out[length] = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == mine)
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    rows, n = [], 0
    wanted = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    for r in wanted.where(F.col("text").isNotNull()).toLocalIterator():
        if rows and n + len(r.text) > block_bytes:
            yield rows
            rows, n = [], 0
        rows.append((r.item, r.text))
        n += len(r.text)
    yield rows


HITS = (("hit_from", "array<bigint>", pa.list_(pa.int64())), ("hit_to", "array<bigint>", pa.list_(pa.int64())), ("hit_items", "array<string>", pa.list_(pa.string())))


def _scan(shared, text_at: int, only_hits: bool = False, drop_text: bool = False):
    """The columns with n_words and the verified hits; of all rows, or of those with hits."""

    def run(batches):
        index = shared.value
        for batch in batches:
            starts, ends, items, n_words = ([] for _ in range(4))
            for _, w in chunks(batch.column(text_at), ALNUM):
                looked = index.look(w)
                n_words += w.counts().tolist()
                spots = np.unique(np.concatenate([np.empty(0, np.int64), *looked.values()]))
                hot = np.unique(np.searchsorted(w.first, spots, "right") - 1)
                base = len(starts)
                for held in (starts, ends, items):
                    held += [[] for _ in range(len(w))]
                for d in hot:
                    merged, ids = [], set()
                    for i, length, own in sorted(index.hits(w, int(w.first[d]), int(w.first[d + 1]), looked), key=lambda x: x[0]):
                        i -= int(w.first[d])
                        ids.update(own)
                        if merged and i <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], i + length)
                        else:
                            merged.append([i, i + length])
                    starts[base + d], ends[base + d] = [m[0] for m in merged], [m[1] for m in merged]
                    items[base + d] = [index.ids[k] for k in sorted(ids)]
            kept = [k for k in range(batch.num_columns) if not (drop_text and k == text_at)]
            columns = [batch.column(k) for k in kept] + [pa.array(n_words, pa.int64())] + [pa.array(x, t) for x, (_, _, t) in zip((starts, ends, items), HITS, strict=True)]
            out = pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[k] for k in kept] + ["n_words"] + [c for c, _, _ in HITS])
            yield out.filter(pa.array([bool(x) for x in starts], pa.bool_())) if only_hits else out

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns in `carry` of each document, n_words, and hits: hit_from, hit_to (disjoint word spans, ascending) and hit_items (item ids as strings, sorted).

    A null or empty text has no words and no hits. Null items' texts are passed over; an item without an id counts as
    item `null`. Repeated items count once. Repeated documents are rows of their own. An empty benchmark hits nothing;
    an empty table gives an empty result. Columns that are not in `carry` are not read; those in it that are named like
    the four new ones are replaced.
    """
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in ("n_words", *(c for c, _, _ in HITS)))
    inner = [f"_c{k}" for k in range(len(carry))]
    text = inner[carry.index(text_col)] if text_col in carry else "_text"
    state = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, inner, strict=True)], *([] if text in inner else [F.col(text_col).alias("_text")]))
    narrow = [T.StructField("n_words", T.LongType())] + [T.StructField(c, T.DataType.fromDDL(t)) for c, t, _ in HITS]
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, another = next(blocks), next(blocks, None)
    share = lambda items: spark.sparkContext.broadcast(WindowIndex(items, size))
    if another is None:
        at = state.columns.index(text)
        fields = [f for f in state.schema.fields if f.name != "_text"]
        out = state.mapInArrow(_scan(share(block), at, drop_text=text == "_text"), T.StructType(fields + narrow))
    else:
        numbered = written(state.withColumn("_row", F.monotonically_increasing_id()))
        found = []
        while block is not None:  # of the first block all rows, for n_words
            passed = numbered.select("_row", text).mapInArrow(_scan(share(block), 1, bool(found), True), T.StructType([T.StructField("_row", T.LongType()), *narrow]))
            found.append(written(passed))
            block, another = another, next(blocks, None)
        every = found[0].sparkSession.read.schema(found[0].schema).parquet(*[x.vexel_path for x in found])
        summed = every.groupBy(F.col("_row").alias("_of")).agg(F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c, _, _ in HITS])
        out = _merged(numbered.drop("_text").join(summed, F.col("_row") == F.col("_of")))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, inner, strict=True)], "n_words", "hit_from", "hit_to", "hit_items")


def _merged(df: DataFrame) -> DataFrame:
    """Spans of several blocks may touch; n_hit() counts a word once, so they are merged here."""
    spans = F.array_sort(F.arrays_zip("hit_from", "hit_to"))
    zero = F.array().cast("array<struct<hit_from:bigint,hit_to:bigint>>")

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.hit_from.alias("hit_from"), F.greatest(last.hit_to, x.hit_to).alias("hit_to"))))
        return F.when((F.size(acc) > 0) & (x.hit_from <= F.try_element_at(acc, F.lit(-1)).hit_to), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.when(F.size("hit_from") <= 1, spans).otherwise(F.aggregate(spans, zero, add))
    return df.withColumn("_spans", merged).withColumns({"hit_from": F.col("_spans.hit_from"), "hit_to": F.col("_spans.hit_to"), "hit_items": F.array_sort(F.array_distinct("hit_items"))}).drop("_spans")


def n_hit():
    return F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without benchmark passages, all columns kept: `documents` drops each document with a hit, `spans` cuts out the words that are hit.

    A cut text keeps everything outside the spans as it stood. Nulls, empties and repeats as in find_leaks().
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    inner = [f"_own{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)])
    out = find_leaks(plain, benchmark, inner[at], carry=tuple(inner), **options)
    out = out.where(F.size("hit_from") == 0) if remove == "documents" else out.mapInArrow(_cutter(at), out.schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])


def _cutter(text_at: int):
    def run(batches):
        for batch in batches:
            texts, starts, ends = (batch.column(batch.schema.names.index(c) if c else text_at).to_pylist() for c in ("", "hit_from", "hit_to"))
            for k, text in enumerate(texts):
                if starts[k]:
                    raw = text.encode()
                    _, w = next(chunks(pa.array([text]), ALNUM))
                    kept, at = [], 0
                    for a, b in zip(starts[k], ends[k], strict=True):
                        kept.append(raw[at : w.starts[a]])
                        at = w.ends[b - 1]
                    texts[k] = (b"".join(kept) + raw[at:]).decode()
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def leak_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    found = find_leaks(docs, benchmark)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_from") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT l FROM bw), dw AS (
  SELECT rid, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS win
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)
), hit AS (SELECT dw.rid, dw.i, dw.l, bw.item FROM dw JOIN bw USING (l, win)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT rid, i, l FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
