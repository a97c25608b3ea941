"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words; two lines are near if one word replaced, added or left out turns one into the other, and one word is
no more than a LEAST_WORDS-th of either. Equal lines are one class first, by a hash. With at most one edit, either the first half of the words is the same in both or the rest is,
so only lines that share a half with another line go on. Of their other half, all variants with a word deleted are
emitted as hashed keys; equal keys join; the edit distance is verified on the words; the earliest line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written

#: One word is at most so small a part of a line that has a near one; shorter lines are only compared for equality.
LEAST_WORDS = 4
#: Bits of the filter that says which lines' words are fetched; at most a 64th as many rows are broadcast.
FILTER_BITS = 1 << 26
#: A place is a number below 2**126: the id, counted from the least, or NO_ID and a hash of the text; the line; more of that hash.
LINES, TEXTS, NO_ID = 1 << 31, 1 << 30, 1 << 64
#: Words whose running hashes are taken together.
STRETCH = 64


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _words(trimmed: Column) -> Column:
    """The words of a trimmed line that isn't empty."""
    return F.split(trimmed, r"[\x20\x09-\x0D]+")


def _half_keys(w: str) -> dict[str, Column]:
    """Of lengths m = n, and n - 1 beside a shorter line: the first m // 2 words (even), the last m - m // 2 (odd)."""
    keys = {}
    for less in (0, 1):
        n, m = F.size(w), F.size(w) - less
        h = F.floor(m / 2).cast("int")
        keys[f"k{2 * less}"] = F.xxhash64(F.lit(0), m, F.slice(w, F.lit(1), h))
        keys[f"k{2 * less + 1}"] = F.xxhash64(F.lit(1), m, F.slice(w, n - (m - h) + 1, m - h))
    return keys


def _whole_number(x: int, digits: int) -> Column:
    return F.lit(str(x)).cast(f"decimal({digits},0)")


def _first_place(doc_id: Column, text_hash: Column) -> Column:
    """Of a document, the place of its line 0 as one number in order, null ids last: aggregates of places need no sort."""
    no_id = (_whole_number(NO_ID, 20) + text_hash.cast("decimal(19,0)")).cast("decimal(20,0)")
    from_least = (doc_id.cast("decimal(19,0)") + _whole_number(NO_ID // 2, 19)).cast("decimal(20,0)")
    doc = F.coalesce(from_least, no_id) * _whole_number(LINES * TEXTS, 19)
    return (doc.cast("decimal(38,0)") + F.pmod(text_hash, F.lit(TEXTS)).cast("decimal(10,0)")).cast("decimal(38,0)")


def _within(place: Column) -> Column:
    return place % _whole_number(LINES * TEXTS, 19)


def _doc_of(place: Column) -> Column:
    doc = ((place - _within(place)) / _whole_number(LINES * TEXTS, 19)).cast("decimal(20,0)")
    return F.when(doc < _whole_number(NO_ID, 20), (doc - _whole_number(NO_ID // 2, 19)).cast("long"))


def _line_of(place: Column) -> Column:
    return F.shiftright(_within(place).cast("long"), TEXTS.bit_length() - 1).cast("int")


def _let(value: Column, body):
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _xor(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _at(w: Column, back: int) -> Column:
    """A hash of each word with its place, or with the place before."""
    return F.transform(w, lambda x, i: F.xxhash64(x, i - back))


def _whole(w: Column) -> Column:
    """A hash of a word list: words' hashes with their places, combined."""
    return _xor(_at(w, 0))


def _without(w: Column) -> Column:
    """_whole() of a word list without its first word, without its second, and so on.

    From one to the next, one word comes back and one goes, so these are running combinations: in stretches, each of
    which begins with all stretches before it.
    """

    def running(d):
        n = F.size(d)

        def from_stretches(before):
            return F.transform(d, lambda _, i: F.element_at(before, (F.floor(i / STRETCH) + 1).cast("int")).bitwiseXOR(_xor(F.slice(d, (F.floor(i / STRETCH) * STRETCH + 1).cast("int"), i % STRETCH + 1))))

        stretches = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int")), lambda k: _xor(F.slice(d, k * STRETCH + 1, F.lit(STRETCH))))
        return _let(stretches, lambda xs: _let(F.transform(xs, lambda _, k: _xor(F.slice(xs, F.lit(1), k))), from_stretches))

    def body(first, early, late):
        later = F.slice(early, F.lit(2), F.size(early))
        changes = F.zip_with(later, F.slice(late, F.lit(1), F.size(late) - 1), lambda a, b: a.bitwiseXOR(b))
        rest = _let(changes, lambda d: F.when(F.size(d) > 0, running(d)).otherwise(F.array().cast("array<bigint>")))
        return F.concat(F.array(first), F.transform(rest, lambda x: x.bitwiseXOR(first)))

    each = _let(_at(w, 1), lambda early: _let(_at(w, 0), lambda late: _let(_xor(F.slice(early, F.lit(2), F.size(early))), lambda first: body(first, early, late))))
    return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))


def _variants(w: str, key: Column, tail: Column, less: Column) -> Column:
    """Keys of the half that isn't shared: as it is, and with each word deleted.

    kind 0: replaced at place i, between equal lengths; kind 1: the shorter line whole; kind 2: the longer, one word out.
    """
    n, m = F.size(w), F.size(w) - less
    h = F.floor(m / 2).cast("int")
    other = F.when(tail == 0, F.slice(w, h + 1, n - h)).otherwise(F.slice(w, F.lit(1), n - (m - h)))
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("variant"))

    def all_of(x):
        same = F.transform(_without(x), lambda v, i: row(0, F.xxhash64(key, F.lit(0), i, v)))
        short = F.array(row(1, F.xxhash64(key, F.lit(1), _whole(x))))
        long = F.transform(_without(x), lambda v: row(2, F.xxhash64(key, F.lit(1), v)))
        return F.when(less == 0, F.concat(same, short)).otherwise(long)

    return _let(other, all_of)


def _near(a: Column, b: Column) -> Column:
    """Whether the word lists are at most one edit apart."""

    def shifted(long, short):
        at = F.coalesce(F.array_position(F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x != y), F.lit(True)), F.lit(0)).cast("int")
        cut = F.when(at == 0, F.size(short) + 1).otherwise(at)
        return F.slice(long, cut + 1, F.size(long)) == F.slice(short, cut, F.size(short) + 1)

    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)) <= 1
    return F.when(F.size(a) == F.size(b), equal).when(F.size(a) == F.size(b) + 1, shifted(a, b)).when(F.size(b) == F.size(a) + 1, shifted(b, a)).otherwise(F.lit(False))


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """at, raw: the place of each line, and the line, trimmed."""
    text_hash = F.shiftrightunsigned(F.xxhash64(text_col), 1)
    rows = docs.select(_first_place(F.col(id_col).cast("long"), text_hash).alias("first"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "raw"))
    return rows.select((F.col("first") + F.shiftleft(F.col("line_no").cast("long"), TEXTS.bit_length() - 1).cast("decimal(19,0)")).cast("decimal(38,0)").alias("at"), _trimmed(F.col("raw")).alias("raw"))


def _bit(place: Column) -> Column:
    return F.pmod(F.xxhash64(place), F.lit(FILTER_BITS))


def _only(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Lines whose place, column at, may be among places: a broadcast bit map, made by aggregation. Some others pass too."""
    bits = places.select(_bit(F.col("at")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("_bits"))
    marked = lines.withColumn("_bit", _bit(F.col("at")))
    hit = marked.join(F.broadcast(bits), F.shiftright("_bit", 6) == F.col("_word"))
    return hit.where(F.expr("shiftright(_bits, cast(_bit % 64 as int)) & 1L = 1L")).select(*lines.columns)


def repeated_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line_no (from 0), like ('equal' or 'near'), first_doc, first_line: each line with an earlier equal or near one.

    Earlier is the smaller (doc_id, line_no), null ids last, texts under one id by a hash. Lines compare as lists of words,
    [^\\x20\\x09-\\x0D]+, as they stand; lines without words are left alone. `near` lines have at least `least_words` words
    and no equal earlier line of their own; first_doc and first_line name the earliest line that is near, whether or not
    that stays. A null text has no lines. Different texts under one id, or without one, are documents of their own, equal
    ones (repeated rows) are one; an empty table gives an empty result.
    """
    raw = _lines(docs, text_col, id_col)
    lines = raw.where("raw <> ''").select("at", _words(F.col("raw")).alias("w"))
    halves = {k: F.when(F.size("w") >= least_words, h) for k, h in _half_keys("w").items()}
    seen = written(lines.select("at", F.xxhash64("w").alias("line"), *[h.alias(k) for k, h in halves.items()]))
    classes = written(seen.groupBy("line").agg(F.min("at").alias("at"), *[F.min(k).alias(k) for k in halves]))

    each = F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(i).alias("which")) for i in range(4)])).alias("half")
    of_each = classes.where("k0 is not null").select("line", "at", each).select("line", "at", "half.*")
    shared = of_each.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key")
    going = written(of_each.join(shared, "key").select("line", "at", "key", (F.col("which") % 2).alias("tail"), F.floor(F.col("which") / 2).cast("int").alias("less")))
    # the words of the first line of each class that goes on
    wanted = going.select("line", "at").distinct()
    candidates = _only(raw, wanted).withColumn("_w", _words(F.col("raw")))
    # the class says which text is meant, should two share a place by their hashes
    words = written(candidates.withColumn("line", F.xxhash64("_w")).join(wanted, ["line", "at"]).groupBy("line", "at").agg(F.min("raw").alias("raw")).select("line", "at", _words(F.col("raw")).alias("w")))

    emitted = going.join(words.select("line", "w"), "line").select("line", "at", F.explode(_variants("w", F.col("key"), F.col("tail"), F.col("less"))).alias("v")).select("line", "at", "v.*")
    variants = written(emitted)
    met = variants.groupBy("variant").agg(*[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"a{k}") for k in range(3)], F.count(F.lit(1)).alias("rows")).where("rows > 1")
    # replaced: all are near each other; added or left out: short lines are near long ones
    first = F.when(F.col("kind") == 0, F.col("a0")).when(F.col("kind") == 1, F.col("a2")).otherwise(F.col("a1"))
    pairs = variants.join(met, "variant").select("line", "at", first.alias("to")).where("to < at").select("line", "to").distinct()
    theirs = words.select(F.col("at").alias("to"), F.col("w").alias("_w"))
    verified = pairs.join(words.select("line", "w"), "line").join(theirs, "to").where(_near(F.col("w"), F.col("_w")))
    near = verified.groupBy("line").agg(F.min("to").alias("near_at"))

    known = classes.select(F.col("line").alias("_line"), F.col("at").alias("first_at")).join(near.withColumnRenamed("line", "_near_line"), F.col("_line") == F.col("_near_line"), "left")
    judged = seen.select("at", "line").join(known, F.col("line") == F.col("_line"))
    later = F.col("at") > F.col("first_at")
    to = F.when(later, F.col("first_at")).otherwise(F.col("near_at"))
    return judged.where(later | F.col("near_at").isNotNull()).dropDuplicates(["at", "line"]).select(_doc_of(F.col("at")).alias("doc_id"), _line_of(F.col("at")).alias("line_no"), F.when(later, F.lit("equal")).otherwise(F.lit("near")).alias("like"), _doc_of(to).alias("first_doc"), _line_of(to).alias("first_line"))


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, all columns, their texts without the lines that repeated_lines() names. Rows without an id, and different texts under one id, stay as they are."""
    one = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.count_distinct(F.xxhash64(text_col)).alias("_texts")).where("_texts = 1")
    named = repeated_lines(docs, text_col, id_col, least_words).where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)], F.col(id_col).cast("long").alias("_of"))
    joined = plain.join(named.join(one, "_id"), F.col("_of") == F.col("_id"), "left").withColumnRenamed(inner[at], text_col)
    out = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[(out if k == at else F.col(n)).alias(c) for k, (c, n) in enumerate(zip(docs.columns, inner, strict=True))])


def line_report(docs: DataFrame) -> DataFrame:
    return repeated_lines(docs)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, line_no, regexp_extract_all(line, '[^\x{20}\x{09}-\x{0D}]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
), s AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, line_no) AS spot FROM l WHERE len(w) > 0),
c AS (SELECT w, min(spot) AS spot, row_number() OVER () AS class FROM s GROUP BY w),
v AS (SELECT class, i, len(w) AS n, list_concat(w[1 : i - 1], w[i + 1 : len(w)]) AS rest FROM (SELECT class, w, unnest(range(1, len(w) + 1)) AS i FROM c WHERE len(w) >= 4)),
p AS (
  SELECT a.class, b.class AS other FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.n = b.n AND a.class <> b.class
  UNION SELECT v.class, c.class FROM v JOIN c ON v.rest = c.w AND len(c.w) >= 4
  UNION SELECT c.class, v.class FROM v JOIN c ON v.rest = c.w AND len(c.w) >= 4
), near AS (SELECT p.class, min(o.spot) AS spot FROM p JOIN c m ON m.class = p.class JOIN c o ON o.class = p.other WHERE o.spot < m.spot GROUP BY p.class)
SELECT s.doc_id, CAST(s.line_no AS INT) AS line_no, CASE WHEN s.spot > c.spot THEN 'equal' ELSE 'near' END AS "like", t.doc_id AS first_doc, CAST(t.line_no AS INT) AS first_line
FROM s JOIN c ON s.w = c.w LEFT JOIN near ON near.class = c.class JOIN s t ON t.spot = CASE WHEN s.spot > c.spot THEN c.spot ELSE near.spot END
"""
