"""Document fingerprints by order MinHash, in DataFrame functions only.

The k-mers of a text are runs of GRAM words, each numbered by its occurrence, so that repeats count. The pairs (k-mer,
occurrence) are hashed, and the hash deals them over BINS; of all pairs in a bin the TUPLE least stay, in the order of the
text, and the tuple is hashed. A bin agrees between two texts if the same k-mers were chosen and stand in the same order,
so likeness falls with edit distance, moved passages included.

Within a text, a k-mer is 37 bits of hash above its position in one long, so that sorting longs groups k-mers, each in
the order of the text. An array of strings takes 16 bytes a word at least and 2**31 in all, so positions have room.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, BINS, TUPLE = 2, 32, 2
PLACE_BITS = 27
PLACE = (1 << PLACE_BITS) - 1
#: Texts in a range of ids, about, when the next document's text is fetched; from MAX_RANGES on, ranges grow instead.
RANGE_ROWS, MAX_RANGES = 2048, 10_000


def _let(value: Column, body):
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pack(h: Column, i: Column) -> Column:
    return F.shiftleft(h, PLACE_BITS).bitwiseOR(i)


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE).cast("long"))


def _heads(xs: Column, key) -> Column:
    """The places, from 0, at which the key differs from the one before."""
    return F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(xs, i - 1))), i)), lambda i: i.isNotNull())


def _kmers(words: Column) -> Column:
    several = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) >= GRAM, several).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _numbered(packed: Column) -> Column:
    """Sorted packed k-mers to sorted packed hashes of (k-mer, occurrence). Run lengths give the occurrences, in one pass."""
    pair = lambda x, occurrence: _pack(F.xxhash64(_high(x), occurrence), _place(x))

    def from_heads(heads):
        lengths = F.zip_with(heads, F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(F.size(packed))), lambda a, b: b - a)
        occurrences = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))
        repeated = F.zip_with(packed, occurrences, pair)
        return F.sort_array(F.when(F.size(heads) == F.size(packed), F.transform(packed, lambda x: pair(x, F.lit(0)))).otherwise(repeated))

    return _let(_heads(packed, _high), from_heads)


def _bins(pairs: Column) -> Column:
    """Sorted packed pairs to a hash for each bin, null for those without pairs. Sorted, a bin's pairs stand together."""
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - (BINS - 1).bit_length()).cast("int")

    def tuple_at(i):
        least = F.filter(F.slice(pairs, i + 1, F.lit(TUPLE)), lambda x: bin_of(x) == bin_of(F.get(pairs, i)))
        in_order = F.array_sort(F.transform(least, lambda x: F.struct(_place(x).alias("at"), _high(x).alias("h"))))
        return F.struct(bin_of(F.get(pairs, i)).alias("bin"), F.xxhash64(F.transform(in_order, lambda x: x["h"])).alias("hash"))

    def spread(found):
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(F.filter(found, lambda x: x["bin"] == b), F.lit(0))["hash"])

    return _let(F.transform(_heads(pairs, bin_of), tuple_at), spread)


def signature(text: Column) -> Column:
    """BINS longs; null for a bin without k-mers. A text without words has nulls only, one of fewer than GRAM words one k-mer."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    packed = _let(words, lambda w: _let(_kmers(w), lambda g: F.sort_array(F.transform(g, lambda h, i: _pack(h, i.cast("long"))))))
    return _let(packed, lambda s: _let(_numbered(s), _bins))


def likeness(a: Column, b: Column) -> Column:
    """The share of bins, of those that either has, in which two signatures agree; 1 if neither has any."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def as_text(signature_: Column) -> Column:
    return F.array_join(F.transform(signature_, lambda x: F.lower(F.hex(x))), ".", "-")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with signature array<bigint> and fingerprint string, in the place of own columns of these names.

    A null or empty text has the signature of no k-mers; repeated rows are rows of their own; an empty table gives an empty result.
    """
    return docs.withColumn("signature", signature(F.coalesce(F.col(text_col), F.lit("")))).withColumn("fingerprint", as_text(F.col("signature")))


def _below(cuts: list[int], x: Column) -> Column:
    """The number of sorted cuts below x, by every step-th cut and then those of one step."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs]).cast("array<bigint>")
    count = lambda xs: F.size(F.filter(xs, lambda c: c < x))
    coarse = count(longs(cuts[step - 1 :: step])) * step
    return _let(coarse, lambda n: n + count(F.slice(longs(cuts), n + 1, F.lit(step))))


def with_next(docs: DataFrame, id_col: str, text_col: str, derive=None) -> DataFrame:
    """docs with next_<column> for the text and what `derive` adds: those of the next document, descending id; after the last, the first.

    Null ids stand last; rows of one id, or without one, stand by a hash of their texts. The order is cut into ranges, an id
    with many rows into several by the hash; each range also gets the first row of the range after it, and the last gets
    the first of all, so that one shuffle of the rows and a window in each range do. Repeated rows (one id, one text)
    share a range. `derive` adds columns to the rows before they move, to each once.
    """
    own = [c for c in docs.columns if c not in ("_o", "_h", "_range", "_guest")]
    keyed = docs.select(*own, F.bitwise_not(F.col(id_col).cast("long")).alias("_o"), F.xxhash64(text_col).alias("_h"))  # ~id falls as the id rises
    rows, nulls = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_o").isNull().cast("long")), F.lit(0))).first()
    ranges = max(1, min(rows // RANGE_ROWS, MAX_RANGES))
    found = keyed.agg(F.percentile_approx("_o", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10 * ranges)).first()[0] if ranges > 1 else []
    often = {c: n + 1 for c, n in Counter(found or []).items() if n > 1}
    cuts = sorted({*(found or []), *(c - 1 for c in often if c > -(1 << 63))})
    parts = {bisect_left(cuts, c): n for c, n in often.items()} | {len(cuts) + 1: max(1, min(nulls // RANGE_ROWS, MAX_RANGES))}
    spot = F.when(F.col("_o").isNull(), F.lit(len(cuts) + 1)).otherwise(_below(cuts, F.col("_o")))
    u = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 11) / F.lit(float(1 << 53))  # rises with the hash
    part = _let(spot, lambda s: F.struct(s.alias("spot"), F.floor(u * F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), s), F.lit(1))).cast("int").alias("part")))
    placed = keyed.withColumn("_range", part)
    first = placed.groupBy("_range").agg(F.min(F.struct("_o", "_h")).alias("_first")).orderBy("_range").collect()  # a row a range
    lent = [(*r["_range"], *r["_first"], *first[k - 1]["_range"]) for k, r in enumerate(first)]
    lenders = docs.sparkSession.createDataFrame(lent, "_s int, _p int, _ro bigint, _rh bigint, _ts int, _tp int")
    mine = (F.col("_range.spot") == F.col("_s")) & (F.col("_range.part") == F.col("_p")) & F.col("_o").eqNullSafe(F.col("_ro")) & (F.col("_h") == F.col("_rh"))
    firsts = placed.join(F.broadcast(lenders), mine).groupBy("_ts", "_tp").agg(F.first("_o").alias("_o"), F.first("_h").alias("_h"), F.min(text_col).alias(text_col))
    guests = firsts.select(F.col(text_col), "_o", "_h", F.struct(F.col("_ts").alias("spot"), F.col("_tp").alias("part")).alias("_range"), F.lit(1).alias("_guest"))
    both = placed.withColumn("_guest", F.lit(0)).unionByName(guests, allowMissingColumns=True)
    led = derive(both) if derive else both
    lead = [text_col, *[c for c in led.columns if c not in both.columns]]
    order = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_last("_o"), "_h", text_col)
    led = led.withColumns({f"next_{c}": F.lead(c).over(order) for c in lead})
    return led.where("_guest = 0").drop("_o", "_h", "_range", "_guest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(texts, "doc_id", "text", lambda rows: rows.withColumn("signature", signature(F.col("text"))))
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    changed = led.select("doc_id", n.cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited")).withColumn("edited_signature", signature(F.col("edited")))
    return changed.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
