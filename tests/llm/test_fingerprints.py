import hashlib
import time

import xxhash
from pyspark.sql import functions as F

from vexel.llm import fingerprints


def xx(*values):
    """The hash of a row of strings, longs and ints (given as pairs)."""
    seed = 42
    for x in values:
        raw = x.encode() if isinstance(x, str) else x[0].to_bytes(x[1], "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed


def signature(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    grams = [xx(a, b) for a, b in zip(words, words[1:], strict=False)] or ([xx(*words)] if words else [])
    seen, pairs = {}, []
    for at, g in enumerate(grams):
        g %= 1 << 37
        seen[g] = seen.get(g, -1) + 1
        pairs.append((xx((g, 8), (seen[g], 4)) % (1 << 37), at))
    out = []
    for b in range(32):
        least = sorted(p for p in pairs if p[0] >> 32 == b)[:2]
        h = xx(*((h, 8) for h, at in sorted(least, key=lambda p: p[1])))
        out.append((h - (1 << 64) if h >= 1 << 63 else h) if least else None)
    return out


def likeness(a, b):
    either = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
    return sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / either if either else 1.0


def as_text(s):
    return ".".join("-" if x is None else f"{x % (1 << 64):x}" for x in s)


def brute(rows):
    """Rows of ids that are all different."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = set()
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        s, e, n = signature(text), signature(edited), signature(after)
        out.add((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(s), as_text(e), likeness(s, e), likeness(s, n)))
    return out


def report(spark, rows):
    return {tuple(r) for r in fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:120]
    rows += [(-5, None), (1 << 62, ""), (-(1 << 63), "one"), (-7, "a b " * 50), (-8, "a b " * 60), (-9, "ä\tö\n ü")]
    assert report(spark, rows) == brute(rows)


def test_rows_of_one_id_and_without_one(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rows = [(7, f"text {k} of the id seven") for k in range(40)] + [(None, f"text {k} without an id") for k in range(40)] + [(k, f"text {k}") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.text, r.next_text) for r in fingerprints.with_next(docs, "doc_id", "text").collect()]
    # each is the next of one: the order is a circle
    assert sorted(a for a, _ in got) == sorted(b for _, b in got) == sorted(t for _, t in rows)
    after = dict(got)
    assert [after[f"text {k}"] for k in range(39, 20, -1)] == [f"text {k}" for k in range(38, 19, -1)]
    ids = {t: i for i, t in rows}
    assert ids[after["text 20"]] == 7 and sum(ids[b] != ids[a] and ids[a] in (7, None) for a, b in got) == 2
    assert len(fingerprints.fingerprint_report(docs.union(docs)).collect()) == 200


def test_empty_table_clashing_columns_and_order(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (1, "a b c", "z", None)], "doc_id long, text string, signature string, _h string")
    assert fingerprints.fingerprint_report(docs).select("fingerprint").distinct().count() == 1
    assert fingerprints.fingerprint(docs.limit(0)).count() == fingerprints.fingerprint_report(docs.limit(0)).count() == 0
    two = [" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in [*range(200, 400), *range(200)])]
    assert signature(two[0]) != signature(two[1])


def test_long_texts_take_linear_time(spark):
    long = [(1, " ".join(f"w{i % 70_000}" for i in range(1_000_000))), (2, "a b " * 500_000)]
    began = time.time()
    got = spark.createDataFrame(long, "doc_id long, text string").select(fingerprints.signature(F.col("text")).alias("s")).collect()
    assert len(got) == 2 and time.time() - began < 60
