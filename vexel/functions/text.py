"""Text expressions: tokens, query variants, overlap, whitespace; chunks and a hashing embedder in numpy over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import InvalidRequest

SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


TOKEN = r"\p{IsAlphabetic}\p{N}"
_token_points: list[np.ndarray] = []


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{TOKEN}]+"), "")  # compiled, as lambdas are not


def token_points(spark: SparkSession) -> np.ndarray:
    """For each code point whether tokens() keeps it. The JVM is asked, once: Python knows other Unicode versions."""
    if not _token_points:
        character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = spark.range(0x110000).where(character.rlike(f"[{TOKEN}]")).toArrow()
        kept = np.zeros(0x110000, bool)
        kept[found["id"].to_numpy()] = True
        _token_points.append(kept)
    return _token_points[0]


def words(text: Column) -> Column:
    """The distinct lower-cased \\w+ of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def overlap(query: Column, text: Column) -> Column:
    """The share of the query's words that the text has."""
    q = words(query)
    return F.size(F.array_intersect(q, words(text))) / F.greatest(F.size(q), F.lit(1))


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def expand_query(query: Column) -> Column:
    """The query trimmed, lower-cased, and as its words of over two letters, in their case, if there are two; distinct, three at most."""
    q = F.regexp_replace(query, f"^{SPACE}+|{SPACE}+$", "")
    long = F.filter(F.regexp_extract_all(q, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.char_length(w) > 2)
    joined = F.when(F.size(long) >= 2, F.array(F.array_join(long, " "))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(q, F.lower(q)), joined), lambda x: x != "")), 1, 3)


def _points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _last(marks: np.ndarray) -> np.ndarray:
    """For each place from 0 to the end, one more than the greatest marked place below it; 0 if there is none."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.maximum.accumulate(np.where(marks, np.arange(1, len(marks) + 1), 0), out=out[1:])
    return out


def spans(text: str, size: int, shared: int) -> list[tuple[int, int]]:
    """Where chunk_text() cuts a trimmed text.

    For every place at once: where a chunk that starts there ends, and where the next one starts. The chunks are what is
    reached from 0.
    """
    n = len(text)
    place = np.arange(n)
    end = np.minimum(place + size, n)
    space = _last(_points(text) == 32)[end] - 1  # the last space below the end
    end = np.where((end < n) & (space > place), space, end)
    following = np.maximum(end - shared, place + 1)
    out, at = [], 0
    while not out or out[-1][1] < n:
        out.append((at, int(end[at])))
        at = int(following[at])
    return out


def chunk_text(text: str | None, size: int = 512, overlap_chars: int = 64) -> list[str]:
    """Pieces of at most `size` characters of the trimmed text, trimmed themselves, none empty.

    A piece that isn't the last ends before the last space past its start, if it has one. The next starts `overlap_chars`
    before that end, but past the start. A null or blank text has no pieces.
    """
    if size <= 0 or overlap_chars < 0:
        raise ValueError("size must be above 0 and overlap not below")
    text = (text or "").strip()
    pieces = [text[a:b].strip() for a, b in (spans(text, size, overlap_chars) if text else [])]
    return [p for p in pieces if p]


def chunk_pages(pages: list[str], size: int = 1200, overlap_chars: int = 150) -> list[dict]:
    """idx, text, page (from 1, of the first character), char_start, char_end of chunks over all pages.

    Pages, whitespace collapsed, stand with a space after each but the last; empty ones count but take no place. A chunk
    starts at each multiple of size - overlap, until one reaches the end; an end that isn't the last moves back behind
    white space, to four fifths of the size at most. Size is kept in [100, 8192]; an overlap below 0 is 0, one of at
    least the size a quarter of it.
    """
    size = min(8192, max(100, size))
    shared = 0 if overlap_chars < 0 else size // 4 if overlap_chars >= size else overlap_chars
    clean = [re.sub(SPACE + "+", " ", p or "").strip() for p in pages]
    parts = [p + " " * (k + 1 < len(clean)) if p else "" for k, p in enumerate(clean)]
    text, page = "".join(parts), np.repeat(np.arange(1, len(parts) + 1), [len(p) for p in parts])
    start = np.arange(0, len(text), size - shared)
    end = np.minimum(start + size, len(text))
    back = np.maximum(_last(np.isin(_points(text), SPACES))[end], start + size * 4 // 5)
    end = np.where(end < len(text), back, end)
    reached = int(np.argmax(end == len(text))) + 1 if len(text) else 0
    found = [(int(a), int(b), text[a:b].strip()) for a, b in zip(start[:reached], end[:reached], strict=True)]
    return [{"idx": k, "text": piece, "page": int(page[a]), "char_start": a, "char_end": b} for k, (a, b, piece) in enumerate(x for x in found if x[2])]


CHUNK_TYPE = "array<struct<idx:int,text:string>>"
PAGE_CHUNK_TYPE = "array<struct<idx:int,text:string,page:int,char_start:int,char_end:int>>"


def chunks(text: Column, size: int = 512, overlap_chars: int = 64) -> Column:
    @F.pandas_udf(CHUNK_TYPE)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"idx": i, "text": c} for i, c in enumerate(chunk_text(t, size, overlap_chars))])

    return cut(text)


def page_chunks(pages: DataFrame, size: int = 1200, overlap_chars: int = 150) -> DataFrame:
    """id, idx, text, page, char_start, char_end from rows (id, page from 1, text); a page that is missing is empty.

    The pages of one document meet in one row; documents are small beside a task.
    """

    @F.pandas_udf(PAGE_CHUNK_TYPE)
    def cut(documents: pd.Series) -> pd.Series:
        def one(rows):
            texts = [""] * max((r["page"] for r in rows), default=0)
            for r in rows:
                texts[r["page"] - 1] = r["text"]
            return chunk_pages(texts, size, overlap_chars)

        return documents.map(one)

    own = pages.where("page >= 1").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "text"))).alias("pages"))
    return own.select("id", F.inline(cut("pages")))


#: fixed values: a key's hash starts at 5381 and takes 33 times itself plus each character, modulo 2**32; keys are
#: "u", tab, word; "b", tab, word, tab, next word; "c", tab, three letters; their weights:
HASH_START, HASH_FACTOR = 5381, 33
FEATURE_WEIGHTS = {"u": 1.0, "b": 0.7, "c": 0.3}

_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(97, 123), 95]] = True


def hash_embeddings(texts: list[str | None], dimension: int) -> np.ndarray:
    """A unit vector for each text: weighted counts of its hashed words, pairs of words and runs of three letters.

    Words are [a-z0-9_]+ of the lower-cased text; a text without words has the zero vector. The hash is a polynomial, so
    prefix sums over all texts give that of any run of characters, and features are counted for all texts at once.
    """
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _ASCII_WORD[data]
    edge = np.diff(np.r_[False, inside].astype(np.int8), append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, "right")
    n = len(data) + 1
    power, inverse = np.ones(n, np.uint32), np.ones(n, np.uint32)
    power[1:], inverse[1:] = HASH_FACTOR, pow(HASH_FACTOR, -1, 1 << 32)
    power, inverse = (np.multiply.accumulate(x, dtype=np.uint32) for x in (power, inverse))
    total = np.zeros(n, np.uint32)
    np.cumsum(data.astype(np.uint32) * inverse[:-1], out=total[1:], dtype=np.uint32)

    def after(h, a, b):
        """Hashes h carried on over the characters from a to b."""
        return h * power[b - a] + (total[b] - total[a]) * power[b - 1]

    def key(kind):
        h = HASH_START
        for c in (ord(kind), 9):
            h = (h * HASH_FACTOR + c) % (1 << 32)
        return np.uint32(h)

    single = after(key("u"), starts, ends)
    pair = np.flatnonzero(text_of[1:] == text_of[:-1])
    double = after(after(key("b"), starts[pair], ends[pair]) * np.uint32(HASH_FACTOR) + np.uint32(9), starts[pair + 1], ends[pair + 1])
    three = np.flatnonzero(inside[:-2] & inside[1:-1] & inside[2:])
    triple = after(key("c"), three, three + 3)
    of_three = text_of[np.searchsorted(starts, three, "right") - 1] if len(three) else three
    out = np.zeros(len(raw) * dimension)
    for kind, owner, h in (("u", text_of, single), ("b", text_of[pair], double), ("c", of_three, triple)):
        out += FEATURE_WEIGHTS[kind] * np.bincount(owner * dimension + (h % np.uint32(dimension)).astype(np.int64), minlength=len(out))
    out = out.reshape(len(raw), dimension)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def hash_embed(text: str | None, dimension: int) -> list[float]:
    return hash_embeddings([text], dimension)[0].tolist()


#: Characters of text that are embedded at once; the working arrays take some 60 bytes for each.
EMBED_CHARS = 1 << 20


def embedder(dimension: int, function=None):
    """A pandas UDF from text to array<float>; `function(text) -> list` replaces the hashing embedder and is checked."""
    if dimension <= 0:
        raise InvalidRequest("an embedding needs a dimension above 0")

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if function:
                found = texts.map(lambda t: list(function(t)))
                if any(len(x) != dimension for x in found):
                    raise ValueError(f"the embedding function must return {dimension} numbers")
                yield found
                continue
            own = [t if isinstance(t, str) else None for t in texts]
            sizes, out, at = np.cumsum([len(t or "") for t in own]), [], 0
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + EMBED_CHARS, "right")))
                out += list(hash_embeddings(own[at:stop], dimension).astype(np.float32))
                at = stop
            yield pd.Series(out, index=texts.index)

    return embed


def embed_strategy(dimension: int, model_dimension: int = 768) -> str:
    """`model` for collections of the model's dimension, else `hash`."""
    return "model" if dimension > 0 and dimension == model_dimension else "hash"
