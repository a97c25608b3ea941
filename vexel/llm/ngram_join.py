"""N-gram Jaccard join by a token-group matrix: exact links and components of documents by shingle sets.

1. Sets. A document's set holds the hashes of its distinct word shingles; equal sets are one node.
2. Groups. Nodes that agree in a MinHash band are compared, exactly, with one node of the band only. What links is tied
   together, by connected components: near copies meet in one component however many they are, at one comparison each.
   A component's nodes of about one size (a step of 2**(1/16)) are a group.
3. Token-group matrix. All shingles stand in one order, rare ones first, then by how many documents hold them, then by
   hash. Of n shingles a set's first n - ceil(t n) + 1 are its prefix. The matrix holds, for each shingle, the groups with
   it in a member's prefix: a group's row is the union of its members' prefixes. An entry has the least and the greatest
   size of those members, and the greatest size of a partner with which one of them can still link if the shingle is
   the first that both share: of a set of n, n - i shingles are left from place i on, and with one of m it has to share
   t (n + m) / (1 + t).
4. Bound. Two groups of different components whose entries of a shingle allow a link by these sizes qualify; the first
   shared shingle of any two sets that link passes, so no link is lost. All other groups stay closed.
5. Open. The sets of the lighter group of a pair that qualifies go to the blocks of the other's sets, and each is
   compared there with the whole block at once. What links ties the components together.
6. Links. The sets of each component meet its blocks in the same way, which counts every document's links.

Set names and shingles are 64-bit hashes. Comparisons use whole sets. Pairs of sets are never rows: rows are sets and
the blocks they visit, at most one row for each set and block. Counting links inside a component of near copies takes
time in the square of its different texts (not of copies), in blocks dealt over all tasks.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._tables import drop, written
from ._words import chunks, mix

SHINGLE, SIMILARITY = 5, 0.75
BANDS, BAND_ROWS = 6, 2
#: Shingles that at least FREQUENT_LEAST documents hold have a place in the order by a broadcast table, FREQUENT_MOST at most
#: from each of two counts, the most frequent ones: the first of shingles that a block of documents holds twice, the second
#: an exact one of prefixes that the first leaves. The table only orders shingles; results don't depend on it.
FREQUENT_LEAST, FREQUENT_MOST = 8, 1 << 21
#: Shingles that a task packs at once.
BLOCK_SHINGLES = 1 << 20
#: Shingles of the sets that stand in one block of an opened group, about.
OPEN_SHINGLES = 1 << 20
#: Sets that are compared with one anchor in one place.
HUB_ROWS = 256
#: Bits a document, and at most, of the filter that names the documents whose sets are shipped. Fuller, it lets more sets
#: through, never fewer.
FILTER_RATE, FILTER_MOST = 16, 1 << 28
#: Steps of set size to a doubling, in groups.
SIZE_STEPS = 16
#: Postings in a bucket of the matrix.
BUCKET_POSTINGS = 1 << 20
LEAST_BUCKETS = 64
#: Pairs of entries that are expanded at once.
PAIR_BLOCK = 1 << 21

_SEEDS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text, in order; a text of fewer words is one shingle, without words none."""
    for _, w in chunks(texts):
        hashes = w.windows(size)
        for k in range(len(w)):
            a, b = int(w.first[k]), int(w.first[k + 1])
            if b - a >= size:
                yield np.unique(hashes[a : b - size + 1])
            elif b > a:
                whole = w.hashes[a:b]
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in whole:
                        h = h * np.uint64(0xD6E8FEB86659FD93) + x
                yield mix(np.array([h], np.uint64) + np.uint64(0xABCD))
            else:
                yield np.empty(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(tokens * np.uint64(3) + np.uint64(11))) + tokens.sum() * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _least(n: int, t: Fraction) -> int:
    """ceil(t n): shingles that a set of n shares with any that links."""
    return -(-n * t.numerator // t.denominator)


def _survey(size: int):
    """A row for each document: its id, set size, node and bands. And rows of shingles seen twice in a block, with times."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("token", pa.int64()), ("seen", pa.int64())])

    def several(parts):
        tokens, seen = np.unique(np.concatenate(parts), return_counts=True)
        tokens, seen = tokens[seen > 1].view(np.int64), seen[seen > 1]
        for at in range(0, len(tokens), 100_000):
            t, n = tokens[at : at + 100_000], seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(t), f.type) for f in list(schema)[:4]), pa.array(t), pa.array(n, pa.int64())], schema=schema)

    def run(batches):
        parts, held, nodes = [], 0, set()
        for batch in batches:
            n, node, bands = [], [], []
            for tokens in shingle_sets(batch.column(1), size):
                n.append(len(tokens))
                node.append(own := node_of(tokens))
                if not len(tokens):
                    bands.append(None)
                    continue
                low = mix(np.array([mix(tokens ^ s).min() for s in _SEEDS]) + _SEEDS).reshape(BANDS, BAND_ROWS)
                bands.append(mix(low.sum(axis=1)).view(np.int64).tolist())
                if own not in nodes:  # copies in a block count once
                    nodes.add(own)
                    parts.append(tokens)
                    held += len(tokens)
                    if held > 2 * BLOCK_SHINGLES:
                        yield from several(parts)
                        parts, held, nodes = [], 0, set()
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)
        if parts:
            yield from several(parts)

    return run


def _prefix(tokens: np.ndarray, order: tuple[np.ndarray, np.ndarray], t: Fraction, rare_only: bool = False) -> np.ndarray:
    """Of a set's sorted shingles those that no link can miss, in the order: rare ones first, then by class of frequency."""
    known, classes = order
    take = len(tokens) - _least(len(tokens), t) + 1
    if len(known) and len(tokens):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        common = known[at] == tokens
        if common.any():
            rare = tokens[~common]
            if rare_only or len(rare) >= take:
                return rare[:take]
            tokens = np.concatenate([rare, tokens[common][np.argsort(classes[at[common]], kind="stable")]])
    return tokens[:take]


def _eligible(size: int, t: Fraction, buckets: int, shared):
    """By bucket, packed: the rare shingles of prefixes by the first count; of copies in a block, one document's."""
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary())])

    def emit(parts):
        tokens = np.concatenate(parts)
        bucket = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens, cuts = tokens[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, tokens[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches):
        parts, held, seen = [], 0, set()
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), size):
                if len(tokens) and (node := node_of(tokens)) not in seen:
                    seen.add(node)
                    parts.append(_prefix(tokens, shared.value, t, rare_only=True))
                    held += len(parts[-1])
                    if held > BLOCK_SHINGLES:
                        yield emit(parts)
                        parts, held, seen = [], 0, set()
        if parts:
            yield emit(parts)

    return run


def _frequent(least: int):
    """Rows sorted by bucket: the shingles that at least so many documents hold, with how many."""
    schema = pa.schema([("token", pa.int64()), ("seen", pa.int64())])

    def found(parts):
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens[n >= least].view(np.int64)), pa.array(n[n >= least], pa.int64())], schema=schema)

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and parts:
                    yield found(parts)
                    parts = []
                bucket = b
                parts.append(np.frombuffer(raw.as_buffer(), np.uint64))
        if parts:
            yield found(parts)

    return run


def _ordered(counts: DataFrame, before: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their classes of frequency: `before` and the FREQUENT_MOST most frequent, at most, of counts (token, seen)."""
    classed = counts.where(F.col("seen") >= FREQUENT_LEAST).select("token", F.floor(F.log2("seen") * 2).cast("int").alias("class"))
    room, lowest = FREQUENT_MOST, 1 << 30
    for r in classed.groupBy("class").count().orderBy(F.desc("class")).collect():  # some hundred classes at most
        if r["count"] > room:
            break
        room, lowest = room - r["count"], r["class"]
    found = classed.where(F.col("class") >= lowest).toArrow()
    tokens = np.concatenate([before[0], found.column("token").to_numpy().view(np.uint64)])
    classes = np.concatenate([before[1], found.column("class").to_numpy().astype(np.uint8)])
    by = np.argsort(tokens)
    return tokens[by], classes[by]


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter with two hashes of the longs in column id, as words; made where the rows are, of bounded size."""
    marks = ids.select(F.explode(F.array(F.xxhash64("id", F.lit(1)), F.xxhash64("id", F.lit(2)))).alias("h")).select(F.pmod("h", F.lit(bits)).alias("bit"))
    rows = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _sets(size: int, shared):
    """node, n, tokens of the documents that the filter lets through."""
    schema = pa.schema([("own_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        words = shared.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for k in (2, 3):
                h = batch.column(k).to_numpy(zero_copy_only=False)
                keep &= (words[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(keep))
            out = [(node_of(t), len(t), t.tobytes()) for t in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], schema=schema)

    return run


def _meet(t: Fraction):
    """Rows sorted by place, block, role, node: a block's own sets (role 0), then those that visit it.

    Yields, for each visitor that links with sets of the block, itself left out: one of them, and how many documents have them.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("documents", pa.int64())])

    def index(sets):
        sizes = np.array([len(x) for x in sets])
        if len(sets) == 1:
            return sizes, sets[0], np.zeros(len(sets[0]), np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(tokens, kind="stable")
        return sizes, tokens[by], owner[by]

    def run(batches):
        here, last, nodes, copies, sets, ready = None, None, [], [], [], None
        for batch in batches:
            found = []
            for place, size_class, block, role, node, n, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
                if here != (place, size_class, block):
                    here, last, nodes, copies, sets, ready = (place, size_class, block), None, [], [], [], None
                if last == (role, node):  # a repeated row of one document
                    continue
                last = (role, node)
                mine = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    nodes.append(node)
                    copies.append(n)
                    sets.append(mine)
                    continue
                if ready is None:
                    ready = (np.array(nodes), np.array(copies), *index(sets))
                    sets = []
                names, times, sizes, tokens, owner = ready
                low, high = np.searchsorted(tokens, mine), np.searchsorted(tokens, mine, "right")
                many = high - low
                at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                both = np.bincount(owner[at], minlength=len(names))
                linked = np.flatnonzero((both * t.denominator >= t.numerator * (len(mine) + sizes - both)) & (names != node))
                if len(linked):
                    found.append((node, int(names[linked[0]]), int(times[linked].sum())))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], schema=schema)

    return run


VISIT = ("place", "size_class", "block", "role", "node", "copies")


def _visits(docs: DataFrame, sent: DataFrame, size: int, t: Fraction) -> DataFrame:
    """a, b, documents of _meet(), written, for sent: a row for each set and block, with VISIT and id, the set's document."""
    sent = written(sent.select(*VISIT, "id"))
    wanted = sent.select("id").distinct()
    bits = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_RATE * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted, bits))
    spots = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(bits)).alias(f"_h{k}") for k in (1, 2)]
    sets = docs.where("doc_id is not null").select("doc_id", "text", *spots).mapInArrow(_sets(size, shared), "own_id bigint, own_node bigint, n bigint, tokens binary")
    routed = sets.join(sent.hint("shuffle_hash"), (F.col("own_id") == F.col("id")) & (F.col("own_node") == F.col("node"))).select(*VISIT, "tokens")
    dealt = routed.repartition("place", "size_class", "block").sortWithinPartitions("place", "size_class", "block", "role", "node").select(*VISIT, "tokens")
    out = written(dealt.mapInArrow(_meet(t), "a bigint, b bigint, documents bigint"))
    drop(sent)
    return out


def _prefixes(size: int, t: Fraction, shared):
    """id, node and the prefix of each document's set, in order."""
    schema = pa.schema([("own_id", pa.int64()), ("node", pa.int64()), ("prefix", pa.binary())])

    def run(batches):
        for batch in batches:
            node, prefix = [], []
            for tokens in shingle_sets(batch.column(1), size):
                node.append(node_of(tokens))
                prefix.append(_prefix(tokens, shared.value, t).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(prefix, pa.binary())], schema=schema)

    return run


#: Columns of the matrix: the shingle (32 bits beside its bucket; one that shares them only adds pairs to open), the group
#: (component and step of size), least and greatest size of its members there, and the greatest size of a partner.
ENTRY = (("token", np.uint32), ("root", np.int64), ("step", np.uint16), ("low", np.uint32), ("high", np.uint32), ("reach", np.int64))


def _union(token, root, step, low, high, reach):
    """Entries, one for each shingle and group, sorted by shingle."""
    order = np.lexsort((step, root, token))
    token, root, step, low, high, reach = (x[order] for x in (token, root, step, low, high, reach))
    new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (root[1:] != root[:-1]) | (step[1:] != step[:-1])])
    return token[new], root[new], step[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), np.maximum.reduceat(reach, new)


def _postings(buckets: int, t: Fraction):
    """The matrix's entries of a task's sets (root, step, n, prefix), a group's united, packed by bucket of the shingle."""
    schema = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name, _ in ENTRY)])

    def emit(held):
        sizes = [len(h[0]) for h in held]
        root, step, n = (np.repeat(np.array([h[k] for h in held], np.int64), sizes) for k in (1, 2, 3))
        place = np.concatenate([np.arange(x) for x in sizes])
        reach = (n - place) * (t.numerator + t.denominator) // t.numerator - n
        mixed = mix(np.concatenate([h[0] for h in held]))
        mixed, *entry = _union(mixed, root, step, n, n, reach)
        bucket = (mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # rises with mixed
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        columns = [x.astype(kind) for x, (_, kind) in zip((mixed, *entry), ENTRY, strict=True)]
        rows = [(b, *(c[x:y].tobytes() for c in columns)) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for *group, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                held.append((np.frombuffer(raw.as_buffer(), np.uint64), *group))
                n += len(held[-1][0])
                if n > BLOCK_SHINGLES:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def _qualifying(t: Fraction):
    """Buckets' rows, sorted by bucket: pairs of groups of different components that an entry lets link.

    Of a shingle's entries, sorted by least size, each looks at those before it: as small as a partner may be, as large as
    it reaches, and reaching as far as its own least size. Entries that don't reach their own size are looked at by none.
    Pairs are expanded in blocks.
    """
    schema = pa.schema([("a_root", pa.int64()), ("a_step", pa.int32()), ("b_root", pa.int64()), ("b_step", pa.int32())])
    num, den = t.numerator, t.denominator

    def pairs(*entries):
        token, root, step, low, high, reach = _union(*entries)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(token)]))
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)  # components
        keep = np.flatnonzero(several[run])
        keep = keep[np.lexsort((low[keep], run[keep]))]
        if not len(keep):
            return
        run, root, step, low, high, reach = run[keep], root[keep], step[keep].astype(np.int64), low[keep].astype(np.int64), high[keep].astype(np.int64), reach[keep]
        own = np.flatnonzero(reach >= low)  # those that are looked at
        key = (run[own] << 33) + low[own]
        # a group's greatest size is less than 1.05 times its least
        start = np.searchsorted(key, (run << 33) + np.maximum(low * num * 100 // (den * 105) - 1, 0))
        end = np.searchsorted(key, (run << 33) + np.minimum(low, np.maximum(reach, 0)), "right")
        end = np.minimum(end, np.searchsorted(own, np.arange(len(run))))  # those before
        many = np.maximum(end - start, 0)
        ends, at = np.cumsum(many), 0
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BLOCK, "right")))
            m = many[at:stop]
            if m.sum():
                a = np.repeat(np.arange(at, stop), m)
                b = own[np.repeat(start[at:stop], m) + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)]
                fit = (reach[b] >= low[a]) & (high[b] * den >= num * low[a]) & (root[a] != root[b])
                a, b = a[fit], b[fit]
                turned = root[a] > root[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                order = np.lexsort((step[b], root[b], step[a], root[a]))
                columns = [root[a][order], step[a][order], root[b][order], step[b][order]]
                new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(a) else []
                for x in range(0, len(new), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[new[x : x + 100_000]]).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            at = stop

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for b, *packed in zip(batch.column(0).to_pylist(), *(batch.column(1 + k) for k in range(len(ENTRY))), strict=True):
                if b != bucket and held:
                    yield from pairs(*(np.concatenate([h[k] for h in held]) for k in range(len(ENTRY))))
                    held = []
                bucket = b
                held.append([np.frombuffer(x.as_buffer(), kind) for x, (_, kind) in zip(packed, ENTRY, strict=True)])
        if held:
            yield from pairs(*(np.concatenate([h[k] for h in held]) for k in range(len(ENTRY))))

    return run


def _blocks(tokens):
    return F.greatest(F.lit(1), F.ceil(tokens / OPEN_SHINGLES)).cast("int")


def _block_of(node, blocks):
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def similar_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each document; component_id is the smallest doc_id that links reach, itself included, n_links the number of other documents that it links with.

    Two documents link if the Jaccard likeness of their sets of `size`-word shingles (A-Z lower-cased, words
    [^\\x20\\x09-\\x0D]+) is at least `similarity`. A text of fewer words is one shingle; a null text or one without
    words has none, and links with nothing. Equal sets link. A document without an id links with nothing and has no
    component. Repeated rows are rows of their own, each linked with the others. An empty table gives an empty result.
    Other columns are not read.
    """
    t = Fraction(similarity).limit_denominator(10_000)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    survey = written(docs.mapInArrow(_survey(size), "doc_id bigint, n bigint, node bigint, bands array<bigint>, token bigint, seen bigint"))
    rows = survey.where("token is null").select("doc_id", "n", "node", "bands")
    nodes = written(rows.where("n > 0 and doc_id is not null").groupBy("node", "n").agg(F.min("doc_id").alias("id"), F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies")))

    banded = nodes.select("node", "id", F.posexplode("bands").alias("band", "key"))
    shared_bands = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("there")).where("there > 1")
    banded = written(banded.join(shared_bands, ["band", "key"]))
    # of copies, the one that shares its bands with most others is the likeliest to link with them all
    weight = banded.groupBy("node").agg(F.sum("there").alias("weight"))
    anchors = banded.join(weight, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node", "id")).alias("anchor"))
    near = written(banded.join(anchors, ["band", "key"]).where("node <> anchor.node").select(F.col("anchor.node").alias("a"), F.col("anchor.id").alias("a_id"), F.col("node").alias("b"), F.col("id").alias("b_id")).distinct())
    hubs = near.groupBy("a", "a_id").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("parts"))
    plain = [F.lit(0).alias("size_class"), F.lit(0).cast("long").alias("copies")]
    anchored = hubs.select(F.col("a").alias("place"), F.col("a").alias("node"), F.col("a_id").alias("id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(0).alias("role"), *plain)
    asking = near.join(hubs.select("a", "parts"), "a").select(F.col("a").alias("place"), F.col("b").alias("node"), F.col("b_id").alias("id"), _block_of("b", F.col("parts")).alias("block"), F.lit(1).alias("role"), *plain)
    links = _visits(docs, anchored.unionByName(asking), size, t)
    grouped = _merged(nodes.select("node", "n", "id", F.col("node").alias("root")), links)
    for done in (banded, near, links):
        drop(done)

    order = (np.empty(0, np.uint64), np.empty(0, np.uint8))
    order = _ordered(survey.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")), order)
    postings = nodes.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * float(t)) + 1), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-postings // BUCKET_POSTINGS) * 2)
    shared = spark.sparkContext.broadcast(order)
    eligible = docs.where("doc_id is not null").select("text").mapInArrow(_eligible(size, t, buckets, shared), "bucket int, tokens binary")
    counted = written(eligible.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_frequent(FREQUENT_LEAST), "token bigint, seen bigint"))
    shared = spark.sparkContext.broadcast(_ordered(counted, order))
    drop(counted)

    step = F.floor(F.log2("n") * SIZE_STEPS).cast("int")
    prefixes = docs.where("doc_id is not null").mapInArrow(_prefixes(size, t, shared), "own_id bigint, own_node bigint, prefix binary")
    joined = prefixes.join(grouped.select("node", "n", "id", "root"), (F.col("own_id") == F.col("id")) & (F.col("own_node") == F.col("node"))).select("root", step.alias("step"), "n", "prefix")
    packed = joined.mapInArrow(_postings(buckets, t), "bucket int, " + ", ".join(f"{name} binary" for name, _ in ENTRY))
    found = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_qualifying(t), "a_root bigint, a_step int, b_root bigint, b_step int")
    qualifying = written(found.distinct())

    members = grouped.withColumn("step", step)
    groups = members.groupBy("root", "step").agg(F.sum("n").alias("tokens"))
    weighed = qualifying
    for x in "ab":
        weighed = weighed.join(groups.select(F.col("root").alias(f"{x}_root"), F.col("step").alias(f"{x}_step"), F.col("tokens").alias(f"{x}_tokens")), [f"{x}_root", f"{x}_step"])
    # the lighter group visits
    group = lambda x: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("tokens", "root", "step")])
    turned = weighed.select(F.least(group("a"), group("b")).alias("guest"), F.greatest(group("a"), group("b")).alias("host"))
    opening = written(turned.select("guest.root", "guest.step", F.col("host.root").alias("place"), F.col("host.step").alias("size_class"), _blocks(F.col("host.tokens")).alias("blocks")))
    none = F.lit(0).cast("long").alias("copies")
    hosts = members.withColumnsRenamed({"root": "place", "step": "size_class"}).join(opening.select("place", "size_class", "blocks").distinct(), ["place", "size_class"]).select("place", "size_class", _block_of("node", F.col("blocks")).alias("block"), F.lit(0).alias("role"), "node", none, "id")
    guests = members.join(opening, ["root", "step"]).select("place", "size_class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node", none, "id")
    links = _visits(docs, hosts.unionByName(guests), size, t)
    last = _merged(grouped, links)
    for done in (qualifying, opening, links):
        drop(done)

    # links: the sets of each component visit its blocks
    copies = last.join(nodes.select(F.col("node").alias("_node"), F.col("n").alias("_n"), "copies"), (F.col("node") == F.col("_node")) & (F.col("n") == F.col("_n"))).select("node", "n", "id", "root", "copies")
    several = last.groupBy("root").agg(F.count(F.lit(1)).alias("there"), _blocks(F.sum("n")).alias("blocks")).where("there > 1").drop("there")
    placed = written(copies.join(several, "root").select(F.col("root").alias("place"), F.lit(0).alias("size_class"), "blocks", "node", "copies", "id"))
    hosts = placed.select("place", "size_class", _block_of("node", F.col("blocks")).alias("block"), F.lit(0).alias("role"), "node", "copies", "id")
    guests = placed.select("place", "size_class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node", "copies", "id")
    linked = _visits(docs, hosts.unionByName(guests), size, t).groupBy(F.col("a").alias("_linked")).agg(F.sum("documents").alias("others"))
    drop(placed)

    named = last.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = copies.join(named, "root").join(linked, F.col("node") == F.col("_linked"), "left").select(F.col("node").alias("_node"), F.col("n").alias("_n"), "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    judged = rows.join(by_node, (F.col("node") == F.col("_node")) & (F.col("n") == F.col("_n")), "left")
    # without shingles there is no node: each such document is its own component
    known = F.col("doc_id").isNotNull()
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(known, F.col("component_id")))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(known & (F.col("n") > 0), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, n, id, root) after links (a, b): links between components alone, each once, tie them together."""
    root = groups.select("node", "root")
    between = links.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
    found = components(between.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return written(groups.join(found.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left").select("node", "n", "id", F.coalesce("into", "root").alias("root")))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x) l USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
