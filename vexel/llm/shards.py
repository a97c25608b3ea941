"""Sharding by best-fit-decreasing bin packing, the open bins in a balanced tree by remaining capacity.

Indivisible groups (equal texts) enter bins by falling size, each the tightest bin that holds it. Groups of one size are
a run: the bin that is tightest for the first of them stays tightest until it is full, so a run enters a bin at a time. The
driver packs runs, (size, number of groups). It gets a row for each size that some group has, at most sqrt(2 * all bytes)
whatever the groups are, and makes a row for each run and bin that meet. Groups take their bins by their rank among
those of their size, which prefix sums over slices give, and rows take theirs from their groups, by a join.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._slices import running_start
from ._tables import written

SHARDS = 16
#: The capacity of `shards` bins is found to one part in so many.
FINE = 2000
#: Groups of a run that one row stands for before it is spread out.
RUN_ROWS = 1 << 16


class _Node:
    __slots__ = ("key", "left", "right", "level")

    def __init__(self, key):
        self.key, self.left, self.right, self.level = key, None, None, 1


class CapacityTree:
    """An AA tree (balanced) of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    def add(self, key) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int):
        """The least (remaining, bin) with remaining >= size, or None."""
        node, best = self.root, None
        while node:
            if node.key >= (size, -1):
                best, node = node.key, node.left
            else:
                node = node.right
        return best

    @staticmethod
    def _skew(node):
        if node and node.left and node.left.level == node.level:
            up = node.left
            node.left, up.right = up.right, node
            return up
        return node

    @staticmethod
    def _split(node):
        if node and node.right and node.right.right and node.level == node.right.right.level:
            up = node.right
            node.right, up.left = up.left, node
            up.level += 1
            return up
        return node

    def _add(self, node, key):
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._add(node.left, key)
        else:
            node.right = self._add(node.right, key)
        return self._split(self._skew(node))

    def _remove(self, node, key):
        if node is None:
            raise KeyError(key)
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None and node.right is None:
            return None
        elif node.left is None:
            heir = node.right
            while heir.left:
                heir = heir.left
            node.key = heir.key
            node.right = self._remove(node.right, heir.key)
        else:
            heir = node.left
            while heir.right:
                heir = heir.right
            node.key = heir.key
            node.left = self._remove(node.left, heir.key)
        level = min(x.level if x else 0 for x in (node.left, node.right)) + 1
        if level < node.level:
            node.level = level
            if node.right and level < node.right.level:
                node.right.level = level
        node = self._skew(node)
        node.right = self._skew(node.right)
        if node.right:
            node.right.right = self._skew(node.right.right)
        node = self._split(node)
        node.right = self._split(node.right)
        return node


Run = tuple[int, int]  # size, number of groups
Part = tuple[int, int, int]  # size, the first of its run that is meant, how many


def best_fit_runs(runs: Iterable[Run], capacity: int) -> list[list[Part]]:
    """The bins' contents, by best fit, for runs of falling size. A group larger than the capacity has a bin to itself."""
    tree, bins = CapacityTree(), []
    for size, many in runs:
        first = 0
        while first < many:
            spot = tree.tightest(size)
            if spot is None:
                left, at = capacity, len(bins)
                bins.append([])
            else:
                left, at = spot
                tree.remove(spot)
            here = max(1, min(many - first, left // size))
            bins[at].append((size, first, here))
            first += here
            if left > here * size:
                tree.add((left - here * size, at))
    return bins


def load(parts: Iterable[Part]) -> int:
    return sum(size * many for size, _, many in parts)


def _halves(parts: list[Part]) -> tuple[list[Part], list[Part]]:
    """Two bins from one, each part dealt to make them even."""
    out, loads = ([], []), [0, 0]
    for size, first, many in parts:
        one = min(many, max(0, (loads[1] - loads[0] + many * size + size) // (2 * size)))
        for k, (at, n) in enumerate(((first, one), (first + one, many - one))):
            if n:
                out[k].append((size, at, n))
                loads[k] += n * size
    return out


def runs_into(runs: Iterable[Run], shards: int) -> list[list[Part]]:
    """Bins as by best_fit_runs(), `shards` of them if there are as many groups.

    A group larger than the average of the bins left has a bin to itself; the others get the least capacity, by
    bisection, that needs no more than the bins left. Bins that stay empty take half of the fullest ones' groups.
    """
    runs = sorted(((s, n) for s, n in runs if n), reverse=True)
    total, alone, taken = sum(s * n for s, n in runs), [], {}
    for size, many in runs:
        for k in range(many):
            if len(alone) == shards - 1 or size * (shards - len(alone)) <= total:
                break
            alone.append([(size, k, 1)])
            taken[size] = k + 1
            total -= size
        if taken.get(size, 0) < many:
            break
    rest, most = [(s, n - taken.get(s, 0)) for s, n in runs if n > taken.get(s, 0)], shards - len(alone)
    low = high = max(-(-total // most), 1)
    bins = best_fit_runs(rest, low)
    while len(bins) > most:
        high += -(-high // 64)
        bins = best_fit_runs(rest, high)
    while high - low > max(1, low // FINE):
        middle = (low + high) // 2
        found = best_fit_runs(rest, middle)
        if len(found) <= most:
            high, bins = middle, found
        else:
            low = middle
    while len(bins) < most and (full := [k for k, x in enumerate(bins) if sum(n for *_, n in x) > 1]):
        k = max(full, key=lambda k: load(bins[k]))
        bins[k], other = _halves(bins[k])
        bins.append(other)
    # ranks of the rest begin after those that stand alone
    return alone + [[(s, first + taken.get(s, 0), n) for s, first, n in x] for x in bins]


def _named(items: Iterable[tuple[int, str]], pack) -> tuple[dict[str, int], list[int]]:
    runs = {size: [name for _, name in same] for size, same in groupby(sorted(items, key=lambda x: (-x[0], x[1])), key=lambda x: x[0])}
    bins = pack([(size, len(names)) for size, names in runs.items()])
    return {name: k for k, x in enumerate(bins) for size, first, n in x for name in runs[size][first : first + n]}, [load(x) for x in bins]


def best_fit_decreasing(items: Iterable[tuple[int, str]], capacity: int) -> tuple[dict[str, int], list[int]]:
    """Bin of each item (size, name), and the bins' loads. An item larger than the capacity has a bin to itself."""
    return _named(items, lambda runs: best_fit_runs(runs, capacity))


def pack_into(items: Iterable[tuple[int, str]], shards: int) -> tuple[dict[str, int], list[int]]:
    """Bin of each item (size, name), and the bins' loads, as by runs_into()."""
    return _named(items, lambda runs: runs_into(runs, shards))


def assign_shards(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, all columns (or those in `keep`), with size long (UTF-8 bytes plus 1), shard int, slot long (from 0 without gaps in each shard).

    Equal texts share a shard; null texts are one group, apart from empty ones, each of size 1. Either `shards` is given,
    and sizes come out near equal but for groups above the average, each in a shard of its own, or `capacity`, and best
    fit opens as few bins of it as it finds; a group above the capacity has a shard to itself. Repeated rows are rows of
    their own. An empty table gives an empty result. Own columns named like the three new ones are replaced.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    own = [c for c in keep or docs.columns if c not in ("size", "shard", "slot")]
    inner = [f"_c{k}" for k in range(len(own))]
    # 96 bits of hash and the length: equal for equal texts alone
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, inner, strict=True)], F.col(id_col).cast("string").alias("_id"), F.xxhash64(text_col).alias("_a"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(-1)).alias("_b"), size.alias("_size"))
    # one row a group, in the shared folder: the totals and the packing read it, not the texts
    groups = written(marked.groupBy("_a", "_b", "_size").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")))
    n_groups, rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    sizes = groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    runs = sorted(zip(sizes.column("_bytes").to_pylist(), sizes.column("n").to_pylist(), strict=True), reverse=True)
    bins = runs_into(runs, shards) if shards else best_fit_runs(runs, capacity)
    parts = [(s, first, first + n - 1, k) for k, x in enumerate(bins) for s, first, n in x]
    packed = docs.sparkSession.createDataFrame(pa.table({c: pa.array([p[k] for p in parts], pa.int64()) for k, c in enumerate(("_of", "_from", "_to", "_shard"))}))
    stretches = packed.select("_of", "_shard", "_to", F.explode(F.sequence("_from", "_to", F.lit(RUN_ROWS))).alias("_at")).repartition("_of", "_at")
    spots = stretches.select("_of", F.col("_shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("_at"), F.least(F.col("_to"), F.col("_at") + RUN_ROWS - 1))).alias("_spot"))
    spread = lambda h: F.pmod(F.shiftrightunsigned(h, 11), F.lit(1 << 53)) / F.lit(float(1 << 53))
    ranked = running_start(groups, "_bytes", [F.col("_a"), F.col("_b"), F.col("_size")], F.lit(1), "_rank", n_groups, spread(F.col("_a")))
    by_group = ranked.join(spots, (F.col("_bytes") == F.col("_of")) & (F.col("_rank") == F.col("_spot"))).select(F.col("_a").alias("_ga"), F.col("_b").alias("_gb"), F.col("_size").alias("_gn"), "shard")
    placed = marked.join(written(by_group), (F.col("_a") == F.col("_ga")) & (F.col("_b") == F.col("_gb")) & (F.col("_size") == F.col("_gn")))
    placed = placed.withColumn("_key", F.xxhash64("_id", "_a")).select(*inner, F.col("_size").alias("size"), "shard", "_key")
    slotted = running_start(placed, "shard", [F.col("_key")], F.lit(1), "slot", rows, spread(F.col("_key")))
    return slotted.select(*[F.col(n).alias(c) for c, n in zip(own, inner, strict=True)], "size", "shard", "slot")


def shard_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; the law is `bytes`."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    found = assign_shards(narrow, keep=("doc_id", "text_crc32"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
