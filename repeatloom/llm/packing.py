"""Filling fixed-capacity containers: combinations that fill a container exactly, then best fit for the rest."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.shared import written

#: Items of a block, about; within a block the items of one size are numbered in one sorted run.
BLOCK = 65_536


class Plan:
    """Which items go where, by length: for each length, consecutive ranks [first, first + n) go to the containers
    base, base + 1, ... Its size depends on the number of different lengths only, not on that of the items."""

    def __init__(self) -> None:
        self.slots: list[tuple[int, int, int, int]] = []  # length, first rank, n, base container
        self.fills: list[tuple[int, int, int]] = []  # base container, n, fill
        self.containers = 0
        self._used: dict[int, int] = {}

    def add(self, lengths: tuple[int, ...], n: int) -> None:
        """n containers, each with items of these lengths."""
        for x in lengths:
            first = self._used.get(x, 0)
            self.slots.append((x, first, n, self.containers))
            self._used[x] = first + n
        self.fills.append((self.containers, n, sum(lengths)))
        self.containers += n


class SumIndex:
    """Single lengths, pairs and triples by their sums, under the counts that are left. Counts only go down, so what a sum has found used up
    is never looked at again: each sum keeps the place from which on its pairs, or triples, may still be there."""

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, int] = {}  # sum: largest member that may still be there
        self.triples: dict[int, int] = {}

    def pair(self, total: int, top: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the larger at most top; the largest one possible."""
        have, start = self.have, self.pairs.get(total, total - 1)
        at = min(start, top, len(have) - 1)
        low = (total + 1) // 2
        while at >= low:
            big = np.arange(at, max(low, at - 255) - 1, -1)
            small = total - big
            fits = np.flatnonzero((have[big] > 0) & (have[small] > (big == small)))
            if len(fits):
                at = int(big[fits[0]])
                break
            at = int(big[-1]) - 1
        if start <= top:
            self.pairs[total] = at
        return (at, total - at) if at >= low else None

    def complement(self, gap: int, top: int) -> tuple[int, ...] | None:
        """One, two or three available lengths, none above top, that fill a gap exactly."""
        have = self.have
        if gap <= top and have[gap] > 0:
            return (gap,)
        if two := self.pair(gap, top):
            return two
        start = self.triples.get(gap, gap - 2)
        x, found = min(start, top, gap - 2), None
        while 3 * x >= gap and not found:
            if have[x] > 0:
                have[x] -= 1
                two = self.pair_under(gap - x, x)
                have[x] += 1
                if two:
                    found = (x, *two)
                    break
            x -= 1
        if start <= top:
            self.triples[gap] = x
        return found

    def pair_under(self, total: int, top: int) -> tuple[int, int] | None:
        """pair, while one item of a length is taken out for a moment: what is missing now may be there again, so nothing is noted."""
        noted = self.pairs.get(total)
        two = self.pair(total, top)
        if noted is None:
            self.pairs.pop(total, None)
        else:
            self.pairs[total] = noted
        return two


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """counts: how many items there are of each length from 1 to capacity.

    From the longest length down: complements of one, two or three available lengths that fill its
    containers exactly are used for as many containers as their counts allow, so every step
    uses up a length. What has no exact complement is packed by best fit, longest first: into the
    fullest open containers it fits, all containers of a kind at once, or else into new ones.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    plan, index = Plan(), SumIndex(have)
    plan.add((capacity,), int(have[capacity])) if have[capacity] else None
    rest: dict[int, int] = {}
    for a in range(capacity - 1, 0, -1):
        while have[a] > 0:
            have[a] -= 1
            found = index.complement(capacity - a, a)
            have[a] += 1
            if not found:
                rest[a], have[a] = int(have[a]), 0
                break
            lengths = (a, *found)
            n = min(int(have[x]) // lengths.count(x) for x in set(lengths))
            for x in lengths:
                have[x] -= n
            plan.add(lengths, n)
    kinds: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in kinds:
            kinds[gap] = []
            insort(gaps, gap)
        kinds[gap].append((lengths, n))

    for a, n in rest.items():  # longest first
        while n:
            k = bisect_left(gaps, a)
            if k == len(gaps):
                each = capacity // a
                if n >= each:
                    put((a,) * each, n // each)
                if n % each:
                    put((a,) * (n % each), 1)
                break
            gap = gaps[k]
            lengths, m = kinds[gap].pop()
            take = min(m, n)
            if m > take:
                kinds[gap].append((lengths, m - take))
            if not kinds[gap]:
                del kinds[gap], gaps[k]
            put((*lengths, a), take)
            n -= take
    for groups in kinds.values():
        for lengths, n in groups:
            plan.add(lengths, n)
    return plan


_PLACED = "item_id long, piece int, length int, container_no long, fill int"


class Kind:
    """One kind of container: the plan by length, and where the pieces of items above the capacity stand among the items of their length.

    An item is known by its size and its rank among those of its size. Of a size above the capacity each item has the same number of whole pieces and the
    same rest, so the ranks of pieces follow from the counts by size: whole items of a length come first, then the pieces of each larger size in turn."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        large = np.array(sorted(x for x in counts if x > capacity), np.int64)
        n = np.array([counts[x] for x in large.tolist()], np.int64)
        self.large, self.whole = large, (large - 1) // capacity
        rest = large - self.whole * capacity
        by_length = {x: c for x, c in counts.items() if 0 < x <= capacity}
        self.first_whole = by_length.get(capacity, 0) + np.cumsum(self.whole * n) - self.whole * n
        if len(large):
            by_length[capacity] = by_length.get(capacity, 0) + int((self.whole * n).sum())
        self.first_rest = np.zeros(len(large), np.int64)
        for i, (r, c) in enumerate(zip(rest.tolist(), n.tolist(), strict=True)):
            self.first_rest[i] = by_length.get(r, 0)
            by_length[r] = by_length.get(r, 0) + c
        self.plan = plan = plan_packing(by_length, capacity)
        length, first, _, base = (np.array(x, np.int64) for x in zip(*plan.slots, strict=True)) if plan.slots else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((first, length))
        self.key, self.shift = (length[order] << 44) + first[order], (base - first)[order]
        self.bases, self.fills = (np.array([f[k] for f in plan.fills], np.int64) for k in (0, 2))

    def pieces(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, piece, length and rank among that length of every piece of some items."""
        row, piece, length, at = np.arange(len(size)), np.zeros(len(size), np.int64), size.copy(), rank.copy()
        big = np.flatnonzero(size > self.capacity)
        if len(big):
            k = np.searchsorted(self.large, size[big])
            whole = self.whole[k]
            owner = np.repeat(np.arange(len(big)), whole)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            piece[big], length[big], at[big] = whole, size[big] - whole * self.capacity, self.first_rest[k] + rank[big]  # the rest
            row = np.concatenate([row, big[owner]])
            piece = np.concatenate([piece, number])
            length = np.concatenate([length, np.full(len(owner), self.capacity)])
            at = np.concatenate([at, self.first_whole[k][owner] + rank[big][owner] * whole[owner] + number])
        return row, piece, length, at

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Container and its fill of every piece; pieces of length 0 are spread over all containers."""
        if not len(self.key):
            return np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        no = rank + self.shift[np.maximum(np.searchsorted(self.key, (length << 44) + rank, side="right") - 1, 0)]
        no = np.where(length == 0, rank % max(1, self.plan.containers), no)
        return no, self.fills[np.maximum(np.searchsorted(self.bases, no, side="right") - 1, 0)]


def _ranked(items: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """item_id, size and rank among the items of that size (from 0), and the counts by size: as many rows as there are different sizes."""
    n = F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long"))
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.greatest(n, F.lit(0).cast("long")).alias("size"))
    own = written(own, "sizes")
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(_blocks(own))).cast("int"))
    # The first rank of each block within each size: blocks x sizes rows, far fewer than items.
    w = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(own.groupBy("size", "block").count().withColumn("offset", F.coalesce(F.sum("count").over(w), F.lit(0))), "offsets")
    counts = {r["size"]: r["n"] for r in offsets.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    within = Window.partitionBy("size", "block").orderBy("item_id")  # a sorted run, never held whole
    ranked = own.withColumn("r", F.row_number().over(within)).join(offsets.select("size", "block", "offset"), ["size", "block"])
    return ranked.select("item_id", "size", (F.col("offset") + F.col("r") - 1).alias("rank")), counts


def _placed(ranked: DataFrame, kinds: list[tuple[int, Kind]]) -> DataFrame:
    """All pieces of all items in each kind, by the plans that every task gets."""
    sent = ranked.sparkSession.sparkContext.broadcast(kinds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, size, rank = b["item_id"], b["size"].to_numpy().astype(np.int64), b["rank"].to_numpy().astype(np.int64)
            for number, kind in sent.value:
                row, piece, length, at = kind.pieces(size, rank)
                no, fill = kind.places(length, at)
                same = lambda x: pa.array(np.full(len(row), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(number), same(kind.capacity), item.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(no), pa.array(fill.astype(np.int32))],
                    names=["container_id", "capacity", "item_id", "piece", "length", "container_no", "fill"],
                )

    return ranked.mapInArrow(place, "container_id int, capacity int, " + _PLACED)


def pack(items: DataFrame, capacity: int) -> tuple[DataFrame, Plan]:
    """Every item's container: item_id, piece, length, container_no (from 0), fill (of that container).

    items: item_id (unique), size; items larger than the capacity come in pieces of the capacity and a rest; a null or negative size counts as 0. Only the
    counts by size come to the driver, whatever the number of items. The plan made of them, as long as there are lengths, is
    broadcast; items are numbered within their size by block counts, so a size that many items
    share is never in one task. Items of length 0 are spread over the containers; if there is none, they are in
    container 0 of fill 0. No items give no rows.
    """
    ranked, counts = _ranked(items)
    kind = Kind(counts, capacity)
    return _placed(ranked, [(0, kind)]).drop("container_id", "capacity"), kind.plan


def _blocks(items: DataFrame) -> int:
    return max(1, -(-items.count() // BLOCK))


def pack_kinds(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """All items into containers of each kind. kinds: container_id, capacity, a short list of kinds. Gives container_id,
    item_id, piece, length, container_no, capacity, fill. Kinds of null or no capacity hold nothing. Items are counted and
    numbered once for all kinds."""
    ranked, counts = _ranked(items)
    listed = kinds.select("container_id", "capacity").where("capacity >= 1").distinct().orderBy("container_id").collect()
    return _placed(ranked, [(k["container_id"], Kind(counts, k["capacity"])) for k in listed]).select("container_id", "capacity", *[x.split()[0] for x in _PLACED.split(", ")])
