"""Long exact spans shared between records: a count-min prefilter, then exact grouping of what may repeat."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.shared import written

#: Letters of a window, and how many of them the first of its two code words holds.
WINDOW, FIRST = 48, 32
#: Letters taken at once: bounds the memory of a task.
CHUNK_LETTERS = 1_500_000
#: Two rows of counters; each row has at most this many (8 MB as bits).
DEPTH, MAX_WIDTH = 2, 1 << 26
#: Counters of a block: what one reducer merges.
BLOCK = 1 << 19
#: Partial sketches that one reducer merges at a time.
FAN_IN = 64
#: Windows of the input for each bucket of the exact pass; a bucket gets those that may repeat.
PER_BUCKET = 1 << 21

#: Bins whose windows are counted (8 MB of counts); while there are fewer buckets each is a bin of its own.
MOST_BINS = 1 << 20
#: Times the usual number of windows from which on a bin's buckets are spread: of bins that are one bucket, and of those that are several.
HOT_LOAD, HOT_LOAD_OF_MANY = 4, 1.5
#: Partitions whose candidates meet in one group; with more of them a bucket is grouped in a tree.
EXACT_FAN_IN = 1024

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the first 32 and of the last 16 letters of the window at each place, and of 16 letters from each place."""
    words, width = code.astype(np.uint64), 1
    while width < FIRST:
        if width == WINDOW - FIRST:
            half = words
        words = (words[:-width] << np.uint64(2 * width)) | words[width:]
        width *= 2
    n = len(code) - WINDOW + 1
    return words[:n], half[FIRST : FIRST + n], half


class _Chunk:
    """All windows of some records. hi and lo: codes of the first 32 and the last 16 letters,
    two bits each, so equal pairs are equal windows; rec and pos: record and place in it; part: a number
    made of the least of the window's 16-letter parts, which neighbouring windows mostly share."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        code = _CODE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        self.code, self.ids, self.starts = code, ids, ends - ends[0]
        n = len(code) - WINDOW + 1
        if n < 1:
            self.hi = self.lo = self.part = self.hash = np.zeros(0, np.uint64)
            self.rec = self.pos = np.zeros(0, np.int64)
            return
        bad = np.zeros(len(code) + 1, np.int32)
        np.cumsum(code == 4, out=bad[1:])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends))
        good = np.flatnonzero((bad[WINDOW:] == bad[:n]) & (owner[WINDOW - 1 :] == owner[:n]))
        hi, lo, half = _words(code)
        least, width = _mix(half), 1
        while width < FIRST:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        self.part = _mix(np.minimum(least[:-1], least[1:])[good])
        self.hi, self.lo, self.rec = hi[good], lo[good], owner[good]
        self.pos = good - self.starts[self.rec]
        self.hash = _mix(self.hi ^ _mix(self.lo + np.uint64(0xD6E8FEB86659FD93)))

    def cells(self, row: int, width: int) -> np.ndarray:
        x = self.hash if row == 0 else _mix(self.hash + np.uint64(0xA0761D6478BD642F * row & (1 << 64) - 1))
        return (x & np.uint64(width - 1)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    held, letters = [], 0

    def chunk() -> _Chunk:
        t = pa.Table.from_batches(held).combine_chunks()
        text = t["text"].chunk(0)
        if not pc.all(pc.string_is_ascii(text)).as_py():
            text = pc.replace_substring_regex(text, "[^\\x00-\\x7f]", ".")  # places count letters, not bytes
        return _Chunk(t["rec_id"].to_numpy(), text)

    for b in batches:
        held.append(b)
        letters += b["text"].nbytes
        if letters >= CHUNK_LETTERS:
            yield chunk()
            held, letters = [], 0
    if held:
        yield chunk()


_PART = "node int, block int, planes binary"


def _part(node: int, block: int, planes: bytes) -> pa.Table:
    return pa.table({"node": pa.array([node], pa.int32()), "block": pa.array([block], pa.int32()), "planes": pa.array([zlib.compress(planes, 1)], pa.binary())})


def _sketch(batches: Iterator[pa.RecordBatch], width: int, buckets: int, bins: int) -> Iterator[pa.RecordBatch]:
    """Of each block of counters with any count: two bit planes, at least one and at least two. As block -1 the
    number of windows by bin of buckets."""
    from pyspark import TaskContext

    node = TaskContext.get().partitionId()
    count, load = np.zeros((DEPTH, width), np.uint8), np.zeros(bins, np.int64)
    for c in _chunks(batches):
        load += np.bincount((c.part % np.uint64(buckets)).astype(np.int64) % bins, minlength=bins)
        for row in range(DEPTH):
            cells = np.sort(c.cells(row, width))
            first = np.ones(len(cells), bool)
            first[1:] = cells[1:] != cells[:-1]
            own = count[row]
            own[cells[~first]] = 2
            once = cells[first]
            own[once] = np.minimum(own[once] + 1, 2)
    yield from _part(node, -1, load.tobytes()).to_batches()
    step = min(BLOCK, width)
    for row in range(DEPTH):
        for k in range(width // step):
            part = count[row, k * step : (k + 1) * step]
            if part.any():
                yield from _part(node, row * (width // step) + k, np.packbits(part >= 1).tobytes() + np.packbits(part >= 2).tobytes()).to_batches()


def _merge_blocks(key: tuple, t: pa.Table) -> pa.Table:
    """Sketches of one block as one: at least two where one has two or both have one. Numbers by bucket are added."""
    node, block = key[0].as_py(), key[1].as_py()
    parts = (zlib.decompress(x.as_py()) for x in t["planes"])
    if block < 0:
        return _part(node, block, sum(np.frombuffer(x, np.int64) for x in parts).tobytes())
    one = two = None
    for x in parts:
        a, b = np.frombuffer(x, np.uint8).reshape(2, -1)
        one, two = (a, b) if one is None else (one | a, two | b | (one & a))
    return _part(node, block, one.tobytes() + two.tobytes())


def _stretches(rec: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, first and last place of each row of consecutive windows; rec and pos are sorted."""
    new = np.ones(len(rec), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rec))[: len(first)] - 1
    return rec[first], pos[first], pos[last]


def _packed(x: np.ndarray) -> bytes:
    """Integers that are small as a rule, a byte plane at a time."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _gather(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places from each first one on, n of them."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


#: kind 0: stretches of candidate windows; 1: of windows known to be shared, for others to meet; 2: answers. node: the partition, or the group of partitions.
_ENTRY = "node int, bucket int, kind int, rec_id binary, pos binary, n binary, letters binary"


def _entry(node: int, bucket: int, kind: int, ids: np.ndarray, pos: np.ndarray, n: np.ndarray, letters: np.ndarray | None = None) -> pa.RecordBatch:
    packed = b""
    if letters is not None:
        four = np.concatenate([letters, np.zeros(-len(letters) % 4, np.uint8)]).reshape(-1, 4)
        packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()
    binary = {"rec_id": _packed(np.diff(ids, prepend=0)), "pos": _packed(pos), "n": _packed(n), "letters": packed}
    return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in binary.items()})


def _candidates(batches: Iterator[pa.RecordBatch], twice: list[np.ndarray], width: int, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows that the sketch says occur twice. Of those in one chunk with the same letters one is
    sent on, as shared if they lie in different records; the others' answer is known here. Windows next to
    each other that go to one bucket are sent as one stretch of letters."""
    from pyspark import TaskContext

    node = TaskContext.get().partitionId()
    for c in _chunks(batches):
        maybe = np.ones(len(c.hi), bool)
        for r in range(DEPTH):
            cells = c.cells(r, width)
            maybe &= (twice[r][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(maybe)
        if not len(at):
            continue
        hi, lo, rec, pos = c.hi[at], c.lo[at], c.rec[at], c.pos[at]
        order = np.lexsort((rec, lo, hi))
        h, w, r = hi[order], lo[order], rec[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(order)) - 1
        sure = r[start] != r[end]  # records are sorted within a window
        own = (c.part[at] % np.uint64(buckets)).astype(np.int64)
        # A bucket with far too many windows is spread by the windows' own hash.
        bucket = np.where(hot[own % len(hot)], buckets + ((c.hash[at] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), own)
        known = np.sort(order[np.repeat(sure, end - start + 1)])
        if len(known):
            recs, a, b = _stretches(rec[known], pos[known])
            yield _entry(node, int(c.ids[0] % buckets), 2, c.ids[recs], a, b - a + 1)
        # Of a window again and again within one record all places have to be answered.
        lone = order[np.repeat(~sure, end - start + 1)]
        for kind, take in ((0, lone), (1, order[start[sure]])):
            take = np.sort(take)
            if not len(take):
                continue
            recs, places, to = rec[take], pos[take], bucket[take]
            cut = np.ones(len(take), bool)
            cut[1:] = (recs[1:] != recs[:-1]) | (places[1:] != places[:-1] + 1) | (to[1:] != to[:-1])
            first = np.flatnonzero(cut)
            n = np.diff(np.append(first, len(take)))
            by = np.argsort(to[first], kind="stable")
            for x in np.split(by, np.flatnonzero(np.diff(to[first][by])) + 1):
                f = first[x]
                letters = c.code[_gather(c.starts[recs[f]] + places[f], n[x] + WINDOW - 1)]
                yield _entry(node, int(to[f[0]]), kind, c.ids[recs[f]], places[f], n[x], letters)


class _Met(NamedTuple):
    """The candidate windows of a group in the order of their letters: record and place (-1 for a window known to be shared), codes, whether it
    is known, where each window's rows start and how many there are, and which windows are shared."""

    rec: np.ndarray
    pos: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    known: np.ndarray
    start: np.ndarray
    size: np.ndarray
    shared: np.ndarray


def _answers(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rec, at, n = np.cumsum(_unpacked(x["rec_id"])), _unpacked(x["pos"]), _unpacked(x["n"])
    return rec, at, at + n - 1


def _met(rows: list[dict]) -> _Met | None:
    """The candidates of a bucket, grouped by their letters."""
    ids, pos, hi, lo, sure = [], [], [], [], []
    for x in rows:
        rec, at, n = np.cumsum(_unpacked(x["rec_id"])), _unpacked(x["pos"]), _unpacked(x["n"])
        four = np.frombuffer(x["letters"], np.uint8)
        h, w, _ = _words(np.stack([four >> 6, four >> 4 & 3, four >> 2 & 3, four & 3], axis=1).ravel())
        places = _gather(np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1), n)
        hi.append(h[places])
        lo.append(w[places])
        sure.append(np.full(len(places), x["kind"] == 1))
        ids.append(np.repeat(rec, n) if x["kind"] == 0 else np.full(len(places), -1))
        pos.append(_gather(at, n))
    if not hi:
        return None
    i, p, h, w, s = map(np.concatenate, (ids, pos, hi, lo, sure))
    order = np.lexsort((i, w, h))
    i, p, h, w, s = i[order], p[order], h[order], w[order], s[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(h)))
    return _Met(i, p, h, w, s, start, size, np.logical_or.reduceat(s, start) | (i[start] != i[start + size - 1]))


def _told(m: _Met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the rows whose windows are shared."""
    hit = np.repeat(m.shared, m.size) & ~m.known
    i, p = m.rec[hit], m.pos[hit]
    order = np.lexsort((p, i))
    return _stretches(i[order], p[order])


def _exact(key: tuple, t: pa.Table) -> pa.Table:
    """The answers of a bucket."""
    rows = t.to_pylist()
    out = [_answers(x) for x in rows if x["kind"] == 2]
    if m := _met([x for x in rows if x["kind"] != 2]):
        out.append(_told(m))
    return _found(out)


def _found(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"rec_id": pa.array(cols[0].astype(np.int64)), "first": pa.array(cols[1].astype(np.int64)), "last": pa.array(cols[2].astype(np.int64))})


def _known_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _found([_answers(x) for x in b.to_pylist()]).to_batches()


def _sent_on(node: int, bucket: int, kind: int, m: _Met, at: np.ndarray) -> list[pa.RecordBatch]:
    """These rows as one entry: windows next to each other in a record as a stretch of letters."""
    if not len(at):
        return []
    at = at[np.lexsort((m.pos[at], m.rec[at]))]
    rec, pos = (m.rec[at], m.pos[at]) if kind == 0 else (np.zeros(len(at), np.int64), 2 * np.arange(len(at)))
    new = np.ones(len(at), bool)
    new[1:] = (rec[1:] != rec[:-1]) | (pos[1:] != pos[:-1] + 1)
    shifts = lambda n: np.uint64(2) * np.arange(n - 1, -1, -1, dtype=np.uint64)
    letters = np.concatenate([m.hi[at, None] >> shifts(FIRST), m.lo[at, None] >> shifts(WINDOW - FIRST)], axis=1).astype(np.uint8) & 3
    take = np.zeros(letters.shape, bool)
    take[new] = True
    take[:, -1] = True
    first = np.flatnonzero(new)
    return [_entry(node, bucket, kind, rec[first], pos[first], np.diff(np.append(first, len(at))), letters[take])]


def _reduced(key: tuple, t: pa.Table) -> pa.Table:
    """The candidates of a bucket from some partitions: answers of what is shared among them, and of every window one row to meet the others."""
    node, bucket = key[0].as_py(), key[1].as_py()
    rows, out = t.to_pylist(), []
    if m := _met(rows):
        rec, first, last = _told(m)
        if len(rec):
            out.append(_entry(node, bucket, 2, rec, first, last - first + 1))
        out += _sent_on(node, bucket, 1, m, m.start[m.shared])
        out += _sent_on(node, bucket, 0, m, np.flatnonzero(~np.repeat(m.shared, m.size)))
    return pa.Table.from_batches(out) if out else t.slice(0, 0).select([x.split()[0] for x in _ENTRY.split(", ")])


_FOUND = "rec_id long, first long, last long"


def shared_spans(records: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """Maximal stretches of each record covered by 48-letter windows that other records hold too.

    records: rec_id (unique, not negative) and text; windows have only the letters A, C, G, T.
    Gives rec_id, span_start, span_end (0-based, end exclusive), one row for each stretch; windows
    that overlap or touch make one stretch. Records with null or short texts have none.

    First pass: partial count-min sketches, DEPTH rows of counters that stop at two, merged block
    by block; as wide as there are windows, up to max_width counters a row, so what is broadcast
    has at most DEPTH * max_width bits (16 MB). Beyond that width the sketch lets more windows
    pass, none is lost. Second pass: windows counted twice or more are grouped exactly by their
    letters in buckets. Neighbouring windows mostly go to the same one, so they are sent as a stretch of
    letters, two bits each; buckets of a bin with more than HOT_LOAD times its share of windows are spread over as
    many more by the hash of whole windows. A window that many records hold is sent once by each chunk of
    records; from EXACT_FAN_IN partitions on, a bucket is grouped in a tree, in which every group sends each of its windows on
    once, so no group holds more rows of one window than that many partitions have chunks.
    """
    spark = records.sparkSession
    rows = records.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("text").alias("text")).where(F.length("text") >= WINDOW)
    windows = rows.agg(F.sum(F.length("text") - (WINDOW - 1))).first()[0] or 0
    width = 1 << 12
    while width < min(2 * windows, max_width):
        width *= 2
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // PER_BUCKET))
    bins = min(buckets, MOST_BINS)
    nodes = rows.rdd.getNumPartitions()
    merged, left = rows.mapInArrow(lambda it: _sketch(it, width, buckets, bins), _PART), nodes
    while True:
        merged = merged.groupBy(F.floor(F.col("node") / FAN_IN).cast("int").alias("up"), "block").applyInArrow(_merge_blocks, _PART)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    step = min(BLOCK, width)
    twice, load = [np.zeros(width // 8, np.uint8) for _ in range(DEPTH)], np.zeros(bins, np.int64)
    for x in merged.toLocalIterator():  # two bits a counter at most, and MOST_BINS numbers
        if x["block"] < 0:
            load = np.frombuffer(zlib.decompress(x["planes"]), np.int64)
            continue
        row, k = divmod(x["block"], width // step)
        twice[row][k * step // 8 : (k + 1) * step // 8] = np.frombuffer(zlib.decompress(x["planes"]), np.uint8).reshape(2, -1)[1]
    sent = spark.sparkContext.broadcast((twice, load > (HOT_LOAD if bins == buckets else HOT_LOAD_OF_MANY) * max(1, windows) / bins))
    entries = rows.mapInArrow(lambda it: _candidates(it, *sent.value[:1], width, sent.value[1], buckets), _ENTRY)
    answers = []
    while nodes > EXACT_FAN_IN:
        entries = written(entries, "candidates")
        answers.append(entries.where("kind = 2").mapInArrow(_known_answers, _FOUND))
        entries = entries.where("kind < 2").groupBy(F.floor(F.col("node") / EXACT_FAN_IN).cast("int").alias("up"), "bucket").applyInArrow(_reduced, _ENTRY)
        nodes = -(-nodes // EXACT_FAN_IN)
    found = entries.groupBy("bucket").applyInArrow(_exact, _FOUND)
    for more in answers:
        found = found.unionByName(more)
    # Stretches that overlap or touch are one: islands in the order of their beginnings.
    order = Window.partitionBy("rec_id").orderBy("first", "last")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.when(F.col("first") > F.max("last").over(before) + WINDOW, 1).otherwise(0)
    islands = found.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("rec_id", "island").agg(F.min("first").cast("int").alias("span_start"), (F.max("last") + WINDOW).cast("int").alias("span_end"))
    return spans.select("rec_id", "span_start", "span_end")


def shared_extent(records: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """Of each record: number of shared stretches, letters in them, and their share of the text.
    Records without any, null and empty texts included, come with zeros."""
    spans = shared_spans(records, max_width).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    n = F.coalesce("n_shared", F.lit(0))
    return records.select(F.col("rec_id").cast("long").alias("rec_id"), F.length("text").alias("n")).join(spans, "rec_id", "left").select(
        "rec_id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), n.alias("n_shared"), F.when(F.col("n") > 0, n / F.col("n")).otherwise(0.0).alias("share")
    )
