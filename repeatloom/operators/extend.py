"""Extending blocks along the k-mer graph: anchors, walks, contigs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.functions.dna import canonical, revcomp, solid_letters
from repeatloom.operators.kmers import MAX_COUNT, bins_of, contexts, count_kmers, odd, solid, windows
from repeatloom.operators.letters import bin_of, counted_codes, kmer_codes, kmer_stretches, placed_codes, reversed_codes, windows_of
from repeatloom.shared import drop, fresh_path, spread, written

MAX_STEPS = 1024
#: Most solid k-mers that are sent to all tasks (64 MB); walks in a larger graph go from part to part of it.
MOST_SENT = 8_000_000
#: Solid k-mers in a part of a larger graph, about; and walks that are sent to the parts at once.
PART, SENT_WALKS = 400_000, 400_000
#: Walks taken at once by a task.
WALKS = 512


def anchors(blocks: DataFrame, solid_kmers: DataFrame, k: int) -> DataFrame:
    """Where the walks of each block begin: the first solid k-mer left of the repeat (idx_left is its end; one past
    the repeat's start if none is solid), the last one right of it (idx_right is its start; the repeat's end if none is solid).
    Blocks whose sides are shorter than k on the left or on the right are left out."""
    k = odd(k)
    own = _long_enough(blocks, k)
    left_text, right_text = _sides()
    left = F.transform(windows(left_text, k), lambda w, i: F.struct(F.lit("left").alias("side"), i.alias("pos"), canonical(w).alias("kmer")))
    right = F.transform(windows(right_text, k), lambda w, i: F.struct(F.lit("right").alias("side"), i.alias("pos"), canonical(w).alias("kmer")))
    hits = own.select("block_id", F.inline(F.concat(left, right))).join(solid_kmers.select("kmer"), "kmer", "left_semi")
    found = hits.groupBy("block_id").agg(F.min(F.when(F.col("side") == "left", F.col("pos"))).alias("i"), F.max(F.when(F.col("side") == "right", F.col("pos"))).alias("j"))
    return _anchored(own, found, k)


def _sides() -> tuple[Column, Column]:
    """The letters of a block on both sides of its repeat."""
    return F.substr("s", F.lit(1), F.col("zstart")), F.expr("substr(s, zend + 1)")


def _long_enough(blocks: DataFrame, k: int) -> DataFrame:
    own = blocks.select("block_id", F.col("start").alias("zstart"), F.col("end").alias("zend"), "seq", solid_letters(F.col("seq")).alias("s"))
    return own.where((F.col("zstart") >= k) & (F.length("seq") - F.col("zend") >= k))


def _anchored(own: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """anchors, from the places of the first solid k-mer on the left (i) and the last on the right (j) of each block."""
    at = own.join(found, "block_id", "left").select(
        "block_id", "zstart", "zend", "seq", "s",
        F.coalesce(F.col("i") + k, F.col("zstart") + 1).alias("idx_left"), (F.col("zend") + F.coalesce("j", F.lit(0))).alias("idx_right"),
    )
    return at.select(
        "block_id", "zstart", "zend", "seq", "idx_left", "idx_right",
        F.substr("s", F.col("idx_left") - k + 1, F.lit(k)).alias("kmer_left"), F.substr("s", F.col("idx_right") + 1, F.lit(k)).alias("kmer_right"),
    ).where(F.length("kmer_right") == k)


def _compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jumps a, then b: (ctx, to) tables."""
    return a.alias("a").join(b.select(F.col("ctx").alias("mid"), F.col("to").alias("far")), F.col("a.to") == F.col("mid")).select("ctx", F.col("far").alias("to"))


def steps(solid_kmers: DataFrame, k: int) -> DataFrame:
    """The walk's next k-mer from each context: (ctx, node, to), to being its own context. One extension is
    taken; of two one is, if they are a substitution bubble: both branches go on without a choice
    for k + 1 steps and meet in the same k-mer; else the walk ends there."""
    k = odd(k)
    ctx = written(contexts(solid_kmers, k), "contexts")
    to = lambda c: F.substring(c, 1, k - 1)
    plain = ctx.where("degree = 1").select("ctx", F.col("branch_1").alias("node"), to("branch_1").alias("to"))
    forks = ctx.where("degree = 2").select("ctx", "chosen", "branch_1", "branch_2")
    # k + 1 forced steps from each branch, by doubling: as many joins as k + 1 has bits.
    jump, left, ends = plain.select("ctx", "to"), k, None
    branches = forks.select("ctx", F.explode(F.array("branch_1", "branch_2")).alias("node")).select(F.col("ctx").alias("fork"), to("node").alias("at"))
    while left:
        if left & 1:
            branches = branches.join(jump.withColumnRenamed("ctx", "at"), "at").select("fork", F.col("to").alias("at"))
        left >>= 1
        if left:
            jump = written(_compose(jump, jump), "jump")
    last = branches.join(plain.select(F.col("ctx").alias("at"), F.col("node").alias("end")), "at")
    ends = last.groupBy("fork").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("a"), F.max("end").alias("b")).where("n = 2 and a = b")
    bubbles = forks.join(ends.select(F.col("fork").alias("ctx")), "ctx", "left_semi").select("ctx", F.col("chosen").alias("node"), to("chosen").alias("to"))
    return plain.unionByName(bubbles)


def walks(starts: DataFrame, step: DataFrame, k: int, max_steps: int = MAX_STEPS) -> DataFrame:
    """Walks backward from k-mers. starts: walk (id), node. Gives walk, step (0 for the start), node.

    Pointer doubling: after r rounds a walk has up to 2^r k-mers, so max_steps takes log2 of it many rounds
    of joins, each written to the shared folder. A walk ends where there is no next k-mer, before a
    k-mer that it holds already on either strand, and at max_steps k-mers."""
    if max_steps < 2:
        raise ValueError("max_steps is 2 or more")
    k = odd(k)
    found = starts.select("walk", F.lit(0).alias("step"), "node")
    step = written(step, "steps")
    ahead = step.select("ctx", "node", "to")  # the k-mer that lies `size` steps on
    size = 1
    while size < max_steps:
        more = found.select("walk", (F.col("step") + size).alias("step"), F.substring("node", 1, k - 1).alias("ctx")).where(F.col("step") < max_steps)
        more = written(more.join(ahead, "ctx").select("walk", "step", "node"), "walk")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        size *= 2
        if size < max_steps:
            ahead = written(ahead.alias("a").join(ahead.select(F.col("ctx").alias("mid"), F.col("node").alias("n"), F.col("to").alias("far")), F.col("a.to") == F.col("mid")).select("ctx", F.col("n").alias("node"), F.col("far").alias("to")), "ahead")
    again = Window.partitionBy("walk", "c").orderBy("step")
    marked = found.withColumn("c", canonical(F.col("node"))).withColumn("again", F.row_number().over(again) > 1)
    end = marked.where("again").groupBy("walk").agg(F.min("step").alias("stop"))
    return marked.join(end, "walk", "left").where(F.col("stop").isNull() | (F.col("step") < F.col("stop"))).select("walk", "step", "node")


class Graph:
    """The solid k-mers as sorted codes of two bits a letter (k up to 31), and steps of many walks at once."""

    def __init__(self, codes: np.ndarray, k: int):
        self.codes, self.k = codes, k
        self.mask = np.uint64((1 << 2 * k) - 1)

    def known(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(code.shape, bool)
        return self.codes[np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)] == code

    def before(self, code: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The four k-mers that may come before each one, by first letter: codes, codes of the reverse complements, and which are solid."""
        letter = np.arange(4, dtype=np.uint64)
        forth = (code[:, None] >> np.uint64(2)) | letter << np.uint64(2 * (self.k - 1))
        other = ((back[:, None] << np.uint64(2)) & self.mask) | (np.uint64(3) - letter)
        return forth, other, self.known(np.minimum(forth, other))

    def step(self, code: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next k-mer of each walk, its reverse complement, and whether there is one: the only one before it, or of two that
        are a substitution bubble the one with the highest rank: a canonical one by its first letter, another by that letter's complement."""
        forth, other, solid = self.before(code, back)
        degree = solid.sum(axis=1)
        letter = np.arange(4)
        own = forth <= other
        rank = np.where(solid, np.where(own, 2 * letter, 2 * (3 - letter) + 1), -1)
        pick = rank.argmax(axis=1)
        rows = np.arange(len(code))
        go = degree == 1
        two = np.flatnonzero(degree == 2)
        if len(two):
            branch = np.argsort(~solid[two], axis=1, kind="stable")[:, :2]
            ends = [self.forced(forth[two, branch[:, i]], other[two, branch[:, i]]) for i in (0, 1)]
            go[two] = ends[0][1] & ends[1][1] & (ends[0][0] == ends[1][0])
        return forth[rows, pick], other[rows, pick], go

    def forced(self, code: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each walk is after k + 1 steps without a choice, and whether there are so many."""
        open_ = np.ones(len(code), bool)
        for _ in range(self.k + 1):
            forth, other, solid = self.before(code, back)
            open_ &= solid.sum(axis=1) == 1
            at = solid.argmax(axis=1)
            rows = np.arange(len(code))
            code, back = forth[rows, at], other[rows, at]
        return code, open_

    def walk(self, code: np.ndarray, back: np.ndarray, max_steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the k-mers of each walk, and how many there are."""
        seen = np.zeros((len(code), max_steps), np.uint64)
        path = np.zeros((len(code), max_steps), np.uint64)
        n = np.ones(len(code), np.int64)
        path[:, 0], seen[:, 0] = code, np.minimum(code, back)
        live = np.arange(len(code))
        while len(live):
            t = int(n[live[0]])  # all that go on are equally long
            if t >= max_steps:
                break
            code, back, go = self.step(code, back)
            least = np.minimum(code, back)
            go &= ~(seen[live, :t] == least[:, None]).any(axis=1)
            live, code, back = live[go], code[go], back[go]
            path[live, t], seen[live, t] = code, np.minimum(code, back)
            n[live] += 1
        return path, n


def _walked(batches: Iterator[pa.RecordBatch], graph: Graph, max_steps: int) -> Iterator[pa.RecordBatch]:
    letters = np.frombuffer(b"ACGT", np.uint8)
    for b in batches:
        for k in range(0, b.num_rows, WALKS):
            part = b.slice(k, WALKS)
            code, back, good = kmer_codes(part["node"], graph.k)
            names, nodes = part["walk"].to_pylist(), part["node"].to_pylist()
            at = np.flatnonzero(good)
            path, n = graph.walk(code[at], back[at], max_steps)
            first = letters[(path >> np.uint64(2 * (graph.k - 1))).astype(np.int64) & 3]
            texts, sizes = list(nodes), [1] * len(nodes)  # a start with other letters goes nowhere
            for i, row, m in zip(at.tolist(), first, n.tolist(), strict=True):
                texts[i], sizes[i] = row[1:m][::-1].tobytes().decode() + nodes[i], m
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["walk", "text", "n_kmers"])


def sent_walk_texts(starts: DataFrame, codes: np.ndarray, k: int, max_steps: int = MAX_STEPS) -> DataFrame:
    """walk_texts of the walks from starts (walk, node), with all solid k-mers (codes, sorted) in every task. No shuffle."""
    if max_steps < 2:
        raise ValueError("max_steps is 2 or more")
    sent = starts.sparkSession.sparkContext.broadcast(Graph(codes, odd(k)))
    return spread(starts.select("walk", "node")).mapInArrow(lambda it: _walked(it, sent.value, max_steps), "walk string, text string, n_kmers long")


_STATE = "walk string, node string, letters string, at long, left int, other long, pick long, met long, part int"
_STATE_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_STATE_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _in_parts(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Codes of solid k-mers by the part of the graph: that of their first k-1 letters and that of their last, so that all k-mers before one are in one part."""
    for b in batches:
        code, back, _ = kmer_codes(b["kmer"], k)
        code = np.minimum(code, back)
        one, two = bin_of(code >> np.uint64(2), k - 1, parts), bin_of(code & np.uint64((1 << 2 * (k - 1)) - 1), k - 1, parts)
        code, part = np.concatenate([code, code[one != two]]), np.concatenate([one, two[one != two]])
        order = np.argsort(part, kind="stable")
        code, part = code[order], part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        data = [code[i:j].tobytes() for i, j in zip(first, [*first[1:], len(code)], strict=True)] if len(first) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "codes"])


def _merged_part(key: tuple, t: pa.Table) -> pa.Table:
    codes = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["codes"]]))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary())})


def graph_parts(solid_kmers: DataFrame, k: int, parts: int) -> DataFrame:
    """The graph in parts by minimizers: part and its k-mers as sorted codes. A walk stays in a part for some ten steps."""
    return solid_kmers.select("kmer").mapInArrow(lambda it: _in_parts(it, k, parts), "part int, codes binary").groupBy("part").applyInArrow(_merged_part, "part int, codes binary")


def _begun(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """States of walks that begin; the part is -1 where a walk is over: a start with other letters goes nowhere."""
    for b in batches:
        code, _, good = kmer_codes(b["node"], k)
        part = np.where(good, bin_of(code >> np.uint64(2), k - 1, parts), -1).astype(np.int32)
        zero = np.zeros(len(code), np.int64)
        cols = [b["walk"], b["node"], [""] * len(code), code.view(np.int64), zero.astype(np.int32), zero, zero, zero, part]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(cols, _STATE_TYPES, strict=True)], names=_STATE_NAMES)


def _cut(nodes: list[str], letters: list[str], k: int) -> list[str]:
    """The letters of each walk up to where it came to a k-mer that it held already on either strand."""
    sizes = np.array([len(x) + 1 for x in letters])
    text = np.frombuffer("".join(x[::-1] + n for n, x in zip(nodes, letters, strict=True)).encode(), np.uint8)
    forth = windows_of(_LETTER[text], k)
    begin = np.cumsum(sizes + k - 1) - (sizes + k - 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = forth[place + begin[owner]]
    least, step = np.minimum(code, reversed_codes(code, k)), sizes[owner] - 1 - place
    order = np.lexsort((step, least, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (owner[order][1:] == owner[order][:-1]) & (least[order][1:] == least[order][:-1])
    stop = sizes.copy()
    np.minimum.at(stop, owner[order][again], step[order][again])
    return [x if n == len(x) + 1 else x[: n - 1] for x, n in zip(letters, stop.tolist(), strict=True)]


_LETTER = np.zeros(256, np.uint64)
for _i, _c in enumerate(b"ACGT"):
    _LETTER[_c] = _i


def _through_part(t: pa.Table, graph: Graph, part: int, parts: int, max_steps: int) -> pa.RecordBatch:
    """The walks that are in a part go on until they are over or in another one. At a fork (left above 0) a walk looks
    along one branch, then along the other: k + 1 steps without a choice each, as Graph.step does at once."""
    k, n_walks = graph.k, t.num_rows
    nodes, letters = t["node"].to_pylist(), t["letters"].to_pylist()
    at, other, pick, met = (t[c].to_numpy().astype(np.uint64) for c in ("at", "other", "pick", "met"))
    left, size = t["left"].to_numpy().astype(np.int64), np.array([len(x) for x in letters], np.int64)
    here, own = np.full(n_walks, part, np.int32), np.zeros((n_walks, max_steps), np.uint8)
    began = size.copy()
    live = np.arange(n_walks)

    def take(rows: np.ndarray, to: np.ndarray) -> None:
        own[rows, size[rows]] = (to >> np.uint64(2 * (k - 1))).astype(np.uint8)
        size[rows] += 1
        at[rows], left[rows] = to, 0
        here[rows[size[rows] + 1 >= max_steps]] = -1

    while len(live):
        code = at[live]
        forth, _, solid = graph.before(code, reversed_codes(code, k))
        back = reversed_codes(forth.reshape(-1), k).reshape(forth.shape)
        degree, looks = solid.sum(axis=1), left[live] > 0
        only = forth[np.arange(len(live)), solid.argmax(axis=1)]
        here[live[(degree == 0) | (degree > 2) | (looks & (degree != 1))]] = -1
        one = ~looks & (degree == 1)
        take(live[one], only[one])
        fork = ~looks & (degree == 2)
        if fork.any():
            letter = np.arange(4)
            rank = np.where(solid[fork], np.where(forth[fork] <= back[fork], 2 * letter, 2 * (3 - letter) + 1), -1)
            branch = np.argsort(~solid[fork], axis=1, kind="stable")[:, :2]
            rows, two = live[fork], forth[fork]
            each = np.arange(len(rows))
            pick[rows], at[rows], other[rows] = two[each, rank.argmax(axis=1)], two[each, branch[:, 0]], two[each, branch[:, 1]]
            left[rows] = 2 * (k + 1)
        goes = looks & (degree == 1)
        rows = live[goes]
        at[rows] = only[goes]
        left[rows] -= 1
        half = rows[left[rows] == k + 1]
        met[half], at[half] = at[half], other[half]
        over = rows[left[rows] == 0]
        same = at[over] == met[over]
        here[over[~same]] = -1
        take(over[same], pick[over[same]])
        rows = live[here[live] >= 0]
        here[rows] = bin_of(at[rows] >> np.uint64(2), k - 1, parts)
        live = rows[here[rows] == part]
    added = np.frombuffer(b"ACGT", np.uint8)[own]
    letters = [x + row[a:z].tobytes().decode() for x, row, a, z in zip(letters, added, began.tolist(), size.tolist(), strict=True)]
    kept = _cut(nodes, letters, k)
    here[[len(a) != len(b) for a, b in zip(kept, letters, strict=True)]] = -1
    cols = [t["walk"].combine_chunks(), nodes, kept, at.view(np.int64), left.astype(np.int32), other.view(np.int64), pick.view(np.int64), met.view(np.int64), here]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x) for c, x in zip(cols, _STATE_TYPES, strict=True)], names=_STATE_NAMES)


def _gone_on(batches: Iterator[pa.RecordBatch], k: int, parts: int, max_steps: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            codes, part = np.frombuffer(b["codes"][i].as_py(), np.uint64), b["part"][i].as_py()
            found = pa.Table.from_batches([pa.RecordBatch.from_struct_array(b["states"][i].values)])
            for j in range(0, found.num_rows, ROWS):
                yield _through_part(found.slice(j, ROWS).combine_chunks(), Graph(codes, k), part, parts, max_steps)


#: Walks of a part taken at once.
ROWS = 4096


def parted_walk_texts(starts: DataFrame, solid_kmers: DataFrame, n_solid: int, k: int, max_steps: int = MAX_STEPS) -> DataFrame:
    """walk_texts of the walks from starts (walk, node) in a graph of any size. The graph is written once in parts; in each round
    the walks are sent to the parts that they are in and go on there until they leave them, so nothing of the graph is shuffled again. A round reads the parts that have walks.
    SENT_WALKS are under way at once, so that what is sent is bounded."""
    k = odd(k)
    parts = max(1, -(-n_solid // PART))
    return walks_in_parts(starts, written(graph_parts(solid_kmers, k, parts), "graph"), parts, k, max_steps)


def walks_in_parts(starts: DataFrame, graph: DataFrame, parts: int, k: int, max_steps: int = MAX_STEPS) -> DataFrame:
    """The same in a written graph (part, codes) of so many parts. Of the rounds only the walks that are over stay on disk: those that go on are deleted when the next
    round has them. What goes on is brought together by one task and sent from there, without a shuffle."""
    if max_steps < 2:
        raise ValueError("max_steps is 2 or more")
    spark, n = starts.sparkSession, 0
    base = fresh_path(spark, "walks")

    def stored(df: DataFrame) -> DataFrame:
        df.withColumn("over", F.col("part") < 0).write.partitionBy("over").option("compression", "zstd").parquet(f"{base}/round={n}")
        return spark.read.schema(f"{_STATE}, over boolean").parquet(f"{base}/round={n}").where("not over").drop("over")

    present = {r["part"] for r in graph.select("part").collect()}
    begun = stored(starts.select("walk", "node").mapInArrow(lambda it: _begun(it, k, parts), _STATE))
    slices = -(-begun.count() // SENT_WALKS)
    for i in range(slices):
        live, before = begun.where(F.pmod(F.xxhash64("walk"), F.lit(slices)) == i), 0
        while at := [r["part"] for r in live.select("part").distinct().collect()]:  # at most as many as there are parts
            sent = live.coalesce(1).groupBy("part").agg(F.collect_list(F.struct(*_STATE_NAMES[:-1])).alias("states"))
            rows = graph.where(F.col("part").isin(at)).join(F.broadcast(sent), "part").select("part", "codes", "states")
            moved = rows.mapInArrow(lambda it: _gone_on(it, k, parts, max_steps), _STATE)
            if empty := set(at) - present:  # without a k-mer: what walks there is over
                moved = moved.unionByName(live.where(F.col("part").isin(sorted(empty))).withColumn("part", F.lit(-1)))
            n += 1
            live = stored(moved)
            if before:
                drop(spark, f"{base}/round={before}/over=false")
            before = n
    drop(spark, f"{base}/round=0/over=false")
    out = spark.read.schema(f"{_STATE}, over boolean, round int").parquet(base).where("over")
    return out.select("walk", F.concat(F.reverse("letters"), F.col("node")).alias("text"), (F.length("letters") + 1).cast("long").alias("n_kmers"))


def walk_texts(walked: DataFrame) -> DataFrame:
    """Text of each backward walk: the first letters of its k-mers from the last to the first, then the rest of the start."""
    letters = F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct((-F.col("step")).alias("s"), F.substring("node", 1, 1).alias("b")))))  # at most max_steps
    return walked.groupBy("walk").agg(F.concat(F.array_join(F.transform(letters, lambda x: x["b"]), ""), F.max(F.when(F.col("step") == 0, F.col("node")))).alias("text"), F.count(F.lit(1)).alias("n_kmers"))


def identity_right_aligned(a: Column, b: Column) -> Column:
    """Ungapped identity in percent of two texts aligned at their ends, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.reverse(a), F.reverse(b)
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))).cast("int"))
    return F.when(n > 0, same * 100.0 / n)


#: A k-mer of a block and its place: on the left of the repeat where it begins, on the right -1 less where it begins behind the repeat.
_ASKED = np.dtype([("block", np.int64), ("place", np.int32), ("code", np.uint64)])


def _asked(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The k-mers of blocks (block_id, right, text) by parts of the graph."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            rows = b.slice(i, ROWS)
            owner, place, code = placed_codes(rows["text"], k)
            asked = np.empty(len(code), _ASKED)
            asked["block"], asked["code"] = rows["block_id"].to_numpy()[owner], code
            asked["place"] = np.where(rows["right"].to_numpy(zero_copy_only=False)[owner], -1 - place, place)
            part = bin_of(code >> np.uint64(2), k - 1, parts)
            order = np.argsort(part, kind="stable")
            asked, part = asked[order], part[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            data = [asked[x:y].tobytes() for x, y in zip(first, [*first[1:], len(part)], strict=True)] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(data, pa.binary())], names=["bin", "asked"])


def _counted_part(key: tuple, t: pa.Table, k: int, least: int, most: int, parts: int) -> pa.Table:
    """A part of the graph: its solid k-mers, how many are of no part before (that of the first letters), and of the blocks' k-mers that are
    among them the first on the left and the last on the right of each block."""
    code, n = counted_codes((x.as_py() for x in t["data"] if x.is_valid), k)
    n = np.minimum(n, MAX_COUNT)
    code, part = code[(n >= least) & (n <= most)], key[0].as_py()
    own = int((bin_of(code >> np.uint64(2), k - 1, parts) == part).sum())
    found = [np.zeros(0, _ASKED)]
    for x in t["asked"]:
        if x.is_valid:
            asked = np.frombuffer(x.as_py(), _ASKED)
            found.append(asked[Graph(code, k).known(asked["code"])])
    hit = np.concatenate(found)
    hit = hit[np.lexsort((hit["place"], hit["place"] < 0, hit["block"]))]
    first = np.ones(len(hit), bool)
    first[1:] = (hit["block"][1:] != hit["block"][:-1]) | ((hit["place"][1:] < 0) != (hit["place"][:-1] < 0))
    cols = [(part, pa.int32()), (code.tobytes(), pa.binary()), (own, pa.int64()), (hit["block"][first].tolist(), pa.list_(pa.int64())), (hit["place"][first].tolist(), pa.list_(pa.int32()))]
    return pa.table([pa.array([x], kind) for x, kind in cols], names=["part", "codes", "own", "block", "place"])


def counted_graph(texts: DataFrame, own: DataFrame, k: int, least: int, most: int) -> tuple[DataFrame, int]:
    """The graph of the k-mers (k up to 31) of texts.seq that are seen `least` to `most` times, in parts, and how many parts; and which k-mers of the blocks
    are in it. One shuffle: the k-mers as stretches of letters, those at the edge of a part sent to both, and the k-mers of the blocks' sides. What is counted in a part is the part:
    no k-mer is written, shuffled or joined as letters."""
    parts = bins_of(texts, 20, 64)
    sent = spread(texts.where(F.length("seq") >= k)).mapInArrow(lambda it: kmer_stretches(it, k, parts, both=True), "bin int, data binary")
    left, right = _sides()
    side = lambda r, c: own.select(F.col("block_id").cast("long").alias("block_id"), F.lit(r).alias("right"), c.alias("text"))
    asked = spread(side(False, left).unionByName(side(True, right)).where((F.length("text") >= k) & F.col("block_id").isNotNull())).mapInArrow(lambda it: _asked(it, k, parts), "bin int, asked binary")
    rows = sent.unionByName(asked, allowMissingColumns=True)
    return rows.groupBy("bin").applyInArrow(lambda key, t: _counted_part(key, t, k, least, most, parts), "part int, codes binary, own long, block array<long>, place array<int>"), parts


def found_in(graph: DataFrame) -> DataFrame:
    """The places of the first solid k-mer on the left (i) and the last on the right (j) of each block, from a counted graph."""
    left, right = F.when(F.col("place") >= 0, F.col("place")), F.when(F.col("place") < 0, -1 - F.col("place"))
    return graph.select(F.inline(F.arrays_zip("block", "place"))).groupBy(F.col("block").alias("block_id")).agg(F.min(left).alias("i"), F.max(right).alias("j"))


def _own_codes(batches: Iterator[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, x in zip(b["part"].to_pylist(), b["codes"], strict=True):
            code = np.frombuffer(x.as_py(), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(code[bin_of(code >> np.uint64(2), k - 1, parts) == part].view(np.int64))], names=["code"])


def _starts(at: DataFrame, sides: str) -> DataFrame:
    side = {"l": F.col("kmer_left"), "r": revcomp(F.col("kmer_right"))}
    return reduce(DataFrame.unionByName, [at.select(F.concat_ws(":", F.lit(s), "block_id").alias("walk"), side[s].alias("node")) for s in sides])


def _flanked(at: DataFrame, texts: DataFrame, sides: str) -> DataFrame:
    parts = texts.select(F.substring("walk", 1, 1).alias("s"), F.expr("cast(substr(walk, 3) as bigint)").alias("block_id"), "text", "n_kmers")
    if "l" in sides:
        at = at.join(parts.where("s = 'l'").select("block_id", F.col("text").alias("lflank"), F.col("n_kmers").alias("n_left")), "block_id")
        at = at.withColumn("pid_left", identity_right_aligned(F.col("lflank"), F.substr("seq", F.lit(1), F.col("idx_left"))))
    if "r" in sides:
        at = at.join(parts.where("s = 'r'").select("block_id", revcomp(F.col("text")).alias("rflank"), F.col("n_kmers").alias("n_right")), "block_id")
        at = at.withColumn("pid_right", identity_right_aligned(F.reverse("rflank"), F.reverse(F.expr("substr(seq, idx_right + 1)"))))
    return at


def flanks(blocks: DataFrame, reads: DataFrame, k: int, min_count: int = 2, max_count: int = MAX_COUNT, max_steps: int = MAX_STEPS, include_blocks: bool = True, sides: str = "lr") -> DataFrame:
    """Flanks of each block, walked from its anchors along the solid k-mers of reads (and of the blocks themselves): the backward walk on the left (l in sides),
    and that of the reverse complement, turned back, on the right (r); with their identities to the block's own letters."""
    if sides not in ("l", "r", "lr"):
        raise ValueError("sides are l, r or lr")
    k, min_count = odd(k), max(2, min_count)
    if k > 31:
        solid_kmers = written(solid(count_kmers(reads, k, blocks if include_blocks else None, min_count), min_count, max_count).select("kmer"), "solid")
        at = written(anchors(blocks, solid_kmers, k), "anchors")
        return _flanked(at, walk_texts(walks(_starts(at, sides), steps(solid_kmers, k), k, max_steps)), sides)
    own = _long_enough(blocks, k)
    texts = reads.select("seq").unionByName(blocks.select("seq")) if include_blocks else reads.select("seq")
    graph, parts = counted_graph(texts, own, k, min_count, max_count)
    graph = written(graph, "graph")
    at = written(_anchored(own, found_in(graph), k), "anchors")
    starts = _starts(at, sides)
    if (graph.agg(F.sum("own")).first()[0] or 0) <= MOST_SENT:
        codes = graph.select("part", "codes").mapInArrow(lambda it: _own_codes(it, k, parts), "code long").toArrow()["code"].to_numpy()  # at most MOST_SENT
        return _flanked(at, sent_walk_texts(starts, np.sort(codes.view(np.uint64)), k, max_steps), sides)
    return _flanked(at, walks_in_parts(starts, graph.select("part", "codes"), parts, k, max_steps), sides)


def extend_str_reads(blocks: DataFrame, reads: DataFrame, k: int, min_count: int = 2, max_count: int = 255, max_steps: int = MAX_STEPS, include_blocks: bool = True, min_identity: float = 95.0) -> DataFrame:
    """Contigs: blocks with both flanks extended along the k-mers of reads (and of the blocks themselves).

    blocks: block_id (unique), motif, copies, start, end, seq. Gives name, motif, copies (as text), start, end,
    seq. Blocks with a side shorter than k, or with a flank that agrees with the block in less
    than min_identity percent, give none. N counts as A in k-mers only."""
    out = flanks(blocks, reads, k, min_count, max_count, max_steps, include_blocks).where((F.col("pid_left") >= min_identity) & (F.col("pid_right") >= min_identity))
    rows = out.join(blocks.select("block_id", "motif", "copies"), "block_id")
    shift = F.length("lflank") - F.col("idx_left")
    return rows.select(
        F.concat(F.lit("Block"), F.col("block_id").cast("string")).alias("name"), "motif", F.array_join(F.col("copies").cast("array<string>"), ",").alias("copies"),
        (F.col("zstart") + shift).alias("start"), (F.col("zend") + shift).alias("end"),
        F.concat("lflank", F.expr("substr(seq, idx_left + 1, greatest(0, idx_right - idx_left))"), "rflank").alias("seq"),
    )


def expected_kmers(genome_size: int, coverage: float, k: int, read_length: int = 100, ploidy: int = 2, heterozygosity: float = 0.001, error_rate: float = 0.01) -> float:
    """About how many different k-mers to expect; a hint for the number of shuffle partitions, never for results."""
    true = genome_size * (1 + (ploidy - 1) * (1 - (1 - heterozygosity) ** k))
    wrong = genome_size * coverage * (read_length - k + 1) / read_length * (1 - (1 - error_rate) ** k)
    return true + wrong
