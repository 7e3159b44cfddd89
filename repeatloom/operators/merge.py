"""Merging selected reads into blocks: keys, components, the ordered consensus fold, alleles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatloom.functions.dna import revcomp, revcomp_iupac
from repeatloom.operators.align import align_flanks
from repeatloom.operators.kmers import odd
from repeatloom.shared import written

# Least identity and most gaps of a flank, reads an allele needs, alleles looked at.
MIN_IDENTITY, MAX_GAPS, MIN_ALLELE_READS, ALLELES = 90.0, 2, 2, 3


def merge_keys(str_reads: DataFrame, k: int) -> DataFrame:
    """str_reads with fwd_key and rc_key: motif and the k letters on both sides of the match, on either strand.
    k has to be no larger than the flank the reads were selected with."""
    k = odd(k)

    def key(s, m):
        return F.concat_ws(" ", m["motif"], F.substr(s, m["start"] - k + 1, F.lit(k)), F.substr(s, m["end"] + 1, F.lit(k)))

    return str_reads.withColumns({"fwd_key": key(F.col("seq"), F.col("fwd")), "rc_key": key(revcomp(F.col("seq")), F.col("rc"))})


def locus_alleles(keyed: DataFrame) -> DataFrame:
    """Reads of each locus and copy number, loci being exact keys on the strand whose key sorts first: locus, copies, nsupport,
    first_seen. Pre-aggregated, so a deep locus is no hot partition."""
    ahead = F.col("fwd_key") <= F.col("rc_key")
    return (
        keyed.select(F.least("fwd_key", "rc_key").alias("locus"), F.when(ahead, F.col("fwd.copies")).otherwise(F.col("rc.copies")).alias("copies"), F.struct("file_idx", "ord").alias("at"))
        .groupBy("locus", "copies")
        .agg(F.count(F.lit(1)).alias("nsupport"), F.min("at").alias("first_seen"))
    )


def loci(keyed: DataFrame, min_support: int = 4, max_support: int = 10_000) -> DataFrame:
    """Loci with enough and not too many reads: locus, support, and alleles (copies, nsupport) with two reads or
    more, the last first-seen one first, at most three."""
    own = locus_alleles(keyed).groupBy("locus").agg(F.sum("nsupport").alias("support"), F.collect_list(F.struct("first_seen", "copies", "nsupport")).alias("a"))  # one entry for each copy number
    kept = F.filter(F.sort_array("a", asc=False), lambda x: x["nsupport"] >= MIN_ALLELE_READS)
    return own.where(F.col("support").between(min_support, max_support)).select(
        "locus", "support", F.transform(F.slice(kept, 1, ALLELES), lambda x: F.struct(x["copies"].alias("copies"), x["nsupport"].alias("nsupport"))).alias("alleles")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a graph given as a, b: node, component (the least node of it).

    Most components are one edge: nodes whose only neighbour has no other one are told by two aggregations. For
    the rest least labels go round, with a jump to the label's own label each time, until none changes; every round is written
    to the shared folder, and the round before is deleted."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), "edges")
    nodes = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    pair = nodes.where("lo = hi").select(F.least("node", "lo").alias("component"), F.greatest("node", "lo").alias("other"))
    closed = pair.groupBy("component", "other").count().where((F.col("count") == 2) | (F.col("component") == F.col("other")))
    closed = written(closed.select(F.explode(F.array_distinct(F.array("component", "other"))).alias("node"), "component"), "closed")
    both = written(both.join(closed.select(F.col("node").alias("a")), "a", "left_anti"), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        moved = labels.join(near, "node").join(jump, "component").select("node", F.least("component", "near", "far").alias("now"), "component")
        moved = written(moved, "labels")
        changed = not moved.where("now < component").isEmpty()
        labels = moved.select("node", F.col("now").alias("component"))
        if not changed:
            return labels.unionByName(closed)


@dataclass
class Block:
    """The consensus of the reads merged so far."""

    motif: str
    start: int
    end: int
    seq: str
    qual: str
    founder: tuple[int, int]
    support: int = 1
    alleles: dict[int, int] = field(default_factory=dict)  # in order of first sight

    def take(self, seq: str, qual: str, motif: str, copies: int, start: int, end: int) -> bool:
        """Merges a read if both of its flanks agree. The block then holds one copy of the motif."""
        left = align_flanks(self.seq[: self.start], self.qual[: self.start], seq[:start], qual[:start], right=False)
        if left.identity < MIN_IDENTITY or left.gaps > MAX_GAPS:
            return False
        right = align_flanks(self.seq[self.end :], self.qual[self.end :], seq[end:], qual[end:], right=True)
        if right.identity < MIN_IDENTITY or right.gaps > MAX_GAPS:
            return False
        self.support += 1
        self.alleles[copies] = self.alleles.get(copies, 0) + 1
        self.start, self.end = len(left.seq), len(left.seq) + len(motif)
        self.seq, self.qual = left.seq + motif + right.seq, left.qual + "!" * len(motif) + right.qual
        return True


_BLOCK = "file_idx int, ord long, motif string, start int, end int, seq string, qual string, support int, alleles array<struct<copies:int,nsupport:int>>"


class _Fold:
    """Blocks of one component, by key."""

    def __init__(self) -> None:
        self.blocks: dict[str, Block] = {}
        self.lost: list[tuple[int, int]] = []

    def add(self, r) -> None:
        b = self.blocks.get(r.fwd_key)
        if b and b.take(r.seq, r.qual, r.f_motif, r.f_copies, r.f_start, r.f_end):
            return
        b = self.blocks.get(r.rc_key)
        if b is None:
            self.blocks[r.rc_key] = Block(r.r_motif, r.r_start, r.r_end, r.rc_seq, r.qual[::-1], (r.file_idx, r.ord), alleles={r.r_copies: 1})
        elif not b.take(r.rc_seq, r.qual[::-1], r.r_motif, r.r_copies, r.r_start, r.r_end):
            self.lost.append((r.file_idx, r.ord))  # the key is taken by a block that the read does not fit

    def rows(self) -> Iterator[tuple]:
        """The blocks, and the lost reads as rows without a motif and with a support of 0."""
        for b in self.blocks.values():
            alleles = [{"copies": c, "nsupport": n} for c, n in reversed(b.alleles.items())]
            yield (*b.founder, b.motif, b.start, b.end, b.seq, b.qual, b.support, alleles)
        for at in self.lost:
            yield (*at, None, 0, 0, None, None, 0, [])


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component and order; one component's blocks are held at a time."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    fold, current, out = _Fold(), None, []
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            if r.component != current:
                out.extend(fold.rows())
                fold, current = _Fold(), r.component
            fold.add(r)
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=names)
            out = []
    out.extend(fold.rows())
    yield pd.DataFrame(out, columns=names)


def _folded(str_reads: DataFrame, k: int) -> DataFrame:
    """Blocks before any filter, and lost reads. A read joins the block under its forward key, or else the one under its reverse
    key, if the flanks align; without a block there it founds one, on the reverse strand; with one that it
    does not fit it is lost. Every read is folded: one without qualities, or with more or fewer of them than bases, has
    the least quality, `!`, at the places that lack one, and its further ones are left out.

    The result depends on the order of the reads. Reads that share no key, directly or through others, never meet,
    so each connected component of keys is folded on its own in file order, as a stream over sorted rows: memory
    holds the blocks of one component. The fold of one component is sequential by definition.
    """
    keyed = merge_keys(str_reads, k).withColumn("qual", F.rpad(F.coalesce("qual", F.lit("")), F.length("seq"), F.lit("!")))
    keyed = written(keyed.select("file_idx", "ord", "seq", "qual", "fwd", "rc", "fwd_key", "rc_key"), "keyed")
    labels = components(keyed.select(F.col("fwd_key").alias("a"), F.col("rc_key").alias("b")).distinct())
    rows = keyed.join(labels.withColumnRenamed("node", "rc_key"), "rc_key").select(
        "component", "file_idx", "ord", "seq", "qual", revcomp_iupac(F.col("seq")).alias("rc_seq"), "fwd_key", "rc_key",
        *[F.col(f"{m}.{c}").alias(f"{m[0]}_{c}") for m in ("fwd", "rc") for c in ("motif", "copies", "start", "end")],
    )
    return rows.repartition("component").sortWithinPartitions("component", "file_idx", "ord").mapInPandas(_fold, _BLOCK)


def fold_blocks(str_reads: DataFrame, k: int) -> DataFrame:
    """Blocks before any filter: file_idx and ord of the founder, motif, start, end, seq, qual, support and alleles. The
    support of all blocks and the lost reads add up to the reads given."""
    return _folded(str_reads, k).where("support > 0")


def lost_reads(str_reads: DataFrame, k: int) -> DataFrame:
    """file_idx and ord of the reads that are in no block: both of their keys lead to blocks whose flanks they do not fit."""
    return _folded(str_reads, k).where("support = 0").select("file_idx", "ord")


def merge_str_reads(str_reads: DataFrame, k: int, min_support: int = 4, max_support: int = 10_000, include_all: bool = False) -> DataFrame:
    """Blocks with enough reads and exactly two alleles (with include_all: at most two), an allele having two reads
    or more: block_id, motif, copies, start, end, seq, qual, support, alleles, the last first-seen allele first.
    The repeat is written out with the larger copy number, its qualities as `!`. block_id is made of the founder's place
    (file_idx, ord), so it needs no global numbering. Without any allele copies is [0] and the repeat empty."""
    b = fold_blocks(str_reads, k)
    kept = F.slice(F.filter("alleles", lambda x: x["nsupport"] >= MIN_ALLELE_READS), 1, ALLELES)
    b = b.withColumn("kept", kept).where(F.col("support").between(min_support, max_support))
    b = b.where(F.size("kept") <= 2 if include_all else F.size("kept") == 2)
    copies = F.when(F.size("kept") == 0, F.array(F.lit(0))).otherwise(F.transform("kept", lambda x: x["copies"]))
    most = F.array_max(copies)
    n = most * F.length("motif")
    left = lambda c: F.substr(c, F.lit(1), F.col("start"))
    right = lambda c: F.substr(c, F.col("end") + 1, F.length(c) - F.col("end"))
    return b.select(
        (F.shiftleft(F.col("file_idx").cast("long"), 40) + F.col("ord")).alias("block_id"), "motif", copies.alias("copies"), "start", (F.col("start") + n).alias("end"),
        F.concat(left("seq"), F.repeat("motif", most), right("seq")).alias("seq"), F.concat(left("qual"), F.repeat(F.lit("!"), n), right("qual")).alias("qual"), "support", F.col("kept").alias("alleles"),
    )
