"""Selecting reads with exact short tandem repeats: candidates, ranking, both strands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.functions.dna import is_homopolymer, phred_shift, revcomp
from repeatloom.operators.letters import with_matches
from repeatloom.shared import spread

#: The order of the fields is the ranking order.
MATCH = "struct<len:int,copies:int,str:string,motif:string,start:int,end:int>"
MOTIF_LENGTHS = (2, 3, 4, 5, 6)


def _of_length(s: Column, k: int, num_copies: int, flank: int) -> Column:
    """Matches with motifs of k letters; a run is only looked for where the least one is there."""
    least = k * num_copies
    last = F.length(s) - flank - least
    places = F.when(last >= flank, F.sequence(F.lit(flank), last)).otherwise(F.array().cast("array<int>"))
    motif = lambda p: F.substr(s, p + 1, F.lit(k))

    def match(p: Column) -> Column:
        run = F.regexp_extract(F.substr(s, p + 1, F.length(s) - p), rf"^(.{{{k}}})\1*", 0)
        n = F.length(run)
        return F.struct(n.alias("len"), (n / k).cast("int").alias("copies"), run.alias("str"), motif(p).alias("motif"), p.alias("start"), (p + n).alias("end"))

    return F.transform(F.filter(places, lambda p: F.substr(s, p + 1, F.lit(least)) == F.repeat(motif(p), F.lit(num_copies))), match)


def candidates(s: Column, num_copies: int = 2, motif_lengths: Sequence[int] = MOTIF_LENGTHS, flank: int = 0) -> Column:
    """All repeats of a text as an array of matches: at every place and for every motif length the longest
    run of at least num_copies copies, if flank letters are left on both sides of it. Motifs with N are
    left out. Stays in the JVM; the array is empty for texts without any, null for null."""
    parts = [_of_length(s, k, num_copies, flank) for k in sorted(set(motif_lengths))]
    found = F.concat(*parts)
    return F.filter(found, lambda m: (m["end"] <= F.length(s) - flank) & ~m["motif"].contains("N"))


def _may_repeat(s: Column, num_copies: int, motif_lengths: Sequence[int], flank: int) -> Column:
    """A cheap test that holds wherever there is a candidate."""
    if num_copies < 2:
        return F.length(s) > 2 * flank
    pattern = "|".join(rf"(.{{{k}}})\{i + 1}{{{num_copies - 1}}}" for i, k in enumerate(sorted(set(motif_lengths))))
    return F.substr(s, F.lit(flank + 1), F.greatest(F.lit(0), F.length(s) - 2 * flank)).rlike(pattern)


def best_match(
    s: Column,
    num_copies: int = 2,
    flank: int = 31,
    motif_lengths: Sequence[int] = MOTIF_LENGTHS,
    remove_homopolymers: bool = False,
    rank_before_filter: bool = False,
) -> Column:
    """The best repeat of a text: longest, then most copies, then the largest text, then the rightmost.
    Flanks and homopolymers are looked at before ranking, or with rank_before_filter on the winner alone. Null if none."""
    inner = 0 if rank_before_filter else flank
    found = candidates(s, num_copies, motif_lengths, inner)
    if remove_homopolymers and not rank_before_filter:
        found = F.filter(found, lambda m: ~is_homopolymer(m["motif"]))
    best = F.array_max(found)
    if rank_before_filter:
        fits = lambda m: (m["start"] >= flank) & (F.length(s) - m["end"] >= flank) & (~is_homopolymer(m["motif"]) if remove_homopolymers else F.lit(True))
        best = F.get(F.filter(F.array(best), lambda m: F.coalesce(fits(m), F.lit(False))), F.lit(0))
    return F.when(_may_repeat(s, num_copies, motif_lengths, inner), best)


def with_best_matches(
    reads: DataFrame,
    strands: Sequence[str] = ("fwd", "rc"),
    num_copies: int = 2,
    flank: int = 31,
    motif_lengths: Sequence[int] = MOTIF_LENGTHS,
    remove_homopolymers: bool = False,
    rank_before_filter: bool = False,
) -> DataFrame:
    """reads with best_match of seq as fwd and of its reverse complement as rc; only reads with all that are asked for.

    Every place of every read is looked at, for each motif length. As Column expressions that is a lambda
    call for each place, measured at a millisecond a read; on arrays of whole batches it is a few passes over the letters."""
    args = (num_copies, flank, tuple(sorted(set(motif_lengths))), remove_homopolymers, rank_before_filter)
    schema = T.StructType([*reads.schema.fields, *[T.StructField(s, T._parse_datatype_string(MATCH)) for s in strands]])
    return spread(reads).mapInArrow(lambda it: with_matches(it, tuple(strands), args), schema)


def select_str_reads(
    reads: DataFrame,
    num_copies: int = 2,
    flank: int = 31,
    motif_lengths: Sequence[int] = MOTIF_LENGTHS,
    remove_homopolymers: bool = False,
    rank_before_filter: bool = False,
    illumina: bool = False,
) -> DataFrame:
    """reads (with seq and qual) with the best repeat of the read, fwd, and that of its reverse complement, rc; only
    reads with both. The two are found independently. Qualities in Phred+64 are shifted with illumina.
    No shuffle, but for inputs of fewer partitions than cores. Other columns stay; null and empty reads have no repeat."""
    if num_copies < 1 or not motif_lengths or not set(motif_lengths) <= set(MOTIF_LENGTHS):
        raise ValueError("num_copies is 1 or more, motif lengths are 2 to 6")
    out = with_best_matches(reads, ("fwd", "rc"), num_copies, flank, motif_lengths, remove_homopolymers, rank_before_filter)
    return out.withColumn("qual", phred_shift(F.col("qual"))) if illumina else out


def annotated_name(name: Column, fwd: Column, rc: Column) -> Column:
    """The nine tab-separated fields of a selected read's header."""
    fields = [m[f].cast("string") for m in (fwd, rc) for f in ("motif", "copies", "start", "end")]
    return F.concat_ws("\t", name, *fields)


def parse_annotated(reads: DataFrame) -> DataFrame:
    """Back from the annotated header to columns; rows whose header has not nine fields give null matches."""
    f = F.split("name", "\t")
    nine = F.size(f) == 9

    def match(at: int, s: Column) -> Column:
        motif, copies, start, end = f[at], f[at + 1].cast("int"), f[at + 2].cast("int"), f[at + 3].cast("int")
        text = F.substr(s, start + 1, end - start)
        return F.when(nine, F.struct((end - start).alias("len"), copies.alias("copies"), text.alias("str"), motif.alias("motif"), start.alias("start"), end.alias("end")))

    return reads.select(
        *[c for c in reads.columns if c != "name"], F.when(nine, f[0]).otherwise(F.col("name")).alias("name"), match(1, F.col("seq")).alias("fwd"), match(5, revcomp(F.col("seq"))).alias("rc")
    )
