"""K-mers of reads and blocks, their counts, and the graph they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.functions.dna import canonical, revcomp, solid_letters
from repeatloom.operators.letters import counted_stretches, kmer_stretches
from repeatloom.shared import spread

#: Counters stop here.
MAX_COUNT = 255


def odd(k: int) -> int:
    """k, or the next smaller odd number: then no k-mer is its own reverse complement."""
    k = k if k % 2 else k - 1
    if k < 3:
        raise ValueError("k is 3 or more")
    return k


def windows(s: Column, k: int) -> Column:
    """All k-letter windows of a text; an empty array for texts that are shorter."""
    last = F.length(s) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def explode_kmers(texts: DataFrame, k: int) -> DataFrame:
    """One row for each window of texts.seq, as the smaller of it and its reverse complement. N counts
    as A; windows with other letters than A, C, G, T are skipped; null and short texts give none."""
    k = odd(k)
    s = texts.select(solid_letters(F.col("seq")).alias("s")).where(F.length("s") >= k)
    return s.select(F.explode(windows(F.col("s"), k)).alias("w")).where(~F.col("w").rlike("[^ACGT]")).select(canonical(F.col("w")).alias("kmer"))


def bins_of(texts: DataFrame, bits: int = 17, least: int = 256) -> int:
    """How many bins of minimizers: one for some 2^bits bytes (128 KB) of texts by the plan's estimate. It is a matter of sizes only, never of results."""
    return min(max(least, int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >> bits), 1 << 14)


def count_kmers(reads: DataFrame, k: int, blocks: DataFrame | None = None, least: int = 1) -> DataFrame:
    """kmer and cnt over reads, and over the blocks' sequences too where given, of k-mers seen `least` times or more; cnt stops at MAX_COUNT.
    Up to 31 letters k-mers are shuffled as stretches of letters, each to the bin of its minimizer, and counted there."""
    texts = reads.select("seq") if blocks is None else reads.select("seq").unionByName(blocks.select("seq"))
    k = odd(k)
    if k > 31:
        counts = explode_kmers(texts, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))
        return counts.where(F.col("cnt") >= least).select("kmer", F.least("cnt", F.lit(MAX_COUNT).cast("long")).alias("cnt"))
    bins = bins_of(texts)
    parts = spread(texts.where(F.length("seq") >= k)).mapInArrow(lambda it: kmer_stretches(it, k, bins), "bin int, data binary")
    return parts.groupBy("bin").applyInArrow(lambda t: counted_stretches(t, k, least, MAX_COUNT), "kmer string, cnt long")


def solid(counts: DataFrame, min_count: int = 2, max_count: int = MAX_COUNT) -> DataFrame:
    """K-mers seen often enough: counts within the bounds, the lower one at least 2."""
    return counts.where(F.col("cnt").between(max(2, min_count), max_count))


def spectrum(counts: DataFrame) -> DataFrame:
    """How many k-mers there are of each count."""
    return counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n_kmers"))


def oriented(solid_kmers: DataFrame) -> DataFrame:
    """Every solid k-mer in both orientations; is_canonical marks the stored one."""
    both = F.array(F.struct(F.col("kmer").alias("node"), F.lit(True).alias("is_canonical")), F.struct(revcomp(F.col("kmer")).alias("node"), F.lit(False).alias("is_canonical")))
    return solid_kmers.select(F.inline(both))


def contexts(solid_kmers: DataFrame, k: int) -> DataFrame:
    """One backward step of the graph. A context is the first k-1 letters of a k-mer; its extensions are the
    solid k-mers, in either orientation, that end with it. Gives ctx, degree, the extension chosen when
    there are two (that with the highest rank: a stored one by its first letter, another by the complement's
    number), and both branches. At most four rows meet in a context, so one aggregation does it;
    a forward step is a backward one of the reverse complement."""
    k = odd(k)
    n = oriented(solid_kmers)
    code = F.instr(F.lit("ACGT"), F.substring("node", 1, 1)) - 1
    rank = F.when(F.col("is_canonical"), F.struct(code.alias("a"), F.lit(0).alias("b"))).otherwise(F.struct((3 - code).alias("a"), F.lit(1).alias("b")))
    return (
        n.select(F.substring("node", 2, k - 1).alias("ctx"), "node", rank.alias("rank"))
        .groupBy("ctx")
        .agg(F.count(F.lit(1)).alias("degree"), F.max(F.struct("rank", "node"))["node"].alias("chosen"), F.min("node").alias("branch_1"), F.max("node").alias("branch_2"))
    )


def degrees(solid_kmers: DataFrame, k: int) -> DataFrame:
    """kmer with its number of predecessors and successors, 0 to 4 each."""
    k = odd(k)
    steps = contexts(solid_kmers, k).select("ctx", "degree")
    nodes = solid_kmers.select("kmer", F.substring("kmer", 1, k - 1).alias("back"), F.substring(revcomp(F.col("kmer")), 1, k - 1).alias("forth"))
    back = nodes.join(steps.withColumnsRenamed({"ctx": "back", "degree": "n_back"}), "back", "left")
    both = back.join(steps.withColumnsRenamed({"ctx": "forth", "degree": "n_forth"}), "forth", "left")
    return both.select("kmer", F.coalesce("n_back", F.lit(0)).alias("n_predecessors"), F.coalesce("n_forth", F.lit(0)).alias("n_successors"))
