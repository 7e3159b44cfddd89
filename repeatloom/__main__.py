"""Command line: the three stages and the report filter, files in and text files out.

    python -m repeatloom select -n 3 -f 29 -i --out selected r1.fq r2.fq.gz
    python -m repeatloom merge --out blocks 27 selected
    python -m repeatloom extend --out contigs 27 blocks r1.fq r2.fq.gz
    python -m repeatloom report --out bed report.txt
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from repeatloom.operators import checklist, extend, merge, select, trf
from repeatloom.shared import drop_written, n_written
from repeatloom.sources import fastq


#: K-mers of a shuffle partition where the number to expect is known.
KMERS_PER_PARTITION = 5_000_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="repeatloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="stage", required=True)
    s = sub.add_parser("select", help="reads with a repeat on both strands")
    s.add_argument("-n", "--numcopies", type=int, default=2)
    s.add_argument("-f", "--flanks", type=int, default=31)
    s.add_argument("-i", "--illumina", action="store_true", help="qualities are Phred+64")
    s.add_argument("-r", "--removehm", action="store_true", help="leave out homopolymers")
    s.add_argument("-x", "--altalgo", action="store_true", help="rank before the flanks are looked at")
    s.add_argument("-c", "--check", help="check-list; counts are written to OUT-check, reads without an entry and their best identity to OUT-misses")
    for k in select.MOTIF_LENGTHS:
        s.add_argument(f"-{k}", f"--{k}mer", dest="lengths", action="append_const", const=k)
    s.add_argument("files", nargs="+")
    m = sub.add_parser("merge", help="selected reads to blocks")
    m.add_argument("--min_threshold", type=int, default=4)
    m.add_argument("--max_threshold", type=int, default=10_000)
    m.add_argument("--all", action="store_true", help="loci with fewer than two alleles too")
    m.add_argument("k", type=int)
    m.add_argument("file")
    e = sub.add_parser("extend", help="blocks to contigs")
    e.add_argument("--min_threshold", type=int, default=2)
    e.add_argument("--max_threshold", type=int, default=255)
    e.add_argument("--flanks", type=int, default=extend.MAX_STEPS)
    e.add_argument("--genome_size", type=int, help="with --coverage: how many k-mers to expect, which sets the shuffle partitions and never the result")
    e.add_argument("--coverage", type=float)
    e.add_argument("k", type=int)
    e.add_argument("blocks")
    e.add_argument("files", nargs="+")
    r = sub.add_parser("report", help="one row of a repeat finder's report for each sequence")
    r.add_argument("files", nargs="+")
    for x in (s, m, e, r):
        x.add_argument("--out", required=True, help="folder of text files")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("repeatloom").getOrCreate()
    tables = n_written()
    if a.stage == "select":
        reads = fastq.read_fastq(spark, a.files)
        picked = select.select_str_reads(reads, a.numcopies, a.flanks, a.lengths or select.MOTIF_LENGTHS, a.removehm, a.altalgo, a.illumina)
        fastq.write_ordered(fastq.annotated_text(picked), a.out, "file_idx", "ord")
        if a.check:
            hits = checklist.checklist_hits(picked, fastq.read_checks(spark, a.check))
            fastq.write_ordered(hits.select("check_id", F.concat_ws("\t", "motif", "copies", "found").alias("value")), a.out + "-check", "check_id")
            misses = checklist.checklist_misses(picked, fastq.read_checks(spark, a.check)).join(picked.select("file_idx", "ord", "name"), ["file_idx", "ord"])
            fastq.write_ordered(misses.select("file_idx", "ord", F.concat_ws("\t", "name", F.format_string("%.2f", "best")).alias("value")), a.out + "-misses", "file_idx", "ord")
    elif a.stage == "merge":
        picked = select.parse_annotated(fastq.read_fastq(spark, a.file))
        picked = picked.withColumn("fwd", F.when(F.col("fwd").isNotNull(), F.col("fwd")).otherwise(F.raise_error(F.concat(F.lit("a header without nine fields: "), "name"))))
        blocks = merge.merge_str_reads(picked, a.k, a.min_threshold, a.max_threshold, a.all)
        fastq.write_ordered(fastq.block_text(blocks), a.out, "block_id")
    elif a.stage == "extend":
        if a.genome_size and a.coverage:
            expected = extend.expected_kmers(a.genome_size, a.coverage, a.k)
            print(f"about {expected:.0f} different k-mers", file=sys.stderr)
            spark.conf.set("spark.sql.shuffle.partitions", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(expected // KMERS_PER_PARTITION) + 1)))
        blocks = fastq.parse_blocks(fastq.read_fastq(spark, a.blocks))
        contigs = extend.extend_str_reads(blocks, fastq.read_fastq(spark, a.files), a.k, a.min_threshold, a.max_threshold, a.flanks)
        fastq.write_ordered(fastq.contig_text(contigs), a.out, "name")
    else:
        fastq.write_ordered(fastq.report_text(trf.top_repeats(fastq.read_report(spark, a.files))), a.out, "name_ord")
    drop_written(spark, tables)


if __name__ == "__main__":
    main()
