"""FASTQ, check-list and report files as DataFrames, and the text forms of all results.

Files are read as lines by Spark's own text source, so plain files are split among tasks and .gz files
are read whole by one; a line's number comes from counting the lines of each split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatloom.functions.dna import phred_shift, quality_trim

#: Most splits whose offsets are sent to all tasks (about 20 MB); beyond it lines are brought together by a shuffle.
MOST_SPLITS = 100_000
#: Lines of a record that can lie beyond the edge of a split.
EDGE = 3


def _split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file_idx, value, and the split of each line: file f and first byte b."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [spark.read.option("lineSep", "\n").text(p).select(F.lit(i).alias("file_idx"), "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")) for i, p in enumerate(paths)]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """Lines of one split after the other, as they come: split and the next few of its lines."""
    for b in batches:
        n, at = b.num_rows, 0
        i, f, s = (b[c].to_numpy(zero_copy_only=False) for c in ("file_idx", "f", "b"))
        while at < n:
            same = (i[at:] == i[at]) & (s[at:] == s[at]) & (f[at:] == f[at])
            end = n if same.all() else at + int(same.argmin())
            yield (int(i[at]), str(f[at]), int(s[at])), b["value"].slice(at, end - at)
            at = end


_SPLIT = "file_idx int, f string, b long, n long, edge array<struct<at:long,value:string>>"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split the number of its lines, and its first and last EDGE lines."""
    out: dict[tuple, list] = {}
    for key, lines in _runs(batches):
        got = out.setdefault(key, [0, [], []])
        n, head, tail = got
        if n < EDGE:
            head += lines.slice(0, EDGE - n).to_pylist()
        got[0], got[2] = n + len(lines), (tail + lines.slice(max(0, len(lines) - EDGE)).to_pylist())[-EDGE:]
    rows = []
    for key, (n, head, tail) in out.items():
        edge = dict(enumerate(head)) | {n - len(tail) + i: x for i, x in enumerate(tail)}
        rows.append((*key, n, [{"at": i, "value": x} for i, x in sorted(edge.items())]))
    types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("at", pa.int64()), ("value", pa.string())])))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file_idx", "f", "b", "n", "edge"])


_FOUR = "file_idx int, ord long, l0 string, l1 string, l2 string, l3 string"


def _assembled(batches: Iterator[pa.RecordBatch], first: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines lie in one split. first: number of each split's first line in its file."""
    at, rest = None, pa.array([], pa.string())
    for key, lines in _runs(batches):
        if key != at:
            at, number, rest = key, first[key], pa.array([], pa.string())
            skip = -number % 4  # these belong to a record that begins in an earlier split
        if skip:
            drop = min(skip, len(lines))
            lines, skip, number = lines.slice(drop), skip - drop, number + drop
        lines = pa.concat_arrays([rest, lines.cast(pa.string())])
        n = len(lines) // 4
        rest = lines.slice(4 * n)
        if n:
            take = [lines.take(pa.array(range(k, 4 * n, 4), pa.int64())) for k in range(4)]
            ords = pa.array(range(number // 4, number // 4 + n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.int32()), ords, *take], names=["file_idx", "ord", "l0", "l1", "l2", "l3"])
            number += 4 * n


def _four_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Four lines as a row: file_idx, ord, l0 to l3; lines that a file lacks at its end are null.

    A first scan measures the splits: one row for each. A second one puts the lines of a split together where they are
    read; only records across the edge of a split, at most one for each, are made of the rows of the first scan. Beyond
    MOST_SPLITS splits lines are grouped by their numbers instead."""
    lines = _split_lines(spark, paths)
    before = Window.partitionBy("file_idx").orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.mapInArrow(_measured, _SPLIT).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    splits = splits.persist()
    line = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    if splits.count() > MOST_SPLITS:
        splits.unpersist()
        return numbered_lines(spark, paths).groupBy("file_idx", F.floor(F.col("line") / 4).alias("ord")).agg(*[line(k).alias(f"l{k}") for k in range(4)])
    rows = splits.select("file_idx", "f", "b", "first").collect()  # at most MOST_SPLITS
    sent = spark.sparkContext.broadcast({(r["file_idx"], r["f"], r["b"]): r["first"] for r in rows})
    whole = lines.mapInArrow(lambda it: _assembled(it, sent.value), _FOUR)
    # Of the first lines those before a multiple of four, of the last ones those after it.
    numbered = splits.select("file_idx", "first", "n", F.inline("edge")).withColumn("line", F.col("first") + F.col("at"))
    begins = F.col("line") - F.col("line") % 4
    loose = numbered.where((begins < F.col("first")) | (begins + 4 > F.col("first") + F.col("n")))
    return whole.unionByName(loose.groupBy("file_idx", F.floor(F.col("line") / 4).alias("ord")).agg(*[line(k).alias(f"l{k}") for k in range(4)]))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of the files: file_idx (place of the path in the arguments), line (from 0), value.

    Within a split lines come in order, so a line's number is its distance from the first of its split plus
    the lines of the splits before: one row for each split is summed up, nothing is sorted."""
    lines = _split_lines(spark, paths).withColumn("id", F.monotonically_increasing_id())
    key = ["file_idx", "f", "b"]
    before = Window.partitionBy("file_idx").orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*key).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(splits, key).select("file_idx", (F.col("id") - F.col("first") + F.col("offset")).alias("line"), "value")


def read_fastq(spark: SparkSession, paths: str | Sequence[str], strict: bool = True, trim: bool = False, illumina: bool = False) -> DataFrame:
    """Reads of FASTQ files, plain or .gz: file_idx, ord (from 0), name (header without @), seq in upper case, qual.

    strict: a record whose header does not start with @, whose separator does not start with +, or whose bases
    have other characters than A, C, G, T, N and points, or that lacks lines, fails the job; else it is left out. trim drops 3' bases of
    Phred 2 or less. illumina turns Phred+64 qualities into Phred+33. Carriage returns are ignored; no final newline is needed."""
    rec = _four_lines(spark, paths)
    rec = rec.select("file_idx", "ord", *[F.translate(f"l{k}", "\r", "").alias(f"l{k}") for k in range(4)])
    rec = rec.where(~((F.col("l0") == "") & F.col("l1").isNull()))  # a blank line at the end
    good = F.coalesce(F.col("l0").startswith("@") & F.col("l2").startswith("+") & F.col("l1").rlike("^[acgtnACGTN.]*$") & F.col("l3").isNotNull(), F.lit(False))
    if strict:
        said = F.concat(F.lit("not a FASTQ record: file "), F.col("file_idx").cast("string"), F.lit(", record "), F.col("ord").cast("string"))
        rec = rec.withColumn("l0", F.when(good, F.col("l0")).otherwise(F.raise_error(said)))
    else:
        rec = rec.where(good)
    qual = phred_shift(F.col("l3")) if illumina else F.col("l3")
    out = rec.select("file_idx", "ord", F.expr("substr(l0, 2)").alias("name"), F.upper("l1").alias("seq"), qual.alias("qual"))
    if trim:
        out = out.withColumn("qual", quality_trim(F.col("qual"))).withColumn("seq", F.substr("seq", F.lit(1), F.length("qual")))
    return out


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """A check-list of motif, copies, left and right flank, separated by blanks; None is an empty flank. check_id is the line's place."""
    f = F.split(F.trim("value"), r"\s+")
    flank = lambda i: F.when(f[i] == "None", "").otherwise(f[i])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    return lines.select(F.format_string("%020d", "line").alias("check_id"), f[0].alias("motif"), f[1].cast("int").alias("copies"), flank(2).alias("lflank"), flank(3).alias("rflank"))


def read_report(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A repeat finder's report: file_idx, name, name_ord, line_ord, tokens."""
    from repeatloom.operators.trf import report_rows

    return report_rows(numbered_lines(spark, paths).withColumnRenamed("line", "line_ord"))


def parse_blocks(reads: DataFrame) -> DataFrame:
    """Blocks from reads whose header has the five fields of a block; others are left out."""
    f = F.split("name", "\t")
    number = F.regexp_extract(f[0], "([0-9]+)$", 1).cast("long")
    return reads.where(F.size(f) == 5).select(
        number.alias("block_id"), f[1].alias("motif"), F.split(f[2], ",").cast("array<int>").alias("copies"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), "seq", "qual"
    )


# Text forms


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def fasta_text(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def quality_text(name: Column, qual: Column, offset: int = 33) -> Column:
    """Qualities as numbers separated by blanks, under a FASTA header."""
    numbers = F.transform(F.split(qual, ""), lambda c: (F.ascii(c) - offset).cast("string"))
    return F.concat(F.lit(">"), name, F.lit("\n"), F.when(qual == "", "").otherwise(F.array_join(numbers, " ")))


def annotated_text(str_reads: DataFrame) -> DataFrame:
    """Selected reads as FASTQ with the nine-field header: file_idx, ord, value."""
    from repeatloom.operators.select import annotated_name

    return str_reads.select("file_idx", "ord", fastq_text(annotated_name(F.col("name"), F.col("fwd"), F.col("rc")), F.col("seq"), F.col("qual")).alias("value"))


def block_text(blocks: DataFrame) -> DataFrame:
    """Blocks as FASTQ with the five-field header: block_id, value."""
    name = F.concat_ws("\t", F.concat(F.lit("Block"), F.col("block_id").cast("string")), "motif", F.array_join(F.col("copies").cast("array<string>"), ","), F.col("start").cast("string"), F.col("end").cast("string"))
    return blocks.select("block_id", fastq_text(name, F.col("seq"), F.col("qual")).alias("value"))


def contig_text(contigs: DataFrame) -> DataFrame:
    """Contigs as FASTA: name, a tab, then motif, copies, start and end with colons."""
    place = F.concat_ws(":", "motif", "copies", F.col("start").cast("string"), F.col("end").cast("string"))
    return contigs.select("name", fasta_text(F.concat_ws("\t", "name", place), F.col("seq")).alias("value"))


def report_text(top: DataFrame) -> DataFrame:
    """Top rows of a report: name and all tokens, separated by tabs."""
    return top.select("name_ord", F.concat_ws("\t", "name", F.array_join("tokens", "\t")).alias("value"))


def write_ordered(texts: DataFrame, path: str, *order: str) -> None:
    """Column value as text files that follow each other in this order."""
    texts.orderBy(*order).select("value").write.text(path)
