import random
import re

import pytest
from pyspark.sql import functions as F

from repeatloom.functions.dna import canonical, phred_shift, quality_trim, revcomp, revcomp_iupac, strand_neutral
from repeatloom.operators import checklist, select

READS = "file_idx int, ord long, name string, seq string, qual string"


def brute(s, n, lengths, flank, homopolymers=True, rank_first=False):
    found = []
    for k in lengths:
        for p in range(len(s) - k + 1):
            m, c = s[p : p + k], 1
            while s[p + c * k : p + (c + 1) * k] == m:
                c += 1
            if c >= n and "N" not in m:
                found.append((c * k, c, m * c, m, p, p + c * k))
    fits = lambda x: x[4] >= flank and len(s) - x[5] >= flank and (homopolymers or len(set(x[3])) > 1)
    if rank_first:
        best = max(found, default=None)
        return best if best and fits(best) else None
    return max(filter(fits, found), default=None)


def rc(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def texts(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        parts = [r.choice("ACGTN" if r.random() < 0.1 else "ACGT") * r.choice((1, 1, 1, 5)) for _ in range(r.randrange(0, 25))]
        motif = "".join(r.choice("ACGT") for _ in range(r.randrange(1, 7)))
        yield "".join(parts) + motif * r.randrange(0, 6) + "".join(r.choice("ACGT") for _ in range(r.randrange(0, 12)))


@pytest.mark.parametrize(("n", "flank", "lengths", "options"), [(2, 0, (2, 3, 4, 5, 6), {}), (3, 4, (2, 3, 4, 5, 6), {}), (3, 2, (3, 5), {"remove_homopolymers": True}), (3, 4, (2, 3, 4, 5, 6), {"rank_before_filter": True}), (1, 3, (2, 6), {})])
def test_select_equals_brute_force(spark, n, flank, lengths, options):
    seqs = list(texts(n * 7 + flank, 120)) + ["", "A", None]
    rows = [(0, i, f"r{i}", s, s) for i, s in enumerate(seqs)]
    got = {r["ord"]: (tuple(r["fwd"]), tuple(r["rc"])) for r in select.select_str_reads(spark.createDataFrame(rows, READS), n, flank, lengths, **options).collect()}
    args = (n, lengths, flank, not options.get("remove_homopolymers"), bool(options.get("rank_before_filter")))
    want = {i: (a, b) for i, s in enumerate(seqs) if s and (a := brute(s, *args)) and (b := brute(rc(s), *args))}
    assert got == want and want
    expression = spark.createDataFrame(rows, READS).select("ord", select.best_match(F.col("seq"), n, flank, lengths, **options).alias("b")).where("b is not null")
    one = {r["ord"]: tuple(r["b"]) for r in expression.collect()}
    assert one == {i: tuple(r["fwd"]) for r in select.with_best_matches(spark.createDataFrame(rows, READS), ("fwd",), n, flank, lengths, **options).collect() for i in [r["ord"]]}


def test_ties(spark):
    best = lambda s, n: tuple(spark.range(1).select(select.best_match(F.lit(s), n, 0).alias("b")).first()["b"])
    assert best("ATATATAT", 2)[1:4] == (4, "ATATATAT", "AT")  # more copies, not the longer motif
    assert best("A" * 9, 2)[:2] == (9, 3)  # longest first: AAA x 3 and not AA x 4
    assert best("AGAGAG", 2)[3:] == ("AG", 0, 6)


def test_bad_arguments(spark):
    df = spark.createDataFrame([], READS)
    for args in ((0,), (2, 31, ()), (2, 31, (7,))):
        with pytest.raises(ValueError):
            select.select_str_reads(df, *args)


def test_annotated_header_round_trip(spark):
    s = "ACGTTGCAACGTAAGAAGAAGCATCGCGCGTTTACGATC"
    df = select.select_str_reads(spark.createDataFrame([(0, 0, "r", s, "I" * len(s))], READS), 3, 5)
    back = select.parse_annotated(df.withColumn("name", select.annotated_name(F.col("name"), F.col("fwd"), F.col("rc"))).drop("fwd", "rc"))
    assert back.select("name", "fwd", "rc").first() == df.select("name", "fwd", "rc").first()
    broken = select.parse_annotated(df.select("name", "seq")).first()
    assert broken["fwd"] is None and broken["name"] == "r"


def test_dna_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(revcomp(F.lit("ACGTNn.ag"))) == "ct.nNACGT"
    assert one(revcomp_iupac(F.lit("ACGTRYKM."))) == " KMRYACGT"
    assert one(strand_neutral(F.lit(" ttga\t"))) == "TCAA"
    assert one(canonical(F.lit("TTG"))) == "CAA"
    assert one(phred_shift(F.lit("@h~"))) == "!I_"
    assert one(quality_trim(F.lit('II#"!I##'))) == 'II#"!I'
    assert one(revcomp(F.lit(None).cast("string"))) is None


def test_checklist(spark):
    s = "ACGTTGCAACGTCCTGA" + "AAG" * 4 + "CATCGCGCGTTTACGATCA"
    df = select.select_str_reads(spark.createDataFrame([(0, i, "r", t, t) for i, t in enumerate((s, rc(s), s))], READS), 3, 5)
    checks = spark.createDataFrame([("1", "AAG", 4, "ACGTTGCAACGTCCTGA", "CATCGCGCGTTTACGATCA"), ("2", "AAG", 4, "ACGTTGCAACGTCCTGA", "CATCGCGCGTTTACGATCA"), ("3", "CTT", 4, None, None), ("4", "AC", 3, "A", "C")], "check_id string, motif string, copies int, lflank string, rflank string")
    found = {r["check_id"]: r["found"] for r in checklist.checklist_hits(df, checks).collect()}
    assert found == {"1": 3, "2": 0, "3": 0, "4": 0}


def test_pattern_of_the_guard():
    assert re.compile(r"(.{2})\1{2}|(.{3})\2{2}").search("ACACAC")
