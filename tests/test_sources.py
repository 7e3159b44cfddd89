import gzip

import pytest

from repeatloom.sources import fastq
from repeatloom.streaming import select_stream


def test_fastq_files(spark, tmp_path):
    plain, packed = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    plain.write_text("".join(f"@r{i} x\nacgtN.\n+\nIII#\"!\n" for i in range(50)) + "@last\r\nAC\r\n+\r\nII")
    packed.write_bytes(gzip.compress(b"@z\nA\n+\nI\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")  # records straddle the splits
    try:
        rows = fastq.read_fastq(spark, [str(plain), str(packed)], trim=True).orderBy("file_idx", "ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["ord"] for r in rows] == [*range(51), 0]
    assert tuple(rows[3])[2:] == ("r3 x", "ACG", "III") and rows[50]["name"] == "last" and rows[51]["file_idx"] == 1


def test_fastq_beyond_the_splits_that_are_sent(spark, tmp_path, monkeypatch):
    f = tmp_path / "a.fq"
    f.write_text("".join(f"@r{i}\nAC{'G' * (i % 7)}\n+\nII{'I' * (i % 7)}\n" for i in range(200)) + "@cut\nAC\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37")
    try:
        sent = sorted(map(tuple, fastq.read_fastq(spark, str(f), strict=False).collect()))
        monkeypatch.setattr(fastq, "MOST_SPLITS", 3)
        assert sent == sorted(map(tuple, fastq.read_fastq(spark, str(f), strict=False).collect())) and len(sent) == 200
        with pytest.raises(Exception, match="not a FASTQ record"):
            fastq.read_fastq(spark, str(f)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none.fq").write_text("")
    assert fastq.read_fastq(spark, str(tmp_path / "none.fq")).count() == 0


def test_bad_fastq(spark, tmp_path):
    f = tmp_path / "a.fq"
    f.write_text("@a\nAXG\n+\nIII\n@b\nACG\n+\nIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fastq.read_fastq(spark, str(f)).collect()
    assert [r["name"] for r in fastq.read_fastq(spark, str(f), strict=False).collect()] == ["b"]


def test_texts_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, i, f"r{i}", "ACGT" * (i + 1), "IIII" * (i + 1)) for i in range(20)], "file_idx int, ord long, name string, seq string, qual string")
    from pyspark.sql import functions as F

    fastq.write_ordered(df.select("file_idx", "ord", fastq.fastq_text(F.col("name"), F.col("seq"), F.col("qual")).alias("value")), str(tmp_path / "out"), "file_idx", "ord")
    back = fastq.read_fastq(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert df.limit(1).select(fastq.quality_text(F.col("name"), F.lit("!I"))).first()[0] == ">r0\n0 40"


def test_check_list_and_report_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("AAG 4 ACGT None\n\nAC\t3 None TT\n")
    assert [tuple(r)[1:] for r in fastq.read_checks(spark, str(tmp_path / "c.txt")).orderBy("check_id").collect()] == [("AAG", 4, "ACGT", ""), ("AC", 3, "", "TT")]
    (tmp_path / "t.txt").write_text("x\n@b1 \n100 2 3\n4\n@b2\n@b1\n5\n")
    assert [(r["name"], r["name_ord"], r["tokens"]) for r in fastq.read_report(spark, str(tmp_path / "t.txt")).orderBy("line_ord").collect()] == [("b1", 1, ["100", "2", "3"]), ("b1", 1, ["4"]), ("b1", 5, ["5"])]


def test_streams(spark, tmp_path):
    s = "ACGTTGCAACGTCCTGA" + "AAG" * 4 + "CATCGCGCGTTTACGATCA"
    schema = "file_idx int, ord long, name string, seq string, qual string, at timestamp"
    df = spark.sql("select timestamp'2024-01-01' t").crossJoin(spark.createDataFrame([(0, 1, "a", s, s), (0, 2, "b", "ACGT", "IIII")], schema.rpartition(",")[0]))
    df.select("file_idx", "ord", "name", "seq", "qual", df["t"].alias("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = select_stream.select_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), num_copies=3, flank=5)
    q.awaitTermination()
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
    q = select_stream.windowed_kmers(stream, 5, "at").writeStream.format("memory").queryName("km").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("km").selectExpr("sum(cnt)").first()[0] == len(s) - 4
