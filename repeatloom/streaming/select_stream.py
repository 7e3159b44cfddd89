"""Reads as they arrive: selection has no state, k-mer counts have one row for each k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repeatloom.functions.dna import canonical, solid_letters
from repeatloom.operators.kmers import odd, windows
from repeatloom.operators.select import select_str_reads


def select_stream(reads: DataFrame, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Selects reads of a stream and appends them as parquet; every read is in the sink once, also after a restart."""
    return select_str_reads(reads, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)


def windowed_kmers(reads: DataFrame, k: int, time: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Counts of k-mers in windows of arrival time. Rows later than `late` behind the newest one are left out, and
    a window's state goes when the watermark has passed it."""
    k = odd(k)
    s = reads.select(F.col(time).cast("timestamp").alias("at"), solid_letters(F.col("seq")).alias("s")).withWatermark("at", late).where(F.length("s") >= k)
    words = s.select("at", F.explode(windows(F.col("s"), k)).alias("w")).where(~F.col("w").rlike("[^ACGT]"))
    return words.groupBy(F.window("at", window).alias("window"), canonical(F.col("w")).alias("kmer")).agg(F.count(F.lit(1)).alias("cnt"))
