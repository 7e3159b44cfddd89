"""Has this key been seen before? An exact ledger of all keys, kept on disk in hash buckets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.shared import drop, fresh_path

#: Appended batches after which the ledger is compacted, and keys of a bucket from which on compaction doubles the buckets.
COMPACT_AFTER, KEYS_PER_BUCKET = 16, 4_000_000
_VERSION = re.compile(r"v(\d+)-b(\d+)$")


class KeyLedger:
    """Keys of all batches so far as one bucketed table in a folder: the shared one, or any path that all executors reach.

    The history is written once, hash-partitioned by key into buckets and sorted in them, and never
    shuffled again: a batch is brought to the same buckets and joined to it there. Answers are
    exact, so the rate of wrong ones is zero. Memory holds one sorted bucket at a time; a key
    with many rows is reduced to its first arrival before the shuffle, so no key is hot.

    A ledger outlives its session: KeyLedger(spark, path=...) opens the one at a path, or begins it. A batch has an id, and
    the keys that it added carry it; a batch that runs again, after a failure or on purpose, gets the same answers and adds nothing.
    After COMPACT_AFTER batches the files of each bucket are merged into one, and buckets that have grown beyond KEYS_PER_BUCKET keys are
    doubled; the new version is complete before the old one goes.

    Null and empty keys are never seen and never recorded. Rows of equal arrival are ranked by
    row_id. An empty batch or history is allowed.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "ledger")
        found = self._versions()
        self.version, self.buckets = max(found) if found else (0, buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self._register()
        self.recorded = bool(found) and not self.keys().isEmpty()
        self.appended = 0

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, int]]:
        """Complete versions in the folder: number and buckets."""
        at, fs = self._fs()
        found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [p for p in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [(int(m[1]), int(m[2])) for p in done if (m := _VERSION.search(p.getName()))]

    def _at(self, version: int, buckets: int) -> str:
        return f"{self.path}/v{version}-b{buckets}"

    def _register(self) -> None:
        """The current version as a table of this session's catalog, which knows its buckets."""
        self.name = "ledger_" + uuid.uuid4().hex
        place = self._at(self.version, self.buckets).replace("'", "''")
        self.spark.sql(
            f"create table {self.name} (kind string, key string, row_id bigint, batch string) using parquet options (compression 'zstd') "
            f"clustered by (kind, key) sorted by (kind, key) into {self.buckets} buckets location '{place}'"
        )

    def _append(self, keys: DataFrame, name: str) -> None:
        """keys: kind, key, row_id, batch, each (kind, key) once and not yet recorded."""
        rows = keys.select("kind", "key", "row_id", "batch").repartition(self.buckets, "kind", "key")  # one file for each bucket
        rows.write.format("parquet").bucketBy(self.buckets, "kind", "key").sortBy("kind", "key").mode("append").saveAsTable(name)
        self.spark.catalog.refreshTable(name)
        self.recorded = True

    def load(self, history: DataFrame, batch: str = "history") -> KeyLedger:
        """Records keys of earlier runs: columns kind and key, duplicates allowed. Comes first; does nothing if the ledger has this batch."""
        if not (self.recorded and self._has(batch)):
            keys = history.select("kind", "key").where("key != ''").distinct()
            if self.recorded:
                keys = keys.join(self.keys().select("kind", "key"), ["kind", "key"], "left_anti")
            self._append(keys.select("kind", "key", F.lit(None).cast("long").alias("row_id"), F.lit(batch).alias("batch")), self.name)
        return self

    def _has(self, batch: str) -> bool:
        return not self.keys().where(F.col("batch") == batch).isEmpty()

    def process(self, batch: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Answers a batch and appends its new keys, unless this batch_id has done so already.

        batch: kind, key, row_id (unique within kind), arrival (any ordered type).
        Gives kind, row_id and seen for every row whose key is not empty.
        """
        number = batch_id or uuid.uuid4().hex
        rows = batch.select("kind", "key", F.col("row_id").cast("long").alias("row_id"), "arrival").where("key != ''")
        again = batch_id is not None and self.recorded and self._has(number)
        if not again:
            if self.appended >= COMPACT_AFTER:
                self.compact()
            # Rank 1 by arrival of each key, pre-aggregated: the only row of the batch that can be new.
            first = rows.groupBy("kind", "key").agg(F.min(F.struct("arrival", "row_id")).alias("first")).select("kind", "key", "first.row_id")
            if self.recorded:
                past = self.keys().select("kind", "key", F.lit(True).alias("known"))
                first = first.join(past.hint("merge"), ["kind", "key"], "left").where(F.col("known").isNull())
            self._append(first.withColumn("batch", F.lit(number)), self.name)
            self.appended += 1
        new = self.keys().where(F.col("batch") == number).select("kind", "row_id", F.lit(False).alias("seen"))
        return rows.select("kind", "row_id").join(new, ["kind", "row_id"], "left").select("kind", "row_id", F.coalesce("seen", F.lit(True)).alias("seen"))

    def compact(self) -> None:
        """One sorted file for each bucket, with twice the buckets if they hold too many keys. Answers that were not computed before read the old version."""
        old = self._at(self.version, self.buckets)
        rows, n = self.keys(), self.keys().count()
        while n > self.buckets * KEYS_PER_BUCKET:
            self.buckets *= 2
        self.version += 1
        self._register()
        self._append(rows, self.name)
        self.appended = 0
        drop(self.spark, old)

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)


def wrong_rates(answers: DataFrame) -> DataFrame:
    """answers: src, answer_of, answered, truth (booleans). Rows without an answer do not count.
    Gives n_rows, n_wrong and wrong_rate of each src and answer_of."""
    wrong = (F.col("answered") != F.col("truth")).cast("long")
    return (
        answers.where(F.col("answered").isNotNull())
        .groupBy("src", "answer_of")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(wrong).alias("n_wrong"))
        .withColumn("wrong_rate", F.col("n_wrong") / F.col("n_rows"))
    )
