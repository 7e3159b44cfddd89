"""Which entries of a check-list of known repeats the selected reads support, and which reads support none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatloom.functions.dna import revcomp, same_prefix_letters

#: Letters of a read's flank that are compared.
FLANK = 20
#: Most entries that are sent to all tasks (some 60 MB); a longer list is joined.
MOST_SENT = 200_000
#: Comparisons of a read's flanks with an entry's done at once.
CELLS = 200_000


def flank_identity(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Ungapped identity in percent: left flanks aligned at their ends, right flanks at their starts,
    over the shorter lengths and in either case; null if nothing is compared."""
    same = same_prefix_letters(F.reverse(left_a), F.reverse(left_b)) + same_prefix_letters(right_a, right_b)
    n = F.least(F.length(left_a), F.length(left_b)) + F.least(F.length(right_a), F.length(right_b))
    return F.when(n > 0, same * 100.0 / n)


def with_probes(str_reads: DataFrame) -> DataFrame:
    """file_idx, ord and p: four probes of each read, in order: its match, the reverse complement of it, and both for the other strand."""
    s, r = F.col("seq"), revcomp(F.col("seq"))

    def own(text: Column, m: Column) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), m["start"] - FLANK)
        return F.substr(text, first + 1, m["start"] - first), F.substr(text, m["end"] + 1, F.lit(FLANK))

    out = []
    for text, m in ((s, F.col("fwd")), (r, F.col("rc"))):
        left, right = own(text, m)
        out += [(m["motif"], m["copies"], left, right), (revcomp(m["motif"]), m["copies"], revcomp(right), revcomp(left))]
    structs = [F.struct(F.lit(i).alias("probe"), a.alias("motif"), b.alias("copies"), c.alias("lflank"), d.alias("rflank")) for i, (a, b, c, d) in enumerate(out)]
    return str_reads.select("file_idx", "ord", F.array(*structs).alias("p"))


def _cells(texts: list[str], reverse: bool, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The first FLANK letters of each text (the last ones, backwards, with reverse) in upper case, and how many there are."""
    cut = [(t[::-1] if reverse else t)[:FLANK].upper() for t in texts]
    out = np.full((len(cut), FLANK), fill, np.uint32)
    n = np.array([len(t) for t in cut], np.int64)
    out[np.arange(FLANK) < n[:, None]] = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32)
    return out, n


class _List:
    """The entries by motif and copies, in their order, as arrays of letters; equal ones once, as the first of them always comes first."""

    def __init__(self, rows: list) -> None:
        by: dict[tuple, dict[tuple, str]] = {}
        for r in sorted(rows, key=lambda r: r["check_id"]):
            by.setdefault((r["motif"], r["copies"]), {}).setdefault((r["c_left"].upper(), r["c_right"].upper()), r["check_id"])
        self.entries = {k: (list(v.values()), _cells([a for a, _ in v], True, 1), _cells([b for _, b in v], False, 1)) for k, v in by.items()}

    def first_and_best(self, key: tuple, left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of flanks the place of the first entry above the least identity (-1 for none), and the best identity."""
        _, (l, nl), (r, nr) = self.entries[key]
        first, best = np.full(len(left), -1), np.zeros(len(left))
        step = max(1, CELLS // len(nl))
        for k in range(0, len(left), step):
            (a, na), (b, nb) = _cells(left[k : k + step], True, 2), _cells(right[k : k + step], False, 2)
            n = np.minimum(na[:, None], nl) + np.minimum(nb[:, None], nr)
            same = sum((a[:, i, None] == l[:, i]).astype(np.int64) + (b[:, i, None] == r[:, i]) for i in range(FLANK))
            identity = np.where(n > 0, same * 100.0 / np.maximum(n, 1), 0.0)
            hit = identity > least
            first[k : k + step] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
            best[k : k + step] = identity.max(axis=1)
        return first, best


def _compared(batches: Iterator[pa.RecordBatch], listed: _List, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        p = b["p"].flatten()
        motif, copies, left, right = (p.field(c).to_pylist() for c in ("motif", "copies", "lflank", "rflank"))
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(motif, copies, strict=True)):
            if key in listed.entries:
                rows.setdefault(key, []).append(i)
        ids: list[str | None] = [None] * len(motif)
        best = np.zeros(len(motif))
        for key, at in rows.items():
            first, identity = listed.first_and_best(key, [left[i] for i in at], [right[i] for i in at], least)
            best[at] = identity
            for i, f in zip(at, first.tolist(), strict=True):
                if f >= 0:
                    ids[i] = listed.entries[key][0][f]
        found = [next((x for x in ids[i : i + 4] if x is not None), None) for i in range(0, len(ids), 4)]
        yield pa.RecordBatch.from_arrays([b["file_idx"], b["ord"], pa.array(found, pa.string()), pa.array(best.reshape(-1, 4).max(axis=1))], names=["file_idx", "ord", "check_id", "best"])


def checklist_matches(str_reads: DataFrame, checks: DataFrame, min_identity: float = 90.0) -> DataFrame:
    """The entry each read counts for: file_idx, ord, check_id and the best identity with any entry.

    checks: check_id (its order), motif, copies, lflank, rflank; null flanks are empty. A read counts for the first entry, by
    probe and then by check_id, whose flanks agree in more than min_identity percent; without one check_id is null, and
    without an entry of its motif and copies best is 0. A list of up to MOST_SENT entries goes to all tasks, so reads are answered where
    they are, without a shuffle, however many have one motif; a longer list is joined."""
    listed = checks.where("check_id is not null and motif is not null and copies is not null").select(
        F.col("check_id").cast("string").alias("check_id"), "motif", F.col("copies").cast("int").alias("copies"), F.coalesce("lflank", F.lit("")).alias("c_left"), F.coalesce("rflank", F.lit("")).alias("c_right")
    )
    probed = with_probes(str_reads)
    rows = listed.limit(MOST_SENT + 1).collect()  # the limit only tells whether the list is longer
    if len(rows) <= MOST_SENT:
        sent = str_reads.sparkSession.sparkContext.broadcast(_List(rows))
        schema = T.StructType([*probed.schema.fields[:2], T.StructField("check_id", T.StringType()), T.StructField("best", T.DoubleType())])
        return probed.mapInArrow(lambda it: _compared(it, sent.value, min_identity), schema)
    return joined_matches(probed, listed, min_identity)


def joined_matches(probed: DataFrame, listed: DataFrame, min_identity: float) -> DataFrame:
    """checklist_matches by a join on motif and copies."""
    identity = F.coalesce(flank_identity(F.col("c_left"), F.col("c_right"), F.col("lflank"), F.col("rflank")), F.lit(0.0))
    pairs = probed.select("file_idx", "ord", F.inline("p")).join(listed, ["motif", "copies"], "left").withColumn("pid", F.when(F.col("check_id").isNotNull(), identity).otherwise(0.0))
    return pairs.groupBy("file_idx", "ord").agg(F.min(F.when(F.col("pid") > min_identity, F.struct("probe", "check_id")))["check_id"].alias("check_id"), F.max("pid").alias("best"))


def checklist_hits(str_reads: DataFrame, checks: DataFrame, min_identity: float = 90.0) -> DataFrame:
    """Reads for each entry of the list: check_id, motif, copies, found; entries without reads have 0."""
    counts = checklist_matches(str_reads, checks, min_identity).where("check_id is not null").groupBy("check_id").agg(F.count(F.lit(1)).alias("found"))
    return checks.select("check_id", "motif", "copies").join(counts, "check_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def checklist_misses(str_reads: DataFrame, checks: DataFrame, min_identity: float = 90.0) -> DataFrame:
    """Reads that no entry accepts: file_idx, ord, best (their best identity with any entry, 0 without one)."""
    return checklist_matches(str_reads, checks, min_identity).where("check_id is null").select("file_idx", "ord", "best")


def with_check_ids(checks: DataFrame) -> DataFrame:
    """A check-list without an order of its own gets one by its values; repeated rows follow each other."""
    order = Window.partitionBy("motif", "copies").orderBy("lflank", "rflank")
    return checks.withColumn("check_id", F.concat_ws(":", "motif", "copies", F.row_number().over(order).cast("string")))
