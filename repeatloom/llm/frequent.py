"""Most frequent items among billions: Misra-Gries summaries per partition, merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUMMARY = "node int, field string, item string, approx_count long, max_error long"
_ARROW = pa.schema([("node", pa.int32()), ("field", pa.string()), ("item", pa.string()), ("approx_count", pa.int64()), ("max_error", pa.int64())])
#: Rows gathered before a summary takes them in, and summaries merged by one task of the tree.
CHUNK, FAN_IN = 65_536, 32


def _merge(parts: list[pa.Table], k: int) -> dict[str, tuple[pa.Table, int]]:
    """Of each field: at most k counters, and how much any count may be short. A part has the columns
    field, item, approx_count and max_error; its rows without an item carry its error."""
    out = {}
    table = pa.concat_tables(parts)
    for field in pc.unique(table["field"]).to_pylist():
        own = table.filter(pc.equal(table["field"], field))
        error = pc.sum(own["max_error"].filter(pc.is_null(own["item"]))).as_py() or 0
        sums = own.filter(pc.is_valid(own["item"])).group_by("item").aggregate([("approx_count", "sum")])
        counts = sums["approx_count_sum"]
        if sums.num_rows > k:
            # The next-largest counter is taken off all: at most k counters stay above zero.
            cut = counts.take(pc.array_sort_indices(counts, order="descending").slice(k, 1))[0].as_py()
            counts, error = pc.subtract(counts, cut), error + cut
            keep = pc.greater(counts, 0)
            sums, counts = sums.filter(keep), counts.filter(keep)
        out[field] = pa.table({"item": sums["item"], "approx_count": counts}), error
    return out


def _rows(node: int, summaries: dict[str, tuple[pa.Table, int]]) -> pa.Table:
    tables = [_ARROW.empty_table()]
    for field, (t, error) in summaries.items():
        n = t.num_rows + 1
        items, counts = [*t["item"].to_pylist(), None], [*t["approx_count"].to_pylist(), 0]
        tables.append(pa.table([pa.array([node] * n, pa.int32()), pa.array([field] * n, pa.string()), pa.array(items, pa.string()), pa.array(counts, pa.int64()), pa.array([error] * n, pa.int64())], schema=_ARROW))
    return pa.concat_tables(tables)


def _summarise(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    state: list[pa.Table] = []
    held: list[pa.Table] = []
    rows = 0

    def take_in() -> None:
        nonlocal state, held, rows
        state, held, rows = [_rows(0, _merge(state + held, k)).drop_columns("node")], [], 0

    for b in batches:
        t = pa.Table.from_batches([b])
        held.append(pa.table({"field": t["field"], "item": t["item"], "approx_count": t["weight"], "max_error": pa.array([0] * t.num_rows, pa.int64())}))
        rows += t.num_rows
        if rows >= CHUNK:
            take_in()
    if rows:
        take_in()
    if state:
        n = state[0].num_rows
        yield from state[0].add_column(0, "node", pa.array([TaskContext.get().partitionId()] * n, pa.int32())).cast(_ARROW).combine_chunks().to_batches()


def misra_gries(items: DataFrame, k: int) -> DataFrame:
    """Frequent values of each field with approximate counts, in bounded memory.

    items: field, item, weight (null or empty items and weights that are null or below 1 do not
    count). Gives field, item, approx_count, max_error: at most k rows a field, true count
    between approx_count and approx_count + max_error, and max_error at most the field's weight
    divided by k + 1, so every item above that is there. Each partition keeps k counters a field;
    summaries are merged FAN_IN at a time in a tree, each time taking off the next-largest
    counter; no task sees more than FAN_IN summaries. No rows give no rows.
    """
    items = items.select("field", F.col("item"), F.col("weight").cast("long").alias("weight")).where("item is not null and item != '' and weight >= 1")
    nodes = items.rdd.getNumPartitions()
    out = items.mapInArrow(lambda it: _summarise(it, k), SUMMARY)

    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        return _rows(int(key[0].as_py()), _merge([t], k))

    while nodes > 1:
        out = out.groupBy(F.floor(F.col("node") / FAN_IN).cast("int").alias("up")).applyInArrow(reduce, SUMMARY)
        nodes = -(-nodes // FAN_IN)
    return out.where("item is not null").select("field", "item", "approx_count", "max_error")


def frequent(items: DataFrame, shares: dict[str, tuple[int, int]], min_rows: int, k: int = 1000) -> DataFrame:
    """Values that make up at least a share (numerator, denominator) of the field's weight, in at least min_rows rows.

    The summary names the candidates (k has to reach 1 / share), a second scan counts only these
    exactly; the candidates are at most k a field, so they are broadcast. Gives field, item,
    n_rows and weight.
    """
    if any(num * (k + 1) <= den for num, den in shares.values()):
        raise ValueError("k is too small for these shares")
    items = items.select("field", "item", F.col("weight").cast("long").alias("weight")).where("item is not null and item != '' and weight >= 1")
    candidates = misra_gries(items, k).select("field", "item", F.lit(True).alias("hit"))
    counted = (
        items.join(F.broadcast(candidates), ["field", "item"], "left")
        .groupBy("field", F.when(F.col("hit"), F.col("item")).alias("item"))
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_rows"))
    )
    # At most k + 1 rows a field: the window over them is small, and the items are scanned once.
    counted = counted.withColumn("total", F.sum("weight").over(Window.partitionBy("field")))
    part = lambda i: F.create_map(*[x for f, s in shares.items() for x in (F.lit(f), F.lit(s[i]).cast("long"))])[F.col("field")]
    enough = F.col("item").isNotNull() & (F.col("n_rows") >= min_rows) & (F.col("weight") * part(1) >= F.col("total") * part(0))
    return counted.where(enough).select("field", "item", "n_rows", "weight")
