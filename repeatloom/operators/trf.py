"""From a repeat finder's report to one row for each sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least start, unit sizes, least copies of units of 2 and of longer ones.
MIN_START, MIN_UNIT, MAX_UNIT, MIN_COPIES_2, MIN_COPIES = 100, 2, 6, 7, 5


def _number(i: int) -> Column:
    return F.expr(f"try_cast(get(tokens, {i}) as double)")


def top_repeats(trf: DataFrame, ascending: bool = True) -> DataFrame:
    """One row of the report for each sequence: the least by sort key (token 5), then by all tokens.

    trf: name, name_ord, line_ord, tokens. Rows count that start at 100 or later and repeat a unit of 2
    at least 7 times or one of 3 to 6 at least 5 times, copies cut to whole numbers. Rows that
    are short or where these tokens are no numbers do not count; names without rows are left out.
    Gives name, name_ord, line_ord, tokens; a header that comes again (another name_ord) gives the row again.
    """
    start, unit, copies, score = (_number(i) for i in (0, 2, 3, 5))
    rows = trf.select("name", "name_ord", "line_ord", "tokens", score.alias("score")).where(
        (start >= MIN_START) & unit.between(MIN_UNIT, MAX_UNIT) & (F.floor(copies) >= F.when(unit == 2, MIN_COPIES_2).otherwise(MIN_COPIES)) & F.col("score").isNotNull()
    )
    pick = (F.min if ascending else F.max)(F.struct("score", "tokens", "line_ord"))
    best = rows.groupBy("name").agg(pick.alias("b"))
    headers = trf.select("name", "name_ord").distinct()
    return headers.join(best, "name").select("name", "name_ord", F.col("b.line_ord").alias("line_ord"), F.col("b.tokens").alias("tokens"))


def report_rows(lines: DataFrame) -> DataFrame:
    """lines (file_idx, line_ord, value) of a report as trf rows: every line belongs to the last
    header, a line that starts with @, before it in its file. Lines before any header are left out."""
    from pyspark.sql import Window

    order = Window.partitionBy("file_idx").orderBy("line_ord")
    header = F.col("value").startswith("@")
    tagged = lines.withColumn("h", F.last(F.when(header, F.struct(F.trim(F.expr("substr(value, 2)")).alias("name"), F.col("line_ord").alias("name_ord"))), ignorenulls=True).over(order))
    return tagged.where(~header & F.col("h").isNotNull() & (F.trim("value") != "")).select("file_idx", "h.name", "h.name_ord", "line_ord", F.split(F.trim("value"), r"\s+").alias("tokens"))
