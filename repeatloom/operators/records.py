"""Rows that fail to parse: FASTQ records as received, split into columns and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The reasons in the order in which they are looked for.
REASONS = ("lines", "header", "separator", "bases", "qual_length", "qual_chars", "quoting", "name_fields", "name_values")
#: Fields of a name by kind.
FIELDS = {"reads": 1, "str_reads": 9, "blocks": 5}
#: Stands for a tab outside quotes while a name is split: a name is part of one line, so it has none of its own.
_OUTER = "\n"


def _number(c: Column) -> Column:
    """1 to 9 digits as an int, else null: a cast that never fails."""
    return F.when(c.rlike(r"\A[0-9]{1,9}\z"), c.cast("int"))


def _wrong_match(f: Column, at: int, length: Column, pair: bool) -> Column:
    """Whether motif, copies, start and end in the fields from `at` on break a rule."""
    motif, copies, start, end = (F.get(f, F.lit(at + i)) for i in range(4))
    counts = F.split(copies, ",", -1) if pair else F.array(copies)
    return ~F.coalesce(
        motif.rlike(r"\A[ACGT]{2,6}\z")
        & (F.size(counts) <= (2 if pair else 1))
        & F.forall(counts, lambda c: F.coalesce(_number(c) > 0, F.lit(False)))
        & (_number(start) < _number(end))
        & (_number(end) <= length),
        F.lit(False),
    )


def parse_records(raw: DataFrame) -> DataFrame:
    """raw (rec_id, file_idx, kind, raw) with its text split into nullable text columns and errors, the array of all reasons
    for which a row does not parse, in the order of REASONS; empty for a valid row. Later rules are not
    looked at where the record has not four lines.

    Carriage returns and one newline at the end do not count. Null text fails by `lines`; a kind that is null or
    unknown has no number of fields and fails by `name_fields`. Fields are split at tabs outside
    double quotes and keep their quotes. Nothing is cast before a rule has shown that it can be. No shuffle.
    """
    text = F.when(F.col("t").endswith("\n"), F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    rows = raw.select("rec_id", "file_idx", "kind", F.translate("raw", "\r", "").alias("t")).select("rec_id", "file_idx", "kind", F.split(text, "\n", -1).alias("l"))
    line = [F.get("l", F.lit(i)) for i in range(4)]
    rows = rows.select("rec_id", "file_idx", "kind", (F.size("l") == 4).alias("four"), *[x.alias(f"l{i}") for i, x in enumerate(line)])
    name = F.expr("substr(l0, 2)")
    parts = F.split(name, '"', -1)
    marked = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, "\t", _OUTER)).otherwise(p)), '"')
    rows = rows.withColumns({"odd": F.size(parts) % 2 == 0, "f": F.split(marked, _OUTER, -1)})
    n = F.length("l1")
    kind = F.col("kind")
    rules = {
        "header": ~F.col("l0").startswith("@") | (F.btrim(name, F.lit(" \t")) == ""),
        "separator": ~F.col("l2").startswith("+"),
        "bases": F.col("l1").rlike("[^acgtnACGTN.]"),
        "qual_length": F.length("l3") != n,
        "qual_chars": F.col("l3").rlike("[^!-~]"),
        "quoting": F.col("odd"),
        "name_fields": F.size("f") != F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FIELDS.items()], F.lit(-1)),
        "name_values": ((kind == "str_reads") & (_wrong_match(F.col("f"), 1, n, False) | _wrong_match(F.col("f"), 5, n, False))) | ((kind == "blocks") & _wrong_match(F.col("f"), 1, n, True)),
    }
    four = F.coalesce("four", F.lit(False))
    errors = F.when(~four, F.array(F.lit("lines"))).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(r)) for r, rule in rules.items()])))
    return rows.select("rec_id", "file_idx", "kind", F.col("f").alias("fields"), F.col("l1").alias("seq"), F.col("l3").alias("qual"), errors.alias("errors"))


def failed(raw: DataFrame) -> DataFrame:
    """rec_id and the first reason of each row that does not parse."""
    # The generator drops valid rows without computing the rules a second time for a filter.
    return parse_records(raw).select("rec_id", F.explode(F.slice("errors", 1, 1)).alias("reason"))


def valid(raw: DataFrame) -> DataFrame:
    """The rows that parse, as columns: name, the match of str_reads and blocks (copies as an array), that of the
    other strand of str_reads, bases and qualities. Columns that a kind has not are null."""
    f, kind = F.col("fields"), F.col("kind")

    def when(at: int, cast: str | None, *kinds: str) -> Column:
        c = F.get(f, F.lit(at))
        return F.when(kind.isin(*kinds), F.transform(F.split(c, ","), lambda x: x.cast("int")) if cast == "copies" else c.cast(cast) if cast else c)

    both = ("str_reads", "blocks")
    return (
        parse_records(raw)
        .where(F.size("errors") == 0)
        .select(
            "rec_id", "file_idx", "kind", f[0].alias("name"),
            when(1, None, *both).alias("motif"), when(2, "copies", *both).alias("copies"), when(3, "int", *both).alias("start"), when(4, "int", *both).alias("end"),
            when(5, None, "str_reads").alias("rc_motif"), when(6, "int", "str_reads").alias("rc_copies"), when(7, "int", "str_reads").alias("rc_start"), when(8, "int", "str_reads").alias("rc_end"),
            "seq", "qual",
        )
    )
