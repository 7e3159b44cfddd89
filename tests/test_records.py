from repeatloom.operators import records

RAW = "rec_id long, file_idx int, kind string, raw string"


def reasons(spark, *rows):
    df = spark.createDataFrame([(i, 0, k, r) for i, (k, r) in enumerate(rows)], RAW)
    got = {r["rec_id"]: r["reason"] for r in records.failed(df).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_each_reason_and_the_first_one(spark):
    ok = "@r\nACGTn.\n+\nIIIIII"
    field = "@r\tAC\t3\t2\t8\tGT\t3\t1\t7\nACACACACAC\n+\nIIIIIIIIII\n"
    block = "@b\tAC\t3,4\t0\t10\nACACACACAC\n+x\nIIIIIIIIII\n"
    assert reasons(
        spark,
        ("reads", ok), ("reads", ok + "\n"), ("reads", ok.replace("\n", "\r\n") + "\r\n"), ("reads", "@r\n\n+\n\n"),
        ("reads", None), ("reads", ""), ("reads", ok + "\n\n"), ("reads", "r\nA\n+\nI"), ("reads", "@ \t\nA\n+\nI"),
        ("reads", "@r\nA\n-\nI"), ("reads", "@r\nAX\n+\nII"), ("reads", "@r\nAA\n+\nI"), ("reads", "@r\nA\n+\n "), ("reads", '@r"\nA\n+\nI'),
        ("reads", "@r\tx\nA\n+\nI"), ("reads", '@"r\tx"\nA\n+\nI'), ("str_reads", field), ("str_reads", field.replace("\tAC", "\tAN")), ("str_reads", field.replace("\t7\n", "\t11\n")),
        ("str_reads", field.replace("\t3\t2", "\t0\t2")), ("blocks", block), ("blocks", block.replace("3,4", "3,4,5")), ("blocks", block.replace("\t0\t10", "\t10\t10")), ("blocks", block.replace("3,4", "3,")),
        ("str_reads", field.replace("\t2\t8", "\t+2\t8")), ("str_reads", field.replace("\t2\t8", "\t2\t1234567890")), (None, ok), ("other", ok),
    ) == [None] * 4 + ["lines", "lines", "lines", "header", "header", "separator", "bases", "qual_length", "qual_chars", "quoting", "name_fields", None, None, "name_values", "name_values", "name_values", None, "name_values", "name_values", "name_values", "name_values", "name_values", "name_fields", "name_fields"]


def test_all_errors_are_told_and_valid_rows_become_columns(spark):
    df = spark.createDataFrame([(1, 0, "reads", "r\nAX\n-\nI"), (2, 0, "blocks", "@b\tAC\t3,4\t0\t8\nACACACAC\n+\nIIIIIIII"), (3, 0, "reads", '@a"\tx"y\nA\n+\nI'), (2, 1, "blocks", "@b\tAC\t3\t0\t8\nACACACAC\n+\nIIIIIIII")], RAW)
    errors = {r["rec_id"]: r["errors"] for r in records.parse_records(df.where("rec_id = 1")).collect()}
    assert errors[1] == ["header", "separator", "bases", "qual_length"]
    rows = sorted(records.valid(df).collect(), key=lambda r: (r["rec_id"], r["file_idx"]))
    assert [(r["name"], r["motif"], r["copies"], r["start"], r["end"], r["seq"]) for r in rows] == [("b", "AC", [3, 4], 0, 8, "ACACACAC"), ("b", "AC", [3], 0, 8, "ACACACAC"), ('a"\tx"y', None, None, None, None, "A")]


def test_no_rows_long_texts_and_clashing_columns(spark):
    empty = spark.createDataFrame([], RAW)
    assert records.failed(empty).count() == records.valid(empty).count() == 0
    long = "@r\n" + "A" * 300_000 + "\n+\n" + "I" * 300_000
    df = spark.createDataFrame([(1, 0, "reads", long, "x", "y", "z"), (1, 0, "reads", "@" + '"\t"' * 5000 + "\nA\n+\nI", "", "", "")], RAW + ", l string, errors string, f string")
    assert records.valid(df).count() == 2 and records.failed(df).count() == 0


def test_control_characters_in_names_stay(spark):
    df = spark.createDataFrame([(1, 0, "reads", "@a\x01b\x02\nA\n+\nI"), (2, 0, "blocks", '@"b\t\x01"\tAC\t3\t0\t6\nACACAC\n+\nIIIIII')], RAW)
    assert {r["rec_id"]: r["name"] for r in records.valid(df).collect()} == {1: "a\x01b\x02", 2: '"b\t\x01"'}
