"""Reads made of texts: a stand-in for sequencing data that any table of texts can give."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dna_of_text(text: Column) -> Column:
    """Letters a to z of a text as A, C, G, T in turn; everything else is left out."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.translate(letters, string.ascii_lowercase, ("ACGT" * 7)[:26])


def reads_of_texts(texts: DataFrame, length: int = 100, stride: int = 50) -> DataFrame:
    """doc_id, ord, seq: windows of the DNA of each text; texts that are shorter, empty or null give none."""
    z = texts.select("doc_id", dna_of_text(F.col("text")).alias("z")).where(F.length("z") >= length)
    last = F.floor((F.length("z") - length) / stride).cast("int")
    return z.select("doc_id", "z", F.explode(F.sequence(F.lit(0), last)).alias("i")).select("doc_id", F.col("i").cast("long").alias("ord"), F.substr("z", F.col("i") * stride + 1, F.lit(length)).alias("seq"))
