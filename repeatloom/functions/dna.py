"""DNA column expressions; every function takes and gives Columns and maps null to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of the two complement alphabets.
COMPLEMENT_FROM, COMPLEMENT_TO = "atcgnATCGN", "tagcnTAGCN"
IUPAC_FROM, IUPAC_TO = "ABCDGHKMNRSTVWXY", "TVGHCDMKNYSABWXR"
#: What counts as blank at the ends of a value.
BLANKS = " \t\r"


def trimmed(c: Column) -> Column:
    """Without blanks, tabs and carriage returns at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def bases(c: Column) -> Column:
    """Upper-case trimmed letters of a read."""
    return F.upper(trimmed(c))


def revcomp(c: Column) -> Column:
    """Reverse complement over A, C, G, T and N in either case; other characters stay."""
    return F.reverse(F.translate(c, COMPLEMENT_FROM, COMPLEMENT_TO))


def revcomp_iupac(c: Column) -> Column:
    """Reverse complement over the whole ambiguity alphabet in either case; other characters become blanks."""
    both, to = IUPAC_FROM + IUPAC_FROM.lower(), IUPAC_TO + IUPAC_TO.lower()
    return F.reverse(F.regexp_replace(F.translate(c, both, to), f"[^{both}]", " "))


def strand_neutral(c: Column) -> Column:
    """The upper-case trimmed letters or their reverse complement, whichever sorts first."""
    s = bases(c)
    return F.least(s, revcomp(s))


def solid_letters(c: Column) -> Column:
    """Letters as 2-bit codes see them: upper case, N read as A. Reverse complements are taken after this."""
    return F.translate(F.upper(c), "N", "A")


def canonical(c: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(c, revcomp(c))


def is_homopolymer(motif: Column) -> Column:
    """Whether all letters are the same."""
    return motif == F.repeat(F.substring(motif, 1, 1), F.length(motif))


def phred_shift(qual: Column) -> Column:
    """Phred+64 codes as Phred+33: every character from @ to ~ moves down by 31."""
    codes = range(64, 127)
    return F.translate(qual, "".join(map(chr, codes)), "".join(chr(x - 31) for x in codes))


def quality_trim(qual: Column) -> Column:
    """Phred+33 qualities without the trailing codes of Phred 2 or less."""
    return F.regexp_replace(qual, '[!"#]+$', "")


def same_prefix_letters(a: Column, b: Column) -> Column:
    """How many positions agree, in either case, over the shorter length from the left."""
    n = F.least(F.length(a), F.length(b))
    x, y = F.upper(a), F.upper(b)
    return F.when(n == 0, 0).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))).cast("int")
        )
    )
