"""Column functions over nucleotide sequences. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The complement of each IUPAC letter, in both cases.
LETTERS, COMPLEMENTS = "ACGTRYKMBDHVSWNacgtrykmbdhvswn", "TGCAYRMKVHDBSWNtgcayrmkvhdbswn"

#: IUPAC codes by the set of bases they stand for; a set is a sum of A=1, C=2, G=4, T=8.
CODES = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def mean_quality(qual: Column) -> Column:
    """The mean Phred score of an ASCII-33 string; 0 when empty."""
    total = F.aggregate(F.filter(F.split(qual, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + F.ascii(c) - 33)
    return F.when(F.length(qual) > 0, total / F.length(qual)).otherwise(0.0)


def base_mask(base: Column) -> Column:
    """The set of bases that a code stands for; an unknown letter stands for any, a gap for none."""
    out = F.when(F.upper(base) == "-", 0)
    for code, mask in CODES.items():
        out = out.when(F.upper(base) == code, mask)
    return out.otherwise(15)


def mask_code(mask: Column) -> Column:
    """The code of a set of bases; N if the set is empty."""
    return F.when(mask > 0, F.substring(F.lit("".join(sorted(CODES, key=CODES.__getitem__))), mask.cast("int"), F.lit(1))).otherwise("N")


def bases_match(a: Column, b: Column) -> Column:
    """Whether two codes have a base in common; a gap matches a gap alone."""
    gap = (a == "-") | (b == "-")
    return F.when(gap, a == b).otherwise(base_mask(a).bitwiseAND(base_mask(b)) != 0)


def run_count(seq: Column) -> Column:
    """The number of maximal runs of one base: the independent sites of a sequence."""
    return F.size(F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1)))


def runs(seq: Column) -> Column:
    """array of (base, start, length): the maximal runs, places from 0."""
    parts = F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
    none = F.array().cast("array<struct<base:string,start:int,length:int>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["length"], F.lit(0))
    return F.aggregate(parts, none, lambda acc, p: F.array_append(acc, F.struct(F.substring(p, 1, 1).alias("base"), last(acc).alias("start"), F.length(p).alias("length"))))


def phred_of_error(rate: Column) -> Column:
    """The Phred score of an error rate, from 0 to 40."""
    return F.when(rate <= 0, 40).otherwise(F.least(F.lit(40), F.greatest(F.lit(0), F.round(-10 * F.log10(rate)).cast("int"))))


def normalised(seq: Column) -> Column:
    return F.upper(F.regexp_replace(seq, r"\s", ""))


def bounded_distance(a: Column, b: Column, least: float) -> Column:
    """The edit distance; -1 if either is empty or it's beyond what a similarity of ``least`` admits."""
    bound = F.floor(F.lit(1.0 - least) * F.greatest(F.length(a), F.length(b))).cast("int")
    return F.when((F.length(a) == 0) | (F.length(b) == 0), -1).otherwise(F.call_function("levenshtein", a, b, bound))


def similarity(a: Column, b: Column, least: float) -> Column:
    """1 - edit distance / longer length; 0 if either is empty or the distance is beyond what ``least`` admits."""
    d = bounded_distance(a, b, least)
    return F.when(d < 0, 0.0).otherwise(1.0 - d / F.greatest(F.length(a), F.length(b)))


def same_primers(a: Column, b: Column) -> Column:
    """Equal as sets; a missing or empty list equals any."""
    free = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return free | (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)))


def ambiguities(seq: Column) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), "[ACGT]", ""))


def merge_batch(size: Column, effort: int) -> Column:
    """How many variants of a group are merged at a time: effort + 1 - log2(size), from 4 to 8; 1 for one."""
    return F.when(size <= 1, 1).otherwise(F.least(F.lit(8), F.greatest(F.lit(4), effort + 1 - F.floor(F.log2(size)))).cast("int"))
