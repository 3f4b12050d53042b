"""Distances and medians of sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES_PER_WORD = 16
#: A median set is not extended beyond one more than this.
MEDIAN_CAP = 100


def char_distance(a: Column, b: Column, length_term: bool = True) -> Column:
    """Differing characters over the shorter length, plus the difference in length unless ``length_term`` is off."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    shared = F.least(F.char_length(a), F.char_length(b))
    differing = F.size(F.filter(F.slice(pairs, F.lit(1), shared), lambda p: p["x"] != p["y"]))
    return differing + F.abs(F.char_length(a) - F.char_length(b)) if length_term else differing


def state_distance(a: Column, b: Column) -> Column:
    """Differing sites of two haplotype strings."""
    from locusflow.functions.genotype import differing_states

    return differing_states(F.split(a, "[|]"), F.split(b, "[|]"))


def base_code(base: Column) -> Column:
    """A, C, G, T as 0 to 3 in either case; every other character is 0."""
    return F.greatest(F.instr(F.lit("ACGT"), F.upper(base)) - 1, F.lit(0)).cast("long")


def pack(sequence: Column) -> Column:
    """Two bits a base, sixteen bases a word, the first base lowest; words are longs without a sign."""
    codes = F.filter(F.split(sequence, ""), lambda c: c != "")
    words = F.ceil(F.size(codes) / BASES_PER_WORD).cast("int")

    def word(w):
        part = F.transform(F.slice(codes, w * BASES_PER_WORD + 1, F.lit(BASES_PER_WORD)), lambda c, i: F.call_function("shiftleft", base_code(c), i * 2))
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return F.when(words > 0, F.transform(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), word)).otherwise(F.array().cast("array<bigint>"))


def packed_distance(a: Column, b: Column) -> Column:
    """Bases that differ between two packed sequences of one length."""
    low = F.lit(0x55555555).cast("long")

    def differing(x, y):
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(low))

    return F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)


def intermediate(a: Column, b: Column, step: Column, total: Column) -> Column:
    """``a`` with the first ``floor(differing * step / total)`` differing positions taken from ``b``."""
    x, y = F.split(a, ""), F.split(b, "")
    shared = F.least(F.char_length(a), F.char_length(b))
    places = F.filter(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, i: F.when((i < shared) & (p["x"] != p["y"]), i)), lambda i: i.isNotNull())
    n = F.floor(F.size(places) * step / total).cast("int")
    chosen = F.slice(places, F.lit(1), F.greatest(n, F.lit(0)))
    return F.array_join(F.transform(x, lambda c, i: F.when(F.array_contains(chosen, i), F.get(y, i)).otherwise(c)), "")


def quasi_medians(a: Column, b: Column, c: Column) -> Column:
    """The sorted sequences with the majority character at each position, or any of the three where all differ.

    Over the shortest of the three; of more than ``MEDIAN_CAP`` sequences the first ``MEDIAN_CAP + 1``, counted with the last
    position running fastest.
    """
    n = F.least(F.char_length(a), F.char_length(b), F.char_length(c))
    x, y, z = F.split(a, ""), F.split(b, ""), F.split(c, "")

    def choices(i):
        p, q, r = F.get(x, i), F.get(y, i), F.get(z, i)
        return F.when((p == q) | (p == r), F.array(p)).when(q == r, F.array(q)).otherwise(F.array(p, q, r))

    none = F.array().cast("array<array<string>>")
    each = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), choices)).otherwise(none)
    # every prefix has a continuation, so the first sequences only need the first prefixes
    grown = F.aggregate(
        each,
        F.array(F.lit("")),
        lambda acc, ch: F.slice(F.flatten(F.transform(acc, lambda s: F.transform(ch, lambda k: F.concat(s, k)))), 1, MEDIAN_CAP + 1),
    )
    return F.array_sort(F.array_distinct(grown))


def median_cost(a: Column, b: Column, c: Column, median: Column) -> Column:
    return char_distance(a, median) + char_distance(b, median) + char_distance(c, median)
