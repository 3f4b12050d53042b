"""Genotype calls, alleles and haplotype strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_SEPARATOR = "|"


def call_state(a1: Column, a2: Column, impute: bool = False) -> Column:
    """``a/a`` of a homozygous call, else null; a missing call is ``0/0`` with ``impute``. Heterozygous is always null."""
    missing = a1.isNull() | a2.isNull() | (a1 < 0) | (a2 < 0)
    filled = F.lit("0/0") if impute else F.lit(None).cast("string")
    return F.when(missing, filled).when(a1 == a2, F.concat_ws("/", a1.cast("string"), a2.cast("string")))


def allele_text(ref: Column, alt: Column) -> Column:
    """``REF/ALT1,ALT2``; nothing follows the slash without alternatives."""
    return F.concat(ref, F.lit("/"), F.concat_ws(",", alt))


def state_label(state: Column, allele: Column) -> Column:
    """The base text of a state: the allele that its first index names, or the state itself if there is none."""
    cut = F.instr(allele, "/")
    ref = F.when(cut > 0, F.substring(allele, F.lit(1), cut - 1)).otherwise(allele)
    rest = F.when(cut > 0, F.substr(allele, cut + 1)).otherwise(F.lit(""))
    alts = F.filter(F.split(rest, ","), lambda x: x != "")
    index = F.substring_index(state, "/", 1).try_cast("int")
    return (
        F.when(F.instr(state, "/") == 0, state)
        .when(index == 0, ref)
        .otherwise(F.coalesce(F.when(index > 0, F.get(alts, index - 1)), state))
    )


def hap_cells(hap: Column, alleles: Column, exact: bool = True) -> Column:
    """The display cells of a haplotype: a base text per site, or its label alone for approximate groups."""
    if not exact:
        return F.array(hap)
    states = F.split(hap, "[|]")
    return F.transform(states, lambda s, i: F.coalesce(state_label(s, F.get(alleles, i)), s))


def hap_label(rank: Column, letter: str = "H") -> Column:
    return F.format_string(f"{letter}%03d", rank)


def differing_states(left: Column, right: Column) -> Column:
    """Positions at which two state arrays differ, over the shorter one."""
    both = F.arrays_zip(left.alias("l"), right.alias("r"))
    n = F.least(F.size(left), F.size(right))
    return F.size(F.filter(F.slice(both, F.lit(1), n), lambda x: x["l"] != x["r"]))


def annotation_text(mode: Column, gene_id: Column, distance: Column) -> Column:
    """``id`` for an overlap, ``id:distance`` for the nearest, ``NA`` otherwise."""
    return (
        F.when(mode == "overlap", F.coalesce(gene_id, F.lit("NA")))
        .when(mode == "nearest", F.concat(F.coalesce(gene_id, F.lit("NA")), F.lit(":"), F.coalesce(distance.cast("string"), F.lit("NA"))))
        .otherwise(F.lit("NA"))
    )


def info_cells(n_sites: Column, annotated: Column, text: Column) -> Column:
    """A dot per site; the first cell holds the annotation where there is one."""
    dots = F.array_repeat(F.lit("."), n_sites.cast("int"))
    return F.when(annotated & (n_sites > 0), F.concat(F.array(text), F.slice(dots, F.lit(2), F.greatest(n_sites.cast("int") - 1, F.lit(0))))).otherwise(dots)


def slug(chrom: Column, start: Column, end: Column) -> Column:
    """The file-name part of a region: letters, digits, ``_``, ``-`` and ``.`` stay, others become ``_``."""
    return F.regexp_replace(F.concat_ws("_", chrom, start.cast("string"), end.cast("string")), r"[^\p{L}\p{N}_.\-]", "_")
