"""Haplotype counts that follow a stream of sample rows.

A sample arrives as one row with all calls of the region, as a sequencing run delivers it; its profile needs no other
row, so the only state is one count per haplotype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.genotype import call_state

ROW_SCHEMA = "sample string, calls array<struct<variant_ord:long,a1:int,a2:int>>"


def profiles(rows: DataFrame, impute: bool = False) -> DataFrame:
    """``sample, hap`` of the rows whose every call has a state; rows without calls are dropped."""
    states = F.transform(F.array_sort("calls"), lambda c: call_state(c["a1"], c["a2"], impute))
    kept = rows.select("sample", states.alias("states")).filter((F.size("states") > 0) & ~F.exists("states", lambda s: s.isNull()))
    return kept.select("sample", F.array_join("states", "|").alias("hap"))


def haplotype_counts(rows: DataFrame, impute: bool = False) -> DataFrame:
    """``hap, count``; for a stream, write it in ``complete`` or ``update`` mode."""
    return profiles(rows, impute).groupBy("hap").agg(F.count("*").cast("int").alias("count"))
