"""Which variants a selector sees, and the calls that go into its haplotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the bins that turn the interval join into an equi-join.
BIN = 16_384


def select_variants(variants: DataFrame, selectors: DataFrame, overlap: str = "record", bin_size: int = BIN) -> DataFrame:
    """``variants`` with the ``sel_ord`` of every selector that they fall into.

    ``record``: the reference allele's span touches the selector; ``pos``: the position lies in it. Both sides are cut into
    bins and joined by chromosome and bin, so that Spark may broadcast the selectors or shuffle both; a pair is kept in the
    first bin that the two share.
    """
    last = F.col("pos") + F.greatest(F.char_length("ref"), F.lit(1)) - 1 if overlap == "record" else F.col("pos")
    v = variants.withColumn("_last", last).withColumn(
        "_bin", F.explode(F.sequence(F.expr(f"pos div {bin_size}"), F.expr(f"greatest(_last, pos) div {bin_size}")))
    )
    s = (
        selectors.filter(F.col("start") <= F.col("end"))
        .select("sel_ord", F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end"))
        .withColumn("_bin", F.explode(F.sequence(F.expr(f"_start div {bin_size}"), F.expr(f"_end div {bin_size}"))))
    )
    touches = (F.col("pos") <= F.col("_end")) & (F.col("_last") >= F.col("_start"))
    first = F.greatest(F.expr(f"pos div {bin_size}"), F.expr(f"_start div {bin_size}")) == v["_bin"]
    joined = v.join(s, (v["chrom"] == s["_chrom"]) & (v["_bin"] == s["_bin"]) & touches & first)
    return joined.select("sel_ord", *variants.columns)


def prune(variants: DataFrame, selectors: DataFrame, overlap: str = "record", most: int = 1000) -> DataFrame:
    """``variants`` within the outer bounds of the selectors on each chromosome, as a filter of plain numbers.

    The scan can skip by it, and text records are dropped before their genotypes are decoded. The bounds are one row
    a chromosome; with more than ``most`` chromosomes only the join selects. ``last`` is used where ``variants`` has it.
    """
    real = selectors.filter(F.col("start") <= F.col("end"))
    rows = real.groupBy("chrom").agg(F.min("start").alias("low"), F.max("end").alias("high")).limit(most + 1).collect()
    if len(rows) > most:
        return variants
    if overlap == "pos":
        ends_after = lambda low: F.col("pos") >= low
    elif "last" in variants.columns:
        ends_after = lambda low: F.col("last") >= low
    else:
        ends_after = lambda low: F.col("pos") + F.greatest(F.char_length("ref"), F.lit(1)) - 1 >= low
    within = F.lit(False)
    for r in sorted(rows):
        within = within | ((F.col("chrom") == r["chrom"]) & (F.col("pos") <= r["high"]) & ends_after(r["low"]))
    return variants.filter(within)


def subset_samples(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls of the listed samples, numbered in list order; ``samples(sample, sample_ord)``."""
    return calls.drop("sample_ord").join(samples.select("sample", "sample_ord"), "sample").select(calls.columns)


def unknown_samples(samples: DataFrame, header: DataFrame) -> DataFrame:
    """Listed samples that the header lacks."""
    return samples.join(header, "sample", "left_anti")
