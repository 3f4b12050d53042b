"""Haplotypes: sample profiles, exact and approximate groups, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusflow.functions.genotype import allele_text, call_state, differing_states, hap_label


def sample_profiles(calls: DataFrame, impute: bool = False) -> DataFrame:
    """``sel_ord, sample_ord, sample, hap`` of the samples whose every call has a state.

    ``calls(sel_ord, variant_ord, sample_ord, sample, a1, a2)``. One shuffle by selector and sample; a group is the number
    of variants of one selector, and the states are sorted inside the aggregate.
    """
    states = calls.select("sel_ord", "sample_ord", "sample", "variant_ord", call_state(F.col("a1"), F.col("a2"), impute).alias("state"))
    grouped = states.groupBy("sel_ord", "sample_ord", "sample").agg(
        F.count("*").alias("n"), F.count("state").alias("called"), F.collect_list(F.struct("variant_ord", "state")).alias("x")
    )
    ordered = F.transform(F.array_sort("x"), lambda s: s["state"])
    return grouped.filter(F.col("n") == F.col("called")).select("sel_ord", "sample_ord", "sample", F.array_join(ordered, "|").alias("hap"))


def summarize(accessions: DataFrame) -> DataFrame:
    """``sel_ord, rank, label, hap, count``: largest count first, then by the haplotype's bytes."""
    counts = accessions.groupBy("sel_ord", "hap").agg(F.count("*").cast("int").alias("count"))
    rank = F.row_number().over(W.partitionBy("sel_ord").orderBy(F.desc("count"), "hap"))
    return counts.select("sel_ord", rank.alias("rank"), "hap", "count").select("sel_ord", "rank", hap_label(F.col("rank")).alias("label"), "hap", "count")


def approximate_groups(profiles: DataFrame, max_diff: float) -> DataFrame:
    """``sel_ord, sample_ord, sample, hap, leader``: greedy leader clustering in sample order.

    A profile joins the first leader from which at most ``max_diff`` of its sites differ, or becomes the next leader; ``hap`` is
    ``A001``, ``A002``, ... in the order in which leaders appear. Equal profiles meet the same leaders, so only distinct ones are
    folded: the order-dependent part is one array of distinct profiles per selector.
    """
    distinct = profiles.groupBy("sel_ord", "hap").agg(F.min("sample_ord").alias("first"))
    lists = distinct.groupBy("sel_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "hap"))), lambda x: F.split(x["hap"], "[|]")).alias("ps"))

    def near(leader, profile):
        return differing_states(leader, profile) / F.greatest(F.size(leader), F.size(profile)) <= F.lit(float(max_diff))

    none = F.slice("ps", 1, 0)
    leaders = F.aggregate("ps", none, lambda acc, x: F.when(F.exists(acc, lambda r: near(r, x)), acc).otherwise(F.concat(acc, F.array(x))))
    led = lists.select("sel_ord", leaders.alias("leaders"))
    places = distinct.join(led, "sel_ord").select("sel_ord", "hap", "leaders", F.split("hap", "[|]").alias("p"))
    index = F.array_position(F.transform("leaders", lambda r: near(r, F.col("p"))), F.lit(True)).cast("int")
    named = places.select(
        "sel_ord", "hap", hap_label(index, "A").alias("label"), F.array_join(F.get("leaders", index - 1), "|").alias("leader")
    )
    return profiles.join(named, ["sel_ord", "hap"]).select("sel_ord", "sample_ord", "sample", F.col("label").alias("hap"), "leader")


def sites(variants: DataFrame) -> DataFrame:
    """``sel_ord, variant_ord, chrom, pos, allele``."""
    return variants.select("sel_ord", "variant_ord", "chrom", "pos", allele_text(F.col("ref"), F.col("alt")).alias("allele"))


def counters(selectors: DataFrame, variants: DataFrame, samples: DataFrame, accessions: DataFrame) -> DataFrame:
    """``sel_ord, variant_count, sample_count, haplotype_count``: all selected variants and samples, kept haplotypes."""
    v = variants.groupBy("sel_ord").agg(F.count("*").cast("int").alias("v"))
    h = accessions.groupBy("sel_ord").agg(F.count_distinct("hap").cast("int").alias("h"))
    n = samples.agg(F.count("*").cast("int").alias("sample_count"))
    out = selectors.select("sel_ord").join(v, "sel_ord", "left").join(h, "sel_ord", "left").join(F.broadcast(n))  # n is one row
    return out.select("sel_ord", F.coalesce("v", F.lit(0)).alias("variant_count"), "sample_count", F.coalesce("h", F.lit(0)).alias("haplotype_count"))


def haplotype_samples(accessions: DataFrame) -> DataFrame:
    """``sel_ord, hap, samples``: the members of each haplotype in sample order, joined by semicolons."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("sample_ord", "sample"))), lambda x: x["sample"])
    return accessions.groupBy("sel_ord", "hap").agg(F.array_join(members, ";").alias("samples"))


def label_accessions(accessions: DataFrame, summary: DataFrame) -> DataFrame:
    """Accessions with their haplotype's label."""
    return accessions.join(summary.select("sel_ord", "hap", "label"), ["sel_ord", "hap"]).select("sel_ord", "sample_ord", "sample", "hap", "label")
