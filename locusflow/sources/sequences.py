"""Aligned sequences and pedigree genotypes from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PED_COLUMNS = 6


def decode_fasta(texts: DataFrame) -> DataFrame:
    """``id, name, sequence`` of FASTA ``texts(value)``, one text per file; ids from 0 in file order, gaps kept."""
    records = texts.select(F.posexplode(F.split(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")), "\n>")).alias("id", "r")).filter("id > 0")
    lines = F.split("r", "\n")
    return records.select(
        (F.col("id") - 1).alias("id"),
        F.regexp_extract(F.get(lines, 0), r"^\s*(\S*)", 1).alias("name"),
        F.upper(F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), F.trim), "")).alias("sequence"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return decode_fasta(spark.read.text(path, wholetext=True))


def as_haplotypes(sequences: DataFrame) -> DataFrame:
    """Distinct sequences as the haplotypes of one network, numbered by first appearance, with their names as samples."""
    from pyspark.sql import Window as W

    members = F.array_sort(F.collect_list(F.struct("id", "name")))
    per = sequences.groupBy("sequence").agg(F.min("id").alias("first"), members.alias("m"))
    place = F.row_number().over(W.orderBy("first")) - 1  # the haplotypes of one network
    return per.select(F.lit(0).cast("long").alias("net_id"), place.cast("int").alias("id"), "sequence", F.transform("m", lambda x: x["name"]).alias("samples"))


def decode_ped(lines: DataFrame) -> DataFrame:
    """``family, sample, site, allele1, allele2`` of pedigree ``lines(value)``; six leading columns, ``0`` is missing."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(f.alias("f"))
    pairs = F.floor((F.size("f") - PED_COLUMNS) / 2).cast("int")
    site = F.explode(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))))
    long = rows.filter(F.size("f") >= PED_COLUMNS + 2).withColumn("site", site)
    allele = lambda k: F.nullif(F.get("f", F.col("site") * 2 + PED_COLUMNS + k), F.lit("0"))
    return long.select(F.get("f", 0).alias("family"), F.get("f", 1).alias("sample"), "site", allele(0).alias("allele1"), allele(1).alias("allele2"))


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    return decode_ped(spark.read.text(path))
