"""Variant calls from VCF text, and a Parquet layout that region queries can skip through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources.text import ordered_lines

FIXED_COLUMNS = 9


def header_samples(spark: SparkSession, path: str) -> list[str]:
    """The sample names of a VCF in header order."""
    first = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first()
    if first is None:
        raise ValueError(f"{path} has no line that names the samples")
    return first["value"].rstrip("\r").split("\t")[FIXED_COLUMNS:]


def genotype(cell: Column, gt_index: Column) -> Column:
    """``struct<a1, a2, phased>`` of a sample cell, or null: missing alleles or fewer than two. Two alleles are kept."""
    gt = F.get(F.split(cell, ":"), gt_index)
    parts = F.split(gt, "[/|]")
    a1, a2 = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return F.when(a1.isNotNull() & a2.isNotNull(), F.struct(a1.alias("a1"), a2.alias("a2"), F.contains(gt, F.lit("|")).alias("phased")))


def decode_variants(lines: DataFrame) -> DataFrame:
    """``variant_ord, chrom, pos, ref, alt, genotypes`` of ``lines(ord, value)``; headers are left out.

    A record without a GT field raises an error.
    """
    # Spark may test conditions that it infers before the filter, so the fields of other lines are null and not errors
    record = ~F.col("value").startswith("#") & (F.col("value") != "")
    rows = lines.select("ord", F.when(record, F.split(F.regexp_replace("value", "\r$", ""), "\t")).alias("f")).filter(F.col("f").isNotNull())
    at = F.array_position(F.split(F.get("f", 8), ":"), "GT")
    bad = F.raise_error(F.lit("a VCF record has no genotypes: its format lacks GT")).cast("int")
    rows = rows.withColumn("gt", F.when(at > 0, (at - 1).cast("int")).when(F.col("f").isNotNull(), bad))
    alt = F.get("f", 4)
    cells = F.slice("f", F.lit(FIXED_COLUMNS + 1), F.greatest(F.size("f") - FIXED_COLUMNS, F.lit(0)))
    # the place of GT is bound once for each record: inside the inner function Spark would find it, and split the line, for each cell
    genotypes = F.get(F.transform(F.array("gt"), lambda at: F.transform(cells, lambda c: genotype(c, at))), 0)
    return rows.select(
        F.col("ord").alias("variant_ord"),
        F.get("f", 0).alias("chrom"),
        F.get("f", 1).try_cast("int").alias("pos"),
        F.get("f", 3).alias("ref"),
        F.when(alt == ".", F.array().cast("array<string>")).otherwise(F.split(alt, ",")).alias("alt"),
        genotypes.alias("genotypes"),
    )


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return decode_variants(ordered_lines(spark, path))


def sample_frame(spark: SparkSession, header: list[str], wanted: list[str] | None = None) -> DataFrame:
    """``sample_ord, sample, column``: the wanted samples in their own order, all of the header without a list.

    Names may repeat; one that the header lacks raises an error.
    """
    at = {s: i for i, s in reversed(list(enumerate(header)))}
    names = header if wanted is None else wanted
    if unknown := [s for s in names if s not in at]:
        raise ValueError(f"the calls have no sample named {unknown[0]}")
    rows = [(i, s, i if wanted is None else at[s]) for i, s in enumerate(names)]
    return spark.createDataFrame(rows, "sample_ord int, sample string, column int")


def calls_of(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per variant and wanted sample. ``samples`` is a header's size, so it is Spark's to broadcast."""
    long = variants.select("variant_ord", "chrom", "pos", "ref", "alt", F.posexplode("genotypes").alias("column", "g"))
    return long.join(samples, "column").select(
        "variant_ord", "chrom", "pos", "ref", "alt", "sample_ord", "sample", F.col("g.a1").alias("a1"), F.col("g.a2").alias("a2")
    )


def read_samples(spark: SparkSession, path: str) -> list[str]:
    """A list of sample names, one a line; empty lines are skipped."""
    from locusflow.sources.text import numbered_lines

    rows = numbered_lines(spark, path).orderBy("line_no").select(F.regexp_replace("value", "\r", "").alias("s")).collect()
    return [r["s"] for r in rows if r["s"]]


def store_variants(variants: DataFrame, path: str) -> None:
    """Parquet by chromosome, sorted by position, with the ``last`` position of each record.

    ``view`` of what ``read_stored`` returns reads one folder and few row groups of a region.
    """
    last = F.col("pos") + F.greatest(F.char_length("ref"), F.lit(1)) - 1
    variants.withColumn("last", last.cast("int")).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "variant_ord").write.partitionBy("chrom").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_variants`` wrote."""
    return spark.read.parquet(path)


def fetch_counts(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """One row with the numbers of samples and variants."""
    return variants.agg(F.count("*").alias("variant_count")).crossJoin(samples.agg(F.count("*").alias("sample_count")))
