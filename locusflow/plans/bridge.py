"""Genotype-shaped frames over plain tables, by fixed rules, for the registered queries.

Samples are embedding vectors and sites their dimensions; genes and features come from ``part``, selectors from ``nation``
and ``customer``, populations and places from ``customer``. ``lineitem`` gives a larger set of calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import calls as calls_
from locusflow.plans.view import HapView

SITES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession) -> DataFrame:
    base = lambda shift: F.substr(F.lit("ACGT"), (F.col("pos") + shift) % 4 + 1, F.lit(1))
    second = F.when(F.col("pos") % 5 == 0, "AA").otherwise(base(2))
    return spark.range(1, SITES + 1).select(
        F.col("id").alias("variant_ord"),
        F.lit("chr1").alias("chrom"),
        F.col("id").cast("int").alias("pos"),
    ).withColumn("ref", F.when(F.col("pos") % 7 == 0, "GCCTA").otherwise(base(0))).withColumn("alt", F.array(base(1), second))


def calls(spark: SparkSession, sf_dir: str, last: int = SITES) -> DataFrame:
    """``sample_ord, sample, pos, a1, a2`` of sites 1 to ``last``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, last)).alias("i", "v"))
    x = F.col("v").cast("double")
    allele = lambda edge: F.when(F.abs(x) < 0.01, F.lit(None)).when(x < -0.15, 2).when(x < edge, 0).otherwise(1).cast("int")
    return e.select(
        F.col("vec_id").alias("sample_ord"),
        F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("sample"),
        (F.col("i") + 1).alias("pos"),
        allele(0.0).alias("a1"),
        allele(0.02).alias("a2"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_ord"), F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("sample"))


def region(spark: SparkSession, start: int, end: int) -> DataFrame:
    kind = "site" if start == end else "region"
    return spark.createDataFrame([(0, kind, None, "chr1", start, end)], "sel_ord int, type string, record_id string, chrom string, start int, end int")


def nation_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of three sites per nation, as BED records."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("int").alias("sel_ord"),
        F.lit("bed-record").alias("type"),
        F.concat(F.lit("row"), (F.col("n_nationkey") + 1).cast("string")).alias("record_id"),
        F.lit("chr1").alias("chrom"),
        (F.col("n_nationkey") * 2 + 1).cast("int").alias("start"),
        (F.col("n_nationkey") * 2 + 3).cast("int").alias("end"),
    )


def view_of(spark: SparkSession, sf_dir: str, selectors: DataFrame, last: int = SITES, **options) -> HapView:
    chosen = calls_.select_variants(variants(spark), selectors, "pos")
    cells = calls(spark, sf_dir, last).join(chosen.select("sel_ord", "variant_ord", "pos"), "pos")
    wanted = options.pop("samples", None)
    everyone = samples(spark, sf_dir)
    if wanted is not None:
        cells, everyone = calls_.subset_samples(cells, wanted), wanted
    return HapView(selectors, everyone, chosen, cells, **options)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_ord, seqid, type, start, end, strand, id`` of the parts."""
    p = table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 10
    kind = F.expr("element_at(array('gene', 'exon', 'CDS', 'five_prime_UTR', 'three_prime_UTR', 'gene', 'exon'), cast(p_partkey % 7 + 1 as int))")
    return p.select(
        F.col("p_partkey").alias("file_ord"),
        F.lit("chr1").alias("seqid"),
        kind.alias("type"),
        start.alias("start"),
        (start + F.col("p_size")).alias("end"),
        F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("id"),
    )


def gene_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short region per customer; every hundredth lies on a chromosome without genes."""
    c = table(spark, sf_dir, "customer")
    start = (F.col("c_custkey") * 37) % 2500
    return c.select(
        F.col("c_custkey").alias("sel_ord"),
        F.when(F.col("c_custkey") % 100 == 0, "chr2").otherwise("chr1").alias("chrom"),
        start.alias("start"),
        (start + F.col("c_custkey") % 5).alias("end"),
    )


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment of the customer with the sample's number; every seventh sample has none."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 7 != 0)
    return c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sample"), F.col("c_mktsegment").alias("population"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sample"),
        (F.col("c_nationkey") * 3 + 100.25).alias("lon"),
        (F.col("c_nationkey") % 5 * 2 + 20.5).alias("lat"),
    )


def lineitem_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as samples, three classes of parts as sites; the first row of a cell by order decides its call."""
    li = table(spark, sf_dir, "lineitem")
    first = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    cell = li.groupBy("l_suppkey", (F.col("l_partkey") % 3).alias("pos")).agg(
        F.min(F.struct(first.alias("k"), F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))).alias("x")
    )
    a1 = F.expr("case x.f when 'A' then 0 when 'N' then 1 else 2 end")
    return cell.select(
        F.lit(0).alias("sel_ord"),
        F.col("pos").alias("variant_ord"),
        F.col("l_suppkey").alias("sample_ord"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("sample"),
        a1.alias("a1"),
        F.when(F.col("x.n") == 7, (a1 + 1) % 3).otherwise(a1).alias("a2"),
    )
