"""Genes of regions and functional categories of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusflow.operators.calls import BIN


def _bins(start: str, end: str, size: int):
    return F.explode(F.sequence(F.expr(f"cast({start} as bigint) div {size}"), F.expr(f"cast({end} as bigint) div {size}")))


def annotate_regions(regions: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """``sel_ord, mode, id, seqid, start, end, strand, distance`` for ``regions(sel_ord, chrom, start, end)``.

    ``overlap``: the first gene, by start and then file order, that touches the region; else ``nearest``: the gene with the
    smallest gap, the first such; ``none`` on a chromosome without genes. Overlaps are found by a binned equi-join. For the
    rest, running extremes over genes and regions in order of position give the neighbours on both sides, so
    no region meets all genes of its chromosome.
    """
    r = regions.select("sel_ord", "chrom", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    g = genes.select("seqid", "id", "strand", "file_ord", F.col("start").cast("long").alias("gs"), F.col("end").cast("long").alias("ge"))
    g = g.filter(F.col("gs") <= F.col("ge"))
    gene = F.struct("gs", "file_ord", "ge", "id", "strand")
    binned = r.filter(F.col("s") <= F.col("e")).withColumn("_bin", _bins("s", "e", bin_size))
    gene_bins = g.withColumn("_gbin", _bins("gs", "ge", bin_size))
    hit = binned.join(
        gene_bins, (F.col("chrom") == F.col("seqid")) & (F.col("_bin") == F.col("_gbin")) & (F.col("gs") <= F.col("e")) & (F.col("ge") >= F.col("s"))
    )
    overlap = hit.groupBy("sel_ord").agg(F.min(gene).alias("o"))
    rest = r.join(overlap, "sel_ord", "left_anti")
    # a gene before a region that it does not touch starts before it; the one that ends last is nearest
    none = F.lit(None)
    points = g.select(
        F.col("seqid").alias("chrom"), F.col("gs").alias("at"), F.lit(1).alias("kind"), none.cast("long").alias("sel_ord"), none.cast("long").alias("s"), none.cast("long").alias("e"),
        F.struct("ge", (-F.col("gs")).alias("ns"), (-F.col("file_ord")).alias("no"), "id", "strand").alias("before"),
        gene.alias("after"),
    ).unionByName(rest.select("chrom", F.col("s").alias("at"), F.lit(0).alias("kind"), F.col("sel_ord").cast("long"), "s", "e"), allowMissingColumns=True)
    up = W.partitionBy("chrom").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("chrom").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = points.withColumn("b", F.max("before").over(up)).withColumn("a", F.min("after").over(down)).filter("kind = 0")
    gap_b, gap_a = F.col("s") - F.col("b.ge"), F.col("a.gs") - F.col("e")
    left = F.struct(gap_b.alias("distance"), (-F.col("b.ns")).alias("gs"), (-F.col("b.no")).alias("fo"), F.col("b.ge").alias("ge"), F.col("b.id").alias("id"), F.col("b.strand").alias("strand"))
    right = F.struct(gap_a.alias("distance"), F.col("a.gs").alias("gs"), F.col("a.file_ord").alias("fo"), F.col("a.ge").alias("ge"), F.col("a.id").alias("id"), F.col("a.strand").alias("strand"))
    best = F.least(F.when(F.col("b").isNotNull(), left), F.when(F.col("a").isNotNull(), right))
    nearest = near.select(F.col("sel_ord").alias("_sel"), best.alias("n"))
    joined = r.join(overlap, "sel_ord", "left").join(nearest, F.col("sel_ord") == F.col("_sel"), "left")
    mode = F.when(F.col("o").isNotNull(), "overlap").when(F.col("n").isNotNull(), "nearest").otherwise("none")
    pick = lambda o, n: F.coalesce(F.col(f"o.{o}"), F.col(f"n.{n}"))
    return joined.select(
        "sel_ord", mode.alias("mode"), pick("id", "id").alias("id"),
        F.when(mode != "none", F.col("chrom")).alias("seqid"),
        pick("gs", "gs").alias("start"), pick("ge", "ge").alias("end"), pick("strand", "strand").alias("strand"), F.col("n.distance").alias("distance"),
    )


def classify_positions(positions: DataFrame, features: DataFrame, bin_size: int = BIN) -> DataFrame:
    """``positions`` with ``category``: the most specific feature that covers ``chrom, pos``.

    CDS, then 5' and 3' UTR, then exon (inside a gene only), intron inside a gene, and intergenic.
    """
    keys = positions.select("chrom", "pos").distinct()
    # Ranks of feature types.
    rank = F.expr(
        "case type when 'CDS' then 1 when 'five_prime_UTR' then 2 when '3primeUTR' then 3 when 'three_prime_UTR' then 3 when 'exon' then 4 when 'gene' then 5 end"
    )
    f = features.withColumn("rank", rank).filter(F.col("rank").isNotNull() & (F.col("start") <= F.col("end"))).select("seqid", "rank", F.col("start").alias("fs"), F.col("end").alias("fe"))
    f = f.withColumn("_bin", _bins("fs", "fe", bin_size))
    p = keys.withColumn("_pbin", F.expr(f"cast(pos as bigint) div {bin_size}"))
    hits = p.join(f, (F.col("chrom") == F.col("seqid")) & (F.col("_pbin") == F.col("_bin")) & F.col("pos").between(F.col("fs"), F.col("fe")))
    found = hits.groupBy("chrom", "pos").agg(F.min("rank").alias("best"), F.bool_or(F.col("rank") == 5).alias("gene"))
    category = (
        F.when(F.col("best") == 1, "CDS")
        .when(F.col("best") == 2, "5'UTR")
        .when(F.col("best") == 3, "3'UTR")
        .when(F.col("gene") & (F.col("best") == 4), "exon")
        .when(F.col("gene"), "intron")
        .otherwise("intergenic")
    )
    return positions.join(found, ["chrom", "pos"], "left").select(*positions.columns, category.alias("category"))


def longest_isoforms(transcripts: DataFrame) -> DataFrame:
    """The longest transcript of each gene; the first in file order of equally long ones. Needs a ``parent`` column."""
    order = F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("file_ord")).alias("o"))
    whole = F.struct(*transcripts.columns)
    return transcripts.groupBy("parent").agg(F.max_by(whole, order).alias("t")).select("t.*")
