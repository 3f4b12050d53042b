"""Haplotypes by population and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYMBOL_LIMITS = (0.3, 1.2)


def population_totals(populations: DataFrame) -> DataFrame:
    """``population, total`` over the whole population table, kept samples or not."""
    return populations.groupBy("population").agg(F.count("*").cast("int").alias("total"))


def population_counts(labelled: DataFrame, populations: DataFrame) -> DataFrame:
    """``sel_ord, label, population, n, total`` for every haplotype and population, zeros included.

    Samples without a population count nowhere here.
    """
    totals = population_totals(populations)
    n = labelled.join(populations, "sample").groupBy("sel_ord", "label", "population").agg(F.count("*").cast("int").alias("n"))
    every = labelled.select("sel_ord", "label").distinct().join(totals)  # haplotypes times populations is the table asked for
    return every.join(n, ["sel_ord", "label", "population"], "left").select("sel_ord", "label", "population", F.coalesce("n", F.lit(0)).alias("n"), "total")


def population_table(labelled: DataFrame, populations: DataFrame, names: list[str]) -> DataFrame:
    """One row per haplotype with a count column per population in ``names``."""
    joined = labelled.join(populations, "sample", "left")
    return joined.groupBy("sel_ord", "label").pivot("population", names).agg(F.count("sample").cast("int")).na.fill(0, names)


def network_populations(labelled: DataFrame, populations: DataFrame) -> DataFrame:
    """``sel_ord, label, population, n`` in the populations that exist; samples without one vanish."""
    joined = labelled.join(populations, "sample", "left").withColumn("population", F.coalesce("population", F.lit("Unknown")))
    known = joined.join(populations.select("population").distinct(), "population", "left_semi")
    return known.groupBy("sel_ord", "label", "population").agg(F.count("*").cast("int").alias("n"))


def place_counts(labelled: DataFrame, geo: DataFrame) -> DataFrame:
    """``sel_ord, lon, lat, label, n``: kept samples by rounded coordinates, zero where a haplotype is absent."""
    joined = labelled.join(geo, "sample").withColumn("lon", F.round("lon", 2)).withColumn("lat", F.round("lat", 2))
    n = joined.groupBy("sel_ord", "lon", "lat", "label").agg(F.count("*").cast("int").alias("n"))
    places = n.select("sel_ord", "lon", "lat").distinct()
    every = places.join(labelled.select("sel_ord", "label").distinct(), "sel_ord")
    return every.join(n, ["sel_ord", "lon", "lat", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def extents(places: DataFrame) -> DataFrame:
    """Per selector the limits of a map: 12 % of the span, 2 degrees at least, around it; the span is 10 without a spread."""
    per = places.groupBy("sel_ord").agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    for axis in ("lon", "lat"):
        span = F.when(F.col(f"{axis}1") > F.col(f"{axis}0"), F.col(f"{axis}1") - F.col(f"{axis}0")).otherwise(F.lit(10.0))
        per = per.withColumn(f"{axis}_span", span)
        pad = F.greatest(F.col(f"{axis}_span") * 0.12, F.lit(2.0))
        per = per.withColumn(f"{axis}_min", F.col(f"{axis}0") - pad).withColumn(f"{axis}_max", F.col(f"{axis}1") + pad)
    return per.select("sel_ord", "lon_min", "lon_max", "lat_min", "lat_max", "lon_span", "lat_span")


def pie_wedges(counts: DataFrame, keys: list[str], order: str, n: str = "n", start: float = 90.0) -> DataFrame:
    """Wedges of one pie per ``keys``: ``start_angle`` and ``end_angle`` in degrees, slices in ``order``; empty ones go."""
    pie = W.partitionBy(*keys)
    span = 360 * F.col(n) / F.sum(n).over(pie)
    before = F.sum("_span").over(pie.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = counts.filter(F.col(n) > 0).withColumn("_span", span).withColumn("start_angle", F.lit(start) + F.coalesce(before, F.lit(0.0)))
    return out.withColumn("end_angle", F.col("start_angle") + F.col("_span")).drop("_span")


def symbol_radii(places: DataFrame, limits: tuple[float, float] = SYMBOL_LIMITS) -> DataFrame:
    """``sel_ord, lon, lat, total, radius``: the root of the total between the limits, times 4 % of the shorter span."""
    low, high = limits
    t = places.groupBy("sel_ord", "lon", "lat").agg(F.sum("n").cast("int").alias("total")).filter("total > 0")
    root = F.sqrt("total")
    ends = t.groupBy("sel_ord").agg(F.min(root).alias("lo"), F.max(root).alias("hi"))
    size = extents(places).select("sel_ord", (F.least("lon_span", "lat_span") * 0.04).alias("base"))
    share = (root - F.col("lo")) / (F.col("hi") - F.col("lo"))
    r = F.when(F.col("hi") > F.col("lo"), share * (high - low) + low).otherwise((low + high) / 2)
    return t.join(ends, "sel_ord").join(size, "sel_ord").select("sel_ord", "lon", "lat", "total", (r * F.col("base")).alias("radius"))


def size_breaks(totals: DataFrame, value: str = "total") -> DataFrame:
    """``sel_ord, breaks``: the totals if there are one or two, else the smallest, the rounded middle and the largest."""
    per = totals.groupBy("sel_ord").agg(F.count_distinct(value).alias("k"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    middle = F.bround((F.col("lo") + F.col("hi")) / 2).cast("int")
    breaks = F.when(F.col("k") == 1, F.array("lo")).when(F.col("k") == 2, F.array("lo", "hi")).otherwise(F.array(F.col("lo"), middle, F.col("hi")))
    return per.select("sel_ord", breaks.alias("breaks"))


def share_text(n: Column, total: Column) -> Column:
    return F.concat_ws("/", n.cast("string"), total.cast("string"))
