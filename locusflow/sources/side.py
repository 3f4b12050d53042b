"""Side tables: annotation, populations, geography, base maps and network input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.sources.text import ordered_lines

FEATURE_SCHEMA = "file_ord long, seqid string, type string, start long, end long, strand string, id string"


def decode_features(lines: DataFrame) -> DataFrame:
    """Features of GFF ``lines(ord, value)`` with nine columns and whole-number bounds; all others are skipped."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select("ord", f.alias("f")).filter(F.size("f") >= 9)
    rows = rows.select(
        F.col("ord").alias("file_ord"),
        F.get("f", 0).alias("seqid"),
        F.get("f", 2).alias("type"),
        F.get("f", 3).try_cast("long").alias("start"),
        F.get("f", 4).try_cast("long").alias("end"),
        F.substring(F.get("f", 6), 1, 1).alias("strand"),
        F.nullif(F.regexp_extract(F.get("f", 8), r"(?:^|;)\s*ID=([^;]*)", 1), F.lit("")).alias("id"),
    )
    return rows.filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return decode_features(ordered_lines(spark, path))


def genes_of(features: DataFrame) -> DataFrame:
    """The features of type gene that have an id."""
    return features.filter((F.col("type") == "gene") & F.col("id").isNotNull())


def filter_features(features: DataFrame, seqid: str | None = None, start: int | None = None, end: int | None = None, types: list[str] | None = None) -> DataFrame:
    """Features of a type that touch a region; every limit is optional."""
    keep = F.lit(True)
    for test in (
        seqid is not None and (F.col("seqid") == seqid),
        start is not None and (F.col("end") >= start),
        end is not None and (F.col("start") <= end),
        types is not None and F.col("type").isin(types or []),
    ):
        keep = keep & test if test is not False else keep
    return features.filter(keep)


def features_as_bed(features: DataFrame) -> DataFrame:
    """BED6 rows: the start is one less."""
    return features.select(
        F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", F.coalesce("id", F.lit(".")).alias("name"), F.lit(".").alias("score"), "strand"
    )


def decode_populations(lines: DataFrame) -> DataFrame:
    """``sample, population`` of tab-separated ``lines(ord, value)``; of repeated samples the last counts."""
    f = F.split("value", "\t")
    rows = lines.select("ord", F.trim(F.get(f, 0)).alias("sample"), F.trim(F.regexp_replace(F.get(f, 1), "\r$", "")).alias("population"))
    rows = rows.filter((F.col("sample") != "") & F.col("population").isNotNull())
    return rows.groupBy("sample").agg(F.max_by("population", "ord").alias("population"))


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    return decode_populations(ordered_lines(spark, path))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, cells`` of a written summary table: its header lines and one line for each haplotype."""
    from locusflow.sources.text import numbered_lines

    return numbered_lines(spark, path).select("line_no", F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("cells"))


def read_geo(spark: SparkSession, path: str) -> DataFrame:
    """``sample, lon, lat`` of a tab-separated file with header; a missing coordinate column is 0."""
    df = spark.read.csv(path, sep="\t", header=True)
    col = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
    if "ID" not in df.columns:
        return spark.createDataFrame([], "sample string, lon double, lat double")
    return df.select(F.trim("ID").alias("sample"), col("longitude").alias("lon"), col("latitude").alias("lat"))


def decode_rings(texts: DataFrame) -> DataFrame:
    """``feature, ring, points`` of GeoJSON ``texts(value)``; rings of fewer than three points are dropped."""
    position = "array<double>"
    any_geometry = "array<struct<geometry:struct<type:string,coordinates:string>>>"
    rows = texts.select(F.from_json("value", f"struct<features:{any_geometry}>").alias("j")).select(F.posexplode("j.features").alias("feature", "x"))
    kind, text = F.col("x.geometry.type"), F.col("x.geometry.coordinates")
    rings = (
        F.when(kind.isin("Polygon", "MultiLineString"), F.from_json(text, f"array<array<{position}>>"))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<array<{position}>>>")))
        .when(kind == "LineString", F.array(F.from_json(text, f"array<{position}>")))
    )
    out = rows.select("feature", F.posexplode(rings).alias("ring", "points"))
    return out.filter(F.size("points") >= 3)


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    return decode_rings(spark.read.text(path, wholetext=True))


def decode_network_input(texts: DataFrame) -> DataFrame:
    """``sequences, samples, epsilon`` of JSON ``texts(value)``; what cannot be read is empty, epsilon 0."""
    kind = "struct<sequences:array<string>,samples:array<array<string>>,epsilon:string>"
    j = texts.select(F.from_json("value", kind).alias("j"))
    none = F.array().cast("array<string>")
    return j.select(
        F.coalesce("j.sequences", none).alias("sequences"),
        F.coalesce("j.samples", F.array().cast("array<array<string>>")).alias("samples"),
        F.coalesce(F.col("j.epsilon").try_cast("int"), F.lit(0)).alias("epsilon"),
    )
