"""Selectors: regions, sites and BED records as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sel_ord int, type string, record_id string, chrom string, start int, end int"


def parse_region(text: str) -> dict:
    """``chrom:start-end`` or ``chrom:pos``, split at the first colon; digits only. Start may exceed end."""
    chrom, colon, coords = text.partition(":")
    if not colon or not chrom or not coords:
        raise ValueError(f"not a place on a chromosome: {text!r}; write CHROM:START-END or CHROM:POS")
    start, dash, end = coords.partition("-")
    if not all(x.isascii() and x.isdigit() for x in ([start, end] if dash else [start])):
        raise ValueError(f"positions are written in digits only, not {coords!r}")
    kind = "region" if dash else "site"
    return {"type": kind, "record_id": None, "chrom": chrom, "start": int(start), "end": int(end) if dash else int(start)}


def from_regions(spark: SparkSession, regions: list[str]) -> DataFrame:
    rows = [(i, *parse_region(r).values()) for i, r in enumerate(regions)]
    return spark.createDataFrame(rows, SCHEMA)


def parse_bed_lines(lines: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Selectors of ``lines(line_no, value)``, numbered by line from 1.

    Three tab-separated columns at least; the fourth names the record, ``row<line>`` if it is missing or empty. With
    ``skip_blank`` lines of white space go, otherwise only empty ones; other short lines and headers raise an error.
    """
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == "" if skip_blank else F.rtrim(F.col("value"), F.lit("\r")) == ""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    bad = F.raise_error(F.lit("a BED line lacks its chromosome, start or end"))
    rows = lines.filter(~blank).select(F.col("line_no"), F.when(F.size(f) < 3, bad.cast("array<string>")).otherwise(f).alias("f"))
    name = F.get("f", 3)
    return rows.select(
        F.col("line_no").cast("int").alias("sel_ord"),
        F.lit("bed-record").alias("type"),
        F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.concat(F.lit("row"), F.col("line_no").cast("string"))).alias("record_id"),
        F.get("f", 0).alias("chrom"),
        F.get("f", 1).cast("int").alias("start"),
        F.get("f", 2).cast("int").alias("end"),
    )


def read_bed(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    from locusflow.sources.text import numbered_lines

    return parse_bed_lines(numbered_lines(spark, path), skip_blank)


def validate(region: str | None, regions_file: str | None, by: str = "auto", max_diff: float | None = None) -> str:
    """The grouping unit that the arguments ask for; raises on contradictions."""
    if bool(region) == bool(regions_file):
        raise ValueError("name either a region or a file of regions")
    if max_diff is not None and not 0 <= max_diff <= 1:
        raise ValueError(f"the share of differing sites lies between 0 and 1, not at {max_diff}")
    if regions_file:
        if by == "site":
            raise ValueError("a file of regions cannot be grouped by site")
        return "region"
    kind = parse_region(region)["type"]
    if by not in ("auto", kind):
        raise ValueError(f"a {kind} was given, so it cannot be grouped by {by}")
    return kind
