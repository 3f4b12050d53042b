"""Text lines with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ord, value``: lines with an increasing, not gapless, number in file order. Compressed files are read whole."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` from 1. For side tables: numbering orders the lines in one task."""
    lines = ordered_lines(spark, path)
    return lines.select(F.row_number().over(W.orderBy("ord")).alias("line_no"), "value")
