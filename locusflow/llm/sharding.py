"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Every source is shuffled with a seed and its rows are ranked; row ``r`` of ``n`` gets the fractional rank
``(r - 1/2) / n``. All rows are sorted by it and cut into equal runs, so that each shard holds every
source in the proportion in which the whole table holds it.

Neither ranking uses one window over a source or over the table. Hash buckets (about the square root of
the row count) split each source into slices of similar size; the slices are numbered on their own and
shifted by the counts of the slices before them. A source with a third of all rows is therefore spread
over as many tasks as there are buckets, and what is summed in one place is bucket counts only. Rows that
share their hash (repeated or missing ids) and are many are hashed again by their place in the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusflow.llm._common import fresh, materialize, table

_HASH_BITS = 52


def _numbered(df: DataFrame, group: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the 1-based position of a row in its group, ordered by ``bucket`` and then ``order``."""
    counts = df.groupBy(*group, bucket).agg(F.count("*").alias("_c"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = df.withColumn("_in", F.row_number().over(W.partitionBy(*group, bucket).orderBy(*order)).cast("long"))
    # both sides are hash-partitioned by the same keys, so the numbered rows are not shuffled again
    joined = within.join(offsets, [*group, bucket])
    return joined.withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def shard_assignments(
    docs: DataFrame,
    n_shards: int = 24,
    seed: str = "shard-0",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, text_crc32, rank, shard, slot`` and the ``extra`` columns of ``docs``.

    ``shard`` counts differ by at most one row; ``slot`` numbers a shard's rows from 0 without gaps in
    interleaved order. A null source is a stratum of its own; a null text has size 8 and checksum 0; a
    null id is shuffled like any other value. Repeated rows each get a place of their own. An empty table
    gives an empty result. Other columns of ``docs`` play no part, whatever their names.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)],
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_s"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, _HASH_BITS // 4), 16, 10)
        .cast("long")
        .alias("_h"),
    )
    n = docs.select(id_col).count()
    many = F.broadcast(rows.groupBy("_h").count().filter(F.col("count") * 1000 > F.greatest(F.lit(n), F.lit(1000))).select("_h", F.lit(True).alias("_many")))
    again = F.conv(F.substring(F.md5(F.concat_ws(":", "_h", F.monotonically_increasing_id().cast("string"))), 1, _HASH_BITS // 4), 16, 10).cast("long")
    rows = rows.join(many, "_h", "left").withColumn("_h", F.when(F.col("_many"), again).otherwise(F.col("_h"))).drop("_many")
    buckets = max(16, math.ceil(2 * math.sqrt(n)))
    rows = rows.withColumn("_b", F.floor(F.col("_h") / float(2**_HASH_BITS) * buckets))
    order = [F.col(c) for c in ("_h", "doc_id", "text_crc32", "size")]
    ranked = _numbered(rows, ["_s"], "_b", order, "rank").drop("_b", "_h")
    sizes = ranked_sizes(docs, source_col)
    if sizes.limit(100_001).count() <= 100_000:
        sizes = F.broadcast(sizes)
    ranked = ranked.join(sizes, "_s").withColumn("_f", (F.col("rank") - 0.5) / F.col("_n"))
    ranked = ranked.withColumn("_b", F.floor(F.col("_f") * buckets)).withColumn("_all", F.lit(0))
    order = [F.col(c) for c in ("_f", "_s", "rank")]
    placed = _numbered(ranked, ["_all"], "_b", order, "_pos")
    k = F.lit(n_shards).cast("long")
    pos = F.col("_pos") - 1
    shard = F.expr(f"(_pos - 1) * {n_shards}L div {max(n, 1)}L")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", pos - first)
        .select(
            "doc_id", "source", "size", "text_crc32", "rank", F.least(F.col("shard"), k - 1).cast("int").alias("shard"), "slot",
            *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)],
        )
    )


def ranked_sizes(docs: DataFrame, source_col: str) -> DataFrame:
    """Rows per source, one row for each."""
    s = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_s")
    return docs.select(s).groupBy("_s").agg(F.count("*").alias("_n"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, **options) -> str:
    """Write one folder per shard with the whole rows of ``docs`` in slot order; returns the folders' key.

    The key is ``shard``, or ``_shard`` and so on where ``docs`` has a column of that name. Every row is written once, whatever its id: the
    rows get numbers of their own, and the join by these moves each text once. An empty table writes no folder.
    """
    key, slot, number = fresh(docs, "shard", "slot", "row_number")
    rows = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    place = shard_assignments(rows, n_shards, extra=(number,), **options)
    place = place.select(F.col(number), F.col("shard").alias(key), F.col("slot").alias(slot))
    whole = rows.join(place, number).repartition(key).sortWithinPartitions(key, slot)
    whole.select(*docs.columns, key).write.partitionBy(key).parquet(path)
    return key


def op6_stratified_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_assignments(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "rank",
    )
