"""Shared pieces of the training-data operators: scratch tables, text normalisation, span helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What lies between the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most bytes of one batch for a Python worker.
BATCH_BYTES = str(8 << 20)
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = f"{64 << 20}b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; Python workers of the session get it in small batches."""
    batches_by_bytes(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local one only where that is unset and all tasks run in the driver (tests); on a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "locusflow-scratch")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage without leaving blocks on one executor, so a lost executor costs only the
    tasks that were running on it. The table is deleted when the driver ends: results may read it until then.
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/locusflow-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def batches_by_bytes(spark: SparkSession) -> None:
    """Lower the bytes that one batch for a Python worker may have, unless the session sets that bound itself.

    Ten thousand rows can be any amount of text, and a worker holds several times what it is given.
    """
    if spark.conf.get(_BATCH, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH, BATCH_BYTES)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = ALNUM_GAP) -> Column:
    """Words of a lower-cased text as an array; a null text has none.

    Splitting at the gaps and dropping the empty ends is linear; extracting each match copies the text every time.
    """
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), separators, -1), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that clash with none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def neutral(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by position, so that no name clashes with an operator's own."""
    return df.toDF(*[f"c{i}_" for i in range(len(df.columns))])


def hash_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, chosen by the hash of ``key`` alone; all rows if there are no more.

    A filter and not a top-k: no task sees more than its own rows.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * (most / n)))


def join_by_size(big: DataFrame, small: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has each ``key`` once and in ``n`` how many rows of ``big`` have it.

    Keys with more than one in ``share`` of the ``total`` rows are at most ``share``: these are broadcast, so that the rows of a hot
    key stay where they are. The others are joined by a shuffle.
    """
    hot = F.broadcast(small.filter(F.col(n) * share > total))
    cold = small.filter(F.col(n) * share <= total)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key))
