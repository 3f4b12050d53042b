"""Approximate nearest neighbours by adaptive dimension scans over inverted lists.

Vectors are normalised, so that the largest cosine is the smallest distance, and rotated at random, so that any first
columns estimate the whole distance. Lists come from spherical k-means fitted to a bounded sample; every vector is put
into its nearest centroid's list. A query probes the nearest lists, and further ones until they hold candidates enough; in
each it scans the columns in blocks and drops a candidate as soon as a hypothesis test on the partial distance says that
the candidate is farther than the k-th best found. What survives is scored by the exact cosine of the original vectors in
double precision.

Lists are cut into segments of bounded size, and each list's queries into blocks, so that neither a list that holds a third
of the vectors nor many queries of one list meet in one task. A list is copied once for each block of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import hash_sample, materialize, table

#: Rows that centroids are fitted to (about so many, chosen by hash of the id), and most lists.
MAX_SAMPLE = 20_000
MAX_LISTS = 4096
#: Most rows of a segment and most queries of a block.
SEGMENT = 4096
QUERY_BLOCK = 2048
COLUMNS = 16
#: Share of true neighbours among a sample that the probed lists must hold.
CALIBRATED = 0.97
#: The test's significance: larger drops fewer true neighbours.
EPSILON = 2.1
HEAD = 64
#: Least rows in the lists that a query probes: one that lies apart, or alone in its list, looks further.
CANDIDATES = 1000
#: Distances of equal rows differ by rounding: limits on them are loosened by this share and this much.
LOOSE = (1 + 1e-9, 1e-12)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part.

    Left out are null ids, vectors that are null, empty or zero or hold null or non-finite components, and, since cosines
    are between vectors of one length, those that have not ``length`` components, or without it the most frequent number of
    components (the larger of equally frequent).
    """
    v = F.col("v")
    some = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    if length is None:
        sizes = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        length = sizes[0]["d"] if sizes else 0
    return some.filter(F.size("v") == length)


def _matrix(column) -> np.ndarray:
    return np.array(list(column), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Spherical k-means; an empty list gets the sample that fits its centroid worst."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    c = x[rng.permutation(len(x))[:lists]]
    for _ in range(rounds):
        best, sim = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ c.T
            best[i : i + 4096], sim[i : i + 4096] = s.argmax(axis=1), s.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.sqrt((total * total).sum(axis=1))
        empty = np.nonzero(norm < 1e-12)[0]
        total[empty] = x[np.argsort(sim)[: len(empty)]]
        norm[empty] = 1
        c = total / norm[:, None]
    return c


def needed_probes(sample: np.ndarray, centroids: np.ndarray, k: int, share: float = CALIBRATED, queries: int = 200) -> int:
    """How many lists hold ``share`` of the sample queries' ``k`` nearest in the sample.

    Clustered vectors need few lists, vectors without structure most of them.
    """
    x = _unit(sample)
    q = x[:: max(1, len(x) // queries)][:queries]
    order = np.argsort(-(q @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(q), axis=0), axis=1)
    s = q @ x.T
    near = np.argsort(-s, axis=1)[:, : k + 1]  # the query itself is among them
    own = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    ranks = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(share * len(ranks)))]) + 1


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def adaptive_scan(q: np.ndarray, rows: np.ndarray, k: int, spare: int = 8) -> np.ndarray:
    """Positions of the rows that may be among the ``k`` nearest of ``q``; both are rotated unit vectors.

    The first ``HEAD`` rows are measured in full and give the first k-th best distance. The rest is scanned in column
    blocks: after ``d`` of ``D`` columns a row is dropped if its partial distance, scaled by D / d, exceeds the k-th best
    by more than ``(1 + EPSILON / sqrt(d))`` squared, and what the ``k`` best so far have in these columns.
    """
    head = rows[:HEAD]
    near = ((head - q) ** 2).sum(axis=1)
    if len(rows) > len(head):
        bound = np.partition(near, k - 1)[k - 1] * LOOSE[0] + LOOSE[1] if len(near) >= k else np.inf
        width = rows.shape[1]
        alive = np.arange(len(head), len(rows))
        part = np.zeros(len(alive))
        lead = ((head[near <= bound] - q) ** 2).cumsum(axis=1)  # what ties with a best head row fares no worse than it
        for at in range(0, width, COLUMNS):
            end = min(at + COLUMNS, width)
            gap = rows[alive, at:end] - q[at:end]
            part = part + (gap * gap).sum(axis=1)
            if end < width:
                limit = max(bound * (1 + EPSILON / math.sqrt(end)) ** 2, lead[:, end - 1].max() * (width / end) * LOOSE[0] + LOOSE[1])
                keep = part * (width / end) <= limit
                alive, part = alive[keep], part[keep]
                if not len(alive):
                    break
        near, where = np.concatenate([near, part]), np.concatenate([np.arange(len(head)), alive])
    else:
        where = np.arange(len(head))
    if len(near) > k + spare:  # rounding may swap rows at the edge: a few more and all ties are scored exactly
        edge = np.partition(near, k + spare - 1)[k + spare - 1] * LOOSE[0] + LOOSE[1]
        where = where[near <= edge]
    return where


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    lists: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest other vectors by cosine for each query row.

    ``lists`` defaults to half the square root of the number of vectors, 16 at least; ``probes`` to what holds ``CALIBRATED`` of the
    neighbours in the sample that the centroids are fitted to. Ties go to the smaller ``vec_id``. Rows that ``valid_vectors``
    leaves out take no part on either side, where the table and not the queries says which length counts; a query's own id is no candidate, of an id that occurs twice one row of the best
    score is returned; an empty table gives an empty result. Other columns play no part.
    """
    spark = vectors.sparkSession
    base = materialize(valid_vectors(vectors, id_col, vector_col), "vectors")
    n = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    lists = max(1, min(MAX_LISTS, n, lists or max(16, math.ceil(math.sqrt(n) / 2))))
    sample = _matrix(hash_sample(base, F.col("vec_id"), MAX_SAMPLE).select("v").toPandas()["v"])
    if not len(sample):  # ids that all hash alike
        sample = _matrix(base.select("v").limit(1).toPandas()["v"])
    asked = valid_vectors(queries, id_col, vector_col, sample.shape[1]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    centroids = fit_centroids(sample, min(lists, len(sample)))
    probes = min(probes or needed_probes(sample, centroids, k), len(centroids))
    held = spark.sparkContext.broadcast((centroids, rotation(centroids.shape[1])))  # at most MAX_LISTS centroids

    def assign(batches):
        c, _ = held.value
        for pdf in batches:
            if len(pdf):
                x = _unit(_matrix(pdf["v"]))
                near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
                yield pdf.assign(list=near.astype(np.int32))

    indexed = materialize(base.mapInPandas(assign, "vec_id long, v array<double>, list int"), "index")
    sizes = np.zeros(len(centroids), dtype=np.int64)
    for r in indexed.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    known = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        c, _ = held.value
        for pdf in batches:
            x = _unit(_matrix(pdf["q"])) if len(pdf) else np.zeros((0, 1))
            for i in range(0, len(x), 512):
                order = np.argsort(-(x[i : i + 512] @ c.T), axis=1)
                before = np.cumsum(known.value[order], axis=1) - known.value[order]
                take = (np.arange(len(c)) < probes) | (before < CANDIDATES)
                at, place = np.nonzero(take & (known.value[order] > 0))
                some = pdf.iloc[i + at]
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy(), "list": order[at, place].astype(np.int32), "q": some["q"].to_numpy()})

    probed = materialize(asked.mapInPandas(probe, "query_id long, list int, q array<double>"), "probed")
    wanted = np.zeros(len(centroids), dtype=np.int64)
    for r in probed.groupBy("list").count().collect():  # one row per list
        wanted[r["list"]] = r["count"]
    cuts = [(t, max(1, math.ceil(s / SEGMENT)), math.ceil(w / QUERY_BLOCK)) for t, (s, w) in enumerate(zip(sizes.tolist(), wanted.tolist(), strict=True)) if w]
    cut = F.broadcast(spark.createDataFrame(cuts, "list int, segs int, blocks int"))  # one row per list
    rows = indexed.join(cut, "list").withColumn("seg", F.pmod(F.xxhash64("vec_id"), "segs").cast("int"))
    rows = rows.select("vec_id", "list", "seg", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    probed = probed.join(cut, "list").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), "blocks").cast("int"))
    probed = probed.select("query_id", "list", "q", "block", F.explode(F.sequence(F.lit(0), F.col("segs") - 1)).alias("seg"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v, ids, turn = _matrix(left["v"]), left["vec_id"].to_numpy(), held.value[1]
            u = _unit(v) @ turn
            size = np.sqrt((v * v).sum(axis=1))
            asked_ = _matrix(right["q"])
            for qid, q, w in zip(right["query_id"], asked_, _unit(asked_) @ turn, strict=True):
                mine = ids != qid
                pos = adaptive_scan(w, u, k) if mine.all() else np.nonzero(mine)[0][adaptive_scan(w, u[mine], k)]
                # a sum row by row: a matrix product may give equal rows different doubles
                score = (v[pos] * q).sum(axis=1) / (size[pos] * math.sqrt((q * q).sum()))
                best = np.lexsort((ids[pos], -score))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[pos[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    keys = ["list", "seg", "block"]
    found = rows.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id"))))
    ranked = best.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))  # at most k rows per probed segment
    return ranked.select("query_id", F.posexplode("top").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )


def op2_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
