"""SimHash near-duplicates by tiled exact comparison.

Every text gets a fingerprint of 64 or 128 bits from its word shingles. Distinct fingerprints are dealt to tiles by
their population count; two fingerprints within ``radius`` bits differ by at most ``radius`` in it, so tile pairs that are
further apart are never formed, and inside a pair each block of rows meets only the slice of the other tile that
its counts allow. What remains is compared exactly with numpy's exclusive-or and bit count.

A tile pair emits a spanning forest of its links and not the links, so that a group of k near copies costs k
rows; components are then found by distributed rounds. The comparison grows with the square of the number of
distinct fingerprints: that is the method's price. A tile's size is fixed, so memory is not affected.

Where a similarity is asked for, these components only say which texts are compared: within one, every two texts
within ``radius`` bits that nothing has linked yet are compared by the exact Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locusflow.llm._common import join_by_size, materialize, neutral, table
from locusflow.llm.components import connected_components

TILE = 8192
ROWS = 256
SEED = 42
#: Most shingles and most texts of a block whose shingle sets are compared in one task.
SHINGLES = 1 << 20
BLOCK = 1024
#: Tile pairs of a task, and most tasks that they are dealt to.
PAIRS = 4
MOST_TASKS = 20_000


def shingles(text: str | None, shingle: int) -> list[bytes]:
    """All runs of ``shingle`` words, or the whole of a shorter text; an empty text has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [joined]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    begin, end = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return [joined[a:b] for a, b in zip(begin, end, strict=True)]


def _majority(digests: list[bytes], size: int) -> bytes:
    if len(digests) < 2:
        return digests[0] if digests else bytes(size)
    rows = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, size)
    ones = np.zeros(size * 8, dtype=np.int64)
    for i in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(rows)).tobytes()


def fingerprint(text: str | None, shingle: int, wide: bool) -> bytes:
    """The fingerprint as 8 or 16 big-endian bytes: a bit is 1 if more than half of the shingles' hashes have it."""
    run = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    return _majority([run(x, SEED) for x in shingles(text, shingle)], 16 if wide else 8)


def set_prints(text: str | None, shingle: int, wide: bool) -> tuple[bytes, bytes, int]:
    """Fingerprint over the distinct shingles, a 128-bit name of their set, and their number."""
    run = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    digests = sorted({run(x, SEED) for x in shingles(text, shingle)})
    return _majority(digests, 16 if wide else 8), xxhash.xxh3_128_digest(b"".join(digests), SEED), len(digests)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x, SEED) for x in shingles(text, shingle)], dtype=np.uint64).view(np.int64))


def add_fingerprints(docs: DataFrame, columns: list[str], text_col: str, shingle: int, wide: bool, out: str) -> DataFrame:
    """``columns`` of ``docs`` and ``out``: the fingerprint as lower-case hexadecimal digits."""
    kept = docs.select(*columns, F.col(text_col).alias("_text_"))
    schema = kept.drop("_text_").schema.add(out, "string")

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns=["_text_"]).assign(**{out: [fingerprint(t, shingle, wide).hex() for t in pdf["_text_"]]})

    return kept.mapInPandas(run, schema)


def add_set_prints(docs: DataFrame, columns: list[str], text_col: str, shingle: int, wide: bool) -> DataFrame:
    """``columns`` of ``docs``, the text as ``_text_``, and ``fp``, ``sig``, ``m`` of ``set_prints``."""
    kept = docs.select(*columns, F.col(text_col).alias("_text_"))
    schema = StructType([*kept.schema.fields]).add("fp", "string").add("sig", "string").add("m", "long")

    def run(batches):
        for pdf in batches:
            made = [set_prints(t, shingle, wide) for t in pdf["_text_"]]
            yield pdf.assign(fp=[f.hex() for f, _, _ in made], sig=[s.hex() for _, s, _ in made], m=[m for _, _, m in made])

    return kept.mapInPandas(run, schema)


def _tiles(histogram: dict[int, int], radius: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Tiles ``(low, high, part, parts)`` in order of population count, and the last tile that each must meet."""
    ranges: list[list[int]] = []
    for p in sorted(histogram):
        if ranges and ranges[-1][2] + histogram[p] <= TILE:
            ranges[-1][1:] = [p, ranges[-1][2] + histogram[p]]
        else:
            ranges.append([p, p, histogram[p]])
    tiles = [(low, high, i, parts) for low, high, n in ranges for parts in [math.ceil(n / TILE)] for i in range(parts)]
    last, j = [], 0
    for _, high, _, _ in tiles:
        while j + 1 < len(tiles) and tiles[j + 1][0] <= high + radius:
            j += 1
        last.append(j)
    return tiles, last


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of ``i`` and ``j``; parents are roots, and a root is its set's smallest member."""
    while True:
        a, b = parent[i], parent[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low != high
        if not keep.any():
            return parent
        i, j = low[keep], high[keep]
        np.minimum.at(parent, j, i)
        while (up := parent[parent]) is not parent and (up != parent).any():
            parent = up


def _unpack(prints) -> np.ndarray:
    """Fingerprints in hexadecimal digits as rows of 64-bit words, in the order given."""
    raw = np.frombuffer(bytes.fromhex("".join(prints)), dtype=">u8").astype(np.uint64)
    return raw.reshape(len(prints), -1) if len(prints) else raw.reshape(0, 1)


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """A spanning forest of the links between two tiles, or within ``left``: pairs of positions in ``left`` and then ``right``.

    Tiles are rows of 64-bit words.
    """
    bits = left if right is None else np.concatenate([left, right])
    count = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    n = len(left)
    mine = np.argsort(count[:n], kind="stable")
    other = mine if right is None else n + np.argsort(count[n:], kind="stable")
    there, there_count = np.ascontiguousarray(bits[other].T), count[other]
    parent = np.arange(len(bits))
    for at in range(0, n, ROWS):
        rows = mine[at : at + ROWS]
        low = np.searchsorted(there_count, count[rows[0]] - radius, side="left")
        high = np.searchsorted(there_count, count[rows[-1]] + radius, side="right")
        if right is None:
            low = max(low, at)  # earlier rows have met these
        if low >= high:
            continue
        apart = np.zeros((len(rows), high - low), dtype=np.uint8)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[rows, w][:, None] ^ there[w, low:high][None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = rows[i], other[low + j]
        keep = i != j
        if keep.any():
            parent = _unite(parent, i[keep], j[keep])
    found = np.nonzero(parent != np.arange(len(bits)))[0]
    return np.stack([found, parent[found]], axis=1)


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: a spanning forest of all links between the distinct fingerprints ``fp`` (hexadecimal digits).

    A pair of tiles is a row of its own, packed, and so many tasks get them that none has more than about ``PAIRS``.
    """
    spark = prints.sparkSession
    # the count is taken word by word: bit_count works on longs
    words = F.transform(
        F.sequence(F.lit(0), (F.length("fp") / 8 - 1).cast("int")),
        lambda i: F.conv(F.substring(F.col("fp"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"),
    )
    counted = prints.select("fp", F.aggregate(words, F.lit(0), lambda a, x: a + F.bit_count(x)).alias("p"))
    rows = counted.groupBy("p").agg(F.count("*").alias("n"), F.max(F.length("fp")).alias("digits")).collect()  # one row per population count
    tiles, last = _tiles({r["p"]: r["n"] for r in rows}, radius)
    if not tiles:
        return spark.createDataFrame([], "a string, b string")
    n_words = max(r["digits"] for r in rows) // 16
    # some numbers a tile on the driver; each popcount knows its first tile and its number of parts
    first: dict[int, tuple[int, int]] = {}
    for t, (low, high, _, parts) in enumerate(tiles):
        for p in range(low, high + 1):
            first.setdefault(p, (t, parts))
    where = spark.createDataFrame([(p, t, parts) for p, (t, parts) in first.items()], "p int, t0 int, parts int")
    since, at = [], 0  # the tiles that meet a tile are a run, since ``last`` never falls
    for u in range(len(tiles)):
        while last[at] < u:
            at += 1
        since.append(at)
    reach = F.broadcast(spark.createDataFrame([(t, last[t], since[t]) for t in range(len(tiles))], "t int, upto int, since int"))
    tasks = min(MOST_TASKS, math.ceil(sum(u - t + 1 for t, u in enumerate(last)) / PAIRS))
    placed = counted.join(F.broadcast(where), "p").select("fp", (F.col("t0") + F.pmod(F.xxhash64("fp"), "parts")).cast("int").alias("t"))
    packed = F.unhex(F.array_join(F.collect_list("fp"), "")).alias("bits")
    blobs = materialize(placed.groupBy("t").agg(packed), "tiles").join(reach, "t")
    left = blobs.select("t", F.explode(F.sequence("t", "upto")).alias("u"), F.col("bits").alias("mine"))
    right = blobs.select(F.col("t").alias("u"), F.explode(F.sequence("since", "t")).alias("t"), F.col("bits").alias("others"))
    right = right.filter("t < u")
    pairs = left.repartition(tasks, "t", "u").join(right.repartition(tasks, "t", "u").hint("merge"), ["t", "u"], "left")

    def run(batches):
        for pdf in batches:
            for mine, others in zip(pdf["mine"], pdf["others"], strict=True):
                raw = bytes(mine) + bytes(others or b"")
                bits = np.frombuffer(raw, dtype=">u8").reshape(-1, n_words).astype(np.uint64)
                cut = len(mine) // (8 * n_words)
                found = linked(bits[:cut], bits[cut:] if others else None, radius)
                if len(found):
                    size, digits = 16 * n_words, raw.hex()
                    yield pd.DataFrame([(digits[i * size : (i + 1) * size], digits[j * size : (j + 1) * size]) for i, j in found.tolist()], columns=["a", "b"])

    return pairs.select("mine", "others").mapInPandas(run, "a string, b string")


def similar(rows: pd.DataFrame, radius: int, similarity: float) -> list[tuple[str, str]]:
    """A spanning forest of the links among ``rows`` (``sig, fp, part, s``): pairs within ``radius`` bits and of the similarity.

    Where ``rows`` are of two parts, only pairs across them are compared.
    """
    names, part, sets = rows["sig"].to_numpy(), rows["part"].to_numpy(), rows["s"].to_list()
    bits, sizes = _unpack(rows["fp"]), np.array([len(x) for x in sets])
    parent, across = np.arange(len(rows)), len(set(part)) > 1
    out = []
    for i in range(len(rows) - 1):
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
        fit = np.minimum(sizes[i], sizes[i + 1 :]) / np.maximum(sizes[i], sizes[i + 1 :]) >= similarity
        fit &= (apart <= radius) & (parent[i + 1 :] != parent[i])
        if across:
            fit &= part[i + 1 :] != part[i]
        for j in np.nonzero(fit)[0] + i + 1:
            if parent[i] == parent[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both / (sizes[i] + sizes[j] - both) >= similarity:
                out.append((names[i], names[j]))
                parent[parent == parent[j]] = parent[i]
    return out


def similar_links(prints: DataFrame, nodes: DataFrame, shingle: int, radius: int, similarity: float) -> DataFrame:
    """``a, b``: links between ``nodes`` (``sig, fp, m, first``) whose shingle sets are at least that similar.

    What the fingerprints link is compared group by group. A group too large for a task is cut into blocks of bounded size, and
    every two blocks meet. Of equal sets one text, that of row ``first.rid``, is moved.
    """
    # a smaller set is like no other but itself
    able = nodes.filter(F.col("m") / (F.col("m") + 1) >= similarity)
    roots = connected_components(fingerprint_links(able.select("fp").distinct(), radius)).toDF("fp", "root")
    grouped = able.select("sig", "fp", "m", F.col("first.rid").alias("rid")).join(roots, "fp", "left")
    grouped = materialize(grouped.withColumn("g", F.coalesce("root", "fp")).drop("root"), "grouped")
    sizes = grouped.groupBy("g").agg(F.count("*").alias("k"), F.sum("m").alias("total")).filter("k > 1")
    blocks = F.greatest(F.ceil(F.col("total") / SHINGLES), F.ceil(F.col("k") / BLOCK)).cast("int")
    wanted = materialize(join_by_size(grouped, sizes.select("g", "k", blocks.alias("blocks")), "g", "k", grouped.count()), "wanted")
    tasks = max(1, math.ceil((wanted.agg(F.sum("m")).first()[0] or 0) * 2 / SHINGLES))
    texts = prints.select("rid", "_text_").join(wanted.select("rid", "sig", "fp", "g", "blocks"), "rid")

    def sets(batches):
        for pdf in batches:
            for i in range(0, len(pdf), ROWS):
                some = pdf.iloc[i : i + ROWS]
                yield some[["sig", "fp", "g", "blocks"]].assign(s=[shingle_set(t, shingle) for t in some["_text_"]])

    part = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    held = texts.mapInPandas(sets, "sig string, fp string, g string, blocks int, s array<long>").withColumn("part", part)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(" ", "g", F.least("part", j), F.greatest("part", j)))
    alone = F.array(F.pmod(F.xxhash64("g"), F.lit(tasks)).cast("string"))
    placed = held.withColumn("task", F.explode(F.when(F.col("blocks") == 1, alone).otherwise(meets))).drop("blocks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = [e for _, rows in pdf.groupby("g") for e in similar(rows, radius, similarity)]
        return pd.DataFrame(edges, columns=["a", "b"], dtype=object)

    return placed.groupBy("task").applyInPandas(run, "a string, b string")


def _grouped(docs: DataFrame, id_: str, body: str, shingle: int, wide: bool, radius: int, similarity: float | None) -> tuple[DataFrame, DataFrame, str]:
    """The rows of ``docs`` with ``rid``, a number of their own, and their fingerprints; what is known of each ``key``; the key's name.

    What is known is ``n``, how many rows have it, and ``best``, the first row (by id, null last, then number) of its component.
    """
    columns = [c for c in docs.columns if c != body]
    rows = docs.withColumn("rid", F.monotonically_increasing_id())
    if similarity is None:
        prints, key = add_fingerprints(rows, [*columns, "rid"], body, shingle, wide, "fp").withColumn("m", F.lit(0)), "fp"
    else:
        prints, key = add_set_prints(rows, [*columns, "rid"], body, shingle, wide), "sig"
    prints = materialize(prints, "fingerprints")
    first = F.struct(F.col(id_).isNull().alias("no_id"), F.col(id_).alias("id"), F.col("rid").alias("rid"))
    nodes = materialize(prints.groupBy(*dict.fromkeys([key, "fp", "m"])).agg(F.min(first).alias("first"), F.count("*").alias("n")), "nodes")
    if similarity is None:
        links = fingerprint_links(nodes, radius)
    else:
        links = similar_links(prints, nodes, shingle, radius, similarity)
    members = materialize(connected_components(links).withColumnRenamed("node", key), "members")
    firsts = members.join(nodes.select(key, "first"), key)
    best = materialize(firsts.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("k")), "best")
    of = join_by_size(members, best, "root", "k", members.count()).select(key, "best")
    every = nodes.join(of, key, "left").select(key, "n", F.coalesce("best", "first").alias("best"))
    return prints, materialize(every, "named"), key


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    wide: bool = True,
    radius: int = 32,
    extra: tuple[str, ...] = (),
    similarity: float | None = 0.8,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``extra`` columns, ``fingerprint``, ``component_id``.

    Texts whose fingerprints differ in at most ``radius`` bits and whose sets of shingles have a Jaccard similarity of at
    least ``similarity`` are linked, equal sets always; a component's id is its smallest ``doc_id``. The fingerprints are then of
    the distinct shingles. Two texts of similarity 0.8 differ in about 15 % of the bits. Without a similarity the
    fingerprints alone, over all shingles, decide. Null and empty texts have no shingles and the fingerprint zero and are
    equal; repeated rows share everything; null ids are kept and never chosen unless a component has no other; an empty
    table gives an empty result. Columns not named play no part.
    """
    kept = neutral(docs.select(id_col, *extra, text_col))
    id_, *others, body = kept.columns
    prints, every, key = _grouped(kept, id_, body, shingle, wide, radius, similarity)
    rows = prints.select(id_, *others, *dict.fromkeys([key, "fp"]))
    out = join_by_size(rows, every, key, "n", prints.count())
    return out.select(id_, *others, "fp", F.col("best.id").alias("component_id")).toDF("doc_id", *extra, "fingerprint", "component_id")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    wide: bool = True,
    radius: int = 32,
    similarity: float = 0.8,
) -> DataFrame:
    """``docs`` with one row of each group of near copies as ``simhash_groups`` finds them. Columns as given, whatever their names.

    The row that stays is the one with the smallest id, null last; of repeated ids, and of rows without any, one row as good as any
    other. Rows and not ids decide: of rows that share an id all are judged by their own texts. Null and empty texts are equal, so that one
    of them stays; an empty table gives an empty result.
    """
    kept = neutral(docs.select(*docs.columns, id_col))
    *carried, id_ = kept.columns
    body = carried[docs.columns.index(text_col)]
    prints, every, _ = _grouped(kept, id_, body, shingle, wide, radius, similarity)
    keep = every.select(F.col("best.rid").alias("rid")).distinct()
    return prints.join(keep, "rid", "left_semi").select(*["_text_" if c == body else c for c in carried]).toDF(*docs.columns)


def op3_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, wide=False, radius=4, similarity=None)
