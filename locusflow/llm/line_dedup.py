"""Fuzzy line dedup: MinHash over character shingles, banding, exact verification, distributed union-find.

Lines are trimmed and lower-cased (A-Z). Each distinct line of a batch gets a signature of ``BANDS * ROWS`` minima over its
``SHINGLE``-character shingles. Lines that share a band meet in a bucket, where their shingle sets are compared exactly;
a bucket emits a spanning forest of its links. Components keep the line that occurs first.

A pair of similarity 0.8 shares a band with a probability of 99 %; at 0.05, the usual value for two lines of one
language, of 4 in a million. Only lines that share a bucket have their text moved: a bit set of fixed size, filled
with their ids, lets the others go before the shuffle. Larger buckets are dealt to blocks by the hash of the line, and
every two blocks are compared; a bucket is never held as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import fresh, join_by_size, materialize, table
from locusflow.llm.components import connected_components

SHINGLE = 7
BANDS = 12
ROWS = 5
SIMILARITY = 0.8
#: About the most lines, and the most characters, of a block; a longer line is a block with few others.
BLOCK = 512
BLOCK_CHARS = 2_000_000
#: Bits of the set of candidate lines; a fuller set moves more lines and changes no result.
FILTER_BITS = 1 << 26
#: Characters hashed at once: arrays of this size stay in a core's cache.
_CHARS = 64_000
#: Lines whose bands are packed at once.
_LINES = 1 << 16
#: Groups of bands, by their first bits: a group's numbers from one pack travel as one row.
GROUP_BITS = 12
#: Numbers of a group that are held before those that have met go on.
HELD = 1 << 20


def normal_lines(text: str | None) -> list[tuple[int, str]]:
    """``(line number from 0, normalised line)`` of the lines that are not blank."""
    if not text:
        return []
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return [(i, s) for i, x in enumerate(low.split("\n")) if (s := x.strip(" \t\r\x0b\x0c"))]


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _polynomial(codes: np.ndarray, n: int) -> np.ndarray:
    """Of every ``n`` numbers in a row the sum of their multiples by falling powers of one factor, by halves."""
    if n == 1:
        return codes
    half = n // 2
    part = _polynomial(codes, half)
    to = len(codes) - n + 1
    out = part[:to] * np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64))
    out += part[half : half + to]
    if n % 2:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[n - 1 :]
    return out


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines in a row, and where each line's begin. A shorter line is one shingle."""
    padded = [x if len(x) >= SHINGLE else x + "\x00" * (SHINGLE - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    h = _polynomial(codes, SHINGLE)
    n = size - SHINGLE + 1
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    # the positions whose shingle crosses into the next line go
    crossing = np.repeat(begin[1:] - SHINGLE + 1, SHINGLE - 1) + np.tile(np.arange(SHINGLE - 1), len(lines) - 1)
    keep = np.ones(len(h), dtype=bool)
    keep[crossing] = False
    return _mix(h[keep]), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    k = BANDS * ROWS
    return (rng.integers(1, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def bands(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS`` signed 64-bit keys per line."""
    mul, add = _parameters()
    least = np.empty((BANDS * ROWS, len(lines)), dtype=np.uint32)
    for a, b in _runs(lines):
        h, begin = shingle_hashes(lines[a:b])
        low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(low)
        for r in range(BANDS * ROWS):
            # odd multiples of one half, shifted by the other: a permutation of 32 bits each time
            np.bitwise_xor(low, add[r], out=x)
            np.multiply(x, mul[r], out=x)
            np.add(x, high, out=x)
            np.minimum.reduceat(x, begin, out=least[r, a:b])
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93), len(lines), axis=1)
    for r in range(ROWS):
        key = _mix(key ^ least[r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
    return np.ascontiguousarray(key.T).view(np.int64)


def _runs(lines: list[str]):
    """Index ranges of about ``_CHARS`` characters."""
    begin, size = 0, 0
    for i, x in enumerate(lines):
        size += len(x)
        if size >= _CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(lines):
        yield begin, len(lines)


def _distinct(batch: pa.RecordBatch) -> tuple[list[str], list[bytes], np.ndarray]:
    """The distinct lines of a batch, their keys, and of each key the first half as a number."""
    lines = list({x for t in batch.column("t").to_pylist() for _, x in normal_lines(t)})
    keys = [line_key(x) for x in lines]
    return lines, keys, np.frombuffer(b"".join(keys), dtype="<i8")[::2]


def packed(pairs: np.ndarray) -> pa.RecordBatch:
    """``part, pairs``: rows ``(band, line)``, the bytes of those whose bands begin with the same bits in one row."""
    pairs = np.ascontiguousarray(pairs[np.argsort(pairs[:, 0].view(np.uint64))])
    part = (pairs[:, 0].view(np.uint64) >> np.uint64(64 - GROUP_BITS)).astype(np.int32)
    begin = np.nonzero(np.diff(part, prepend=-1))[0]
    ends = np.append(begin, len(part)).astype(np.int32) * 16
    held = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays([pa.array(part[begin]), held], ["part", "pairs"])


def met(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ``(band, line)`` the distinct ones of bands with several lines; and one row of every band."""
    pairs = pairs[np.argsort(pairs[:, 0])]
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = pairs[1:, 0] != pairs[:-1, 0]
    again = ~new
    again[:-1] |= ~new[1:]
    some = pairs[again]
    some = some[np.lexsort((some[:, 1], some[:, 0]))]
    same = some[1:, 0] == some[:-1, 0]
    keep = np.ones(len(some), dtype=bool)
    keep[1:] = ~same | (some[1:, 1] != some[:-1, 1])
    some = some[keep]
    same = some[1:, 0] == some[:-1, 0]
    shared = np.zeros(len(some), dtype=bool)
    shared[1:] = same
    shared[:-1] |= same
    return some[shared], pairs[new]


def shared_bands(batches):
    """``band, line`` of bands with several lines, from rows of ``packed`` in the order of ``part``.

    A group that is long holds one row of every band and lets the others go; those may come again.
    """
    part, parts, size, bound = None, [], 0, HELD

    def rows(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["band", "line"])

    for batch in batches:
        out = []
        for p, raw in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if p != part:
                if parts:
                    out.append(met(np.concatenate(parts))[0])
                part, parts, size, bound = p, [], 0, HELD
            parts.append(np.frombuffer(raw, dtype="<i8").reshape(-1, 2))
            size += len(parts[-1])
            if size >= bound:
                some, left = met(np.concatenate(parts))
                out.append(some)
                parts, size, bound = [left], len(left), max(HELD, 2 * len(left))
        if out:
            yield rows(np.concatenate(out))
    if parts:
        yield rows(met(np.concatenate(parts))[0])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def verified_links(names: list[bytes], sets: list[np.ndarray], left: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between lines, given their sorted shingle sets.

    The first ``left`` meet all that follow them, the others only those. Pairs that are connected already are skipped.
    """
    if len(sets) == 2:  # most buckets
        a, b = len(sets[0]), len(sets[1])
        if left and min(a, b) >= similarity * max(a, b):
            common = _common(*sets)
            if common >= similarity * (a + b - common):
                return [(names[0], names[1])]
        return []
    size = np.array([len(x) for x in sets])
    group, out = np.arange(len(sets)), []
    for i in range(left):
        near = np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :])
        for j in (i + 1 + np.nonzero(near & (group[i + 1 :] != group[i]))[0]).tolist():
            if group[i] == group[j]:
                continue
            common = _common(sets[i], sets[j])
            if common >= similarity * (size[i] + size[j] - common):
                group[group == group[j]] = group[i]
                out.append((names[i], names[j]))
    return out


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    h, begin = shingle_hashes(lines)
    begin = begin.tolist()
    for x, y in zip(begin, [*begin[1:], len(h)], strict=True):
        h[x:y].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[begin] = True
    ends = [*np.concatenate([[0], np.cumsum(new)])[begin].tolist(), int(new.sum())]
    h = h[new]
    return [h[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _bucket_runs(ends: np.ndarray, lines: list[str]):
    """Ranges of buckets with about ``_CHARS`` characters: the sets of no more than these are held at once."""
    begin, size = 0, 0
    for k in range(len(ends) - 1):
        size += sum(map(len, lines[ends[k] : ends[k + 1]]))
        if size >= _CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(ends) - 1:
        yield begin, len(ends) - 1


def line_components(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``node, root``: the keys of the distinct lines that are linked to others, and their component's smallest key."""
    spark = docs.sparkSession
    some = docs.select(F.col(text_col).alias("t")).filter(F.col("t").isNotNull())

    def signatures(batches):
        for batch in batches:
            lines, _, ids = _distinct(batch)
            for a in range(0, len(lines), _LINES):
                some = lines[a : a + _LINES]
                yield packed(np.stack([bands(some).ravel(), np.repeat(ids[a : a + _LINES], BANDS)], axis=1))

    # most bands have one line: the shuffle moves packed numbers in few rows, and only bands with several lines come out
    banded = some.mapInArrow(signatures, "part int, pairs binary").repartition("part").sortWithinPartitions("part")
    shared = materialize(banded.mapInArrow(shared_bands, "band long, line long").distinct(), "buckets")
    n_bits = FILTER_BITS
    cells = shared.select(F.pmod("line", F.lit(n_bits)).alias("p"))
    cells = cells.groupBy(F.expr("cast(p div 64 as int)").alias("c")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("v"))
    got = cells.toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(n_bits // 64, dtype=np.int64)
    bits[got["c"].to_numpy(dtype=np.int64)] = got["v"].to_numpy(dtype=np.int64)
    held = spark.sparkContext.broadcast(bits)

    def texts(batches):
        b = held.value
        for batch in batches:
            lines, keys, ids = _distinct(batch)
            p = ids % n_bits
            some = np.nonzero((b[p >> 6] >> (p & 63)) & 1)[0]
            if len(some):
                of = [pa.array(ids[some]), pa.array([keys[i] for i in some], pa.binary()), pa.array([lines[i] for i in some], pa.string())]
                yield pa.RecordBatch.from_arrays(of, ["line", "key", "s"])

    found = some.mapInArrow(texts, "line long, key binary, s string").groupBy("line", "key").agg(F.min("s").alias("s"))
    found = materialize(found, "found")
    # bands with equal sets of lines are one bucket: sets are told apart by their size and 128 bits of their members' hashes
    of = [F.bit_xor(F.xxhash64("line", F.lit(i))).alias(f"h{i}") for i in range(2)]
    known = shared.join(found.groupBy("line").agg(F.max(F.length("s")).alias("chars")), "line")
    bucket = known.groupBy("band").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"), *of)
    bucket = bucket.groupBy("k", "chars", "h0", "h1").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("n")
    placed = join_by_size(shared, materialize(bucket.select("band", "k", blocks), "sizes"), "band", "k", shared.count())
    placed = placed.withColumn("at", F.pmod(F.xxhash64("line"), "n").cast("int"))
    # a block meets itself and every other block of its bucket once
    pairs = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "band", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"), "at", "line"
    )
    member = F.struct("at", "key", "s")
    rows = pairs.join(found, "line").groupBy("band", "x", "y").agg(F.array_sort(F.collect_list(member)).alias("m"))

    def verify(batches):
        for batch in batches:  # one row per bucket or pair of blocks, of at most 2 * BLOCK lines
            m = batch.column("m")
            ends, flat = m.offsets.to_numpy(), m.values
            at, keys, lines = flat.field("at").to_numpy(), flat.field("key").to_pylist(), flat.field("s").to_pylist()
            first, last = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            out = []
            for start, stop in _bucket_runs(ends, lines):
                base = ends[start]
                sets = shingle_sets(lines[base : ends[stop]])
                for k in range(start, stop):
                    a, b = ends[k], ends[k + 1]
                    left = b - a if first[k] == last[k] else int((at[a:b] == first[k]).sum())
                    out += verified_links(keys[a:b], sets[a - base : b - base], left, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    links = rows.select("x", "y", "m").mapInArrow(verify, "a binary, b binary")
    return connected_components(links.distinct())


def line_occurrences(rows: DataFrame) -> DataFrame:
    """``row, doc_id, line_no, key`` of every line that is not blank, and of every row once with ``line_no`` null, of columns ``row, doc_id, t``.

    ``n_lines``, where ``line_no`` is null, is the number of all lines.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            row, doc = batch.column("row"), batch.column("doc_id")
            none = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            n_lines = pa.array([t.count("\n") + 1 if t else 1 for t in texts], pa.int64())
            names = ["row", "doc_id", "line_no", "key", "n_lines"]
            yield pa.RecordBatch.from_arrays([row, doc, *none, n_lines], names)
            found = [normal_lines(t) for t in texts]
            of = pa.array(np.repeat(np.arange(len(texts)), np.array([len(x) for x in found], dtype=np.int64)))
            at = pa.array([i for x in found for i, _ in x], pa.int32())
            keys = pa.array([line_key(x) for y in found for _, x in y], pa.binary())
            yield pa.RecordBatch.from_arrays([row.take(of), doc.take(of), at, keys, pa.nulls(len(at), pa.int64())], names)

    return rows.mapInArrow(run, "row long, doc_id long, line_no int, key binary, n_lines long")


def _decided(lines: DataFrame, docs: DataFrame, text_col: str, similarity: float) -> DataFrame:
    """The lines that go, with the first of their component as ``best``."""
    lines = lines.filter(F.col("line_no").isNotNull()).drop("n_lines")
    at = F.struct("doc_id", "row", "line_no")
    firsts = materialize(lines.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")
    members = materialize(line_components(docs, text_col, similarity), "members")
    linked = members.join(firsts, members["node"] == firsts["key"]).select("node", "root", "first")
    best = materialize(linked.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")), "best")
    of = join_by_size(members, best, "root", "n", members.count()).select(F.col("node").alias("key"), "best")
    # only keys that occur twice or are linked have lines to remove
    of = firsts.join(of, "key", "left").select("key", F.coalesce("best", "first").alias("best"), "n", "first")
    of = materialize(of.filter((F.col("n") > 1) | (F.col("best") != F.col("first"))).select("key", "n", "best"), "decided")
    return join_by_size(lines, of, "key", "n", lines.count()).filter((F.col("row") != F.col("best.row")) | (F.col("line_no") != F.col("best.line_no")))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, line_no, first_doc, first_line, row`` of every line that is not the first of its component.

    Lines are linked if their shingle sets have a Jaccard similarity of ``similarity`` or more; the first is the one with the
    smallest ``(doc_id, row, line_no)``, a null id before all others. ``row`` numbers the rows, so that rows that share an id, or
    have none, keep their lines apart, and of repeated rows only one keeps its lines. Blank lines, null and empty texts have no part; a
    line shorter than a shingle is one shingle, so equal only to itself; an empty table gives an empty result. Other columns play no part.
    """
    lines = materialize(line_occurrences(_numbered(docs, id_col, text_col)), "lines")
    return _decided(lines, docs, text_col, similarity).select(
        "doc_id", "line_no", F.col("best.doc_id").alias("first_doc"), F.col("best.line_no").alias("first_line"), "row"
    )


def _by_row(gone: DataFrame) -> DataFrame:
    numbers = F.array_sort(F.collect_list("line_no")).alias("numbers")  # of one text at most
    return gone.groupBy("row").agg(numbers, F.min("best.doc_id").alias("first_doc"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` finds. Columns as given, whatever their names.

    Null texts stay null; a text all of whose lines go is empty; rows that share an id or have none are told apart.
    """
    row, numbers = fresh(docs, "row", "numbers")
    held = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    own = held.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    lines = materialize(line_occurrences(own), "lines")
    gone = _by_row(_decided(lines, docs, text_col, similarity)).select(F.col("row").alias(row), F.col("numbers").alias(numbers))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(F.col(numbers), i)), "\n")
    return held.join(gone, row, "left").withColumn(text_col, F.when(F.col(numbers).isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)


def op8_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: how many lines go, which (numbers from 0, comma-joined), and of how many.

    Null and repeated ids are told apart by rows; null and empty texts have one blank line, which stays.
    """
    docs = table(spark, sf_dir, "documents")
    lines = materialize(line_occurrences(_numbered(docs, "doc_id", "text")), "lines")
    per = _by_row(_decided(lines, docs, "text", SIMILARITY))
    return lines.filter(F.col("line_no").isNull()).select("row", "doc_id", "n_lines").join(per, "row", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("numbers", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"),
        "first_doc",
    )
