"""Benchmark decontamination with DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words is one window). Every
training text is scanned once, in its own row:

1. Each window of length ``L`` holds exactly one gram of ``g = (L + 1) // 2`` words that begins at a multiple of
   ``L - g + 1`` in the training text, so hashing only those grams misses no window. They are looked up among the
   hashes of all benchmark grams.
2. The few windows around a gram that was found are compared with the benchmark's windows by a hash join on the
   window's words themselves, so that hash collisions of step 1 change nothing.

Only what was found leaves its row's task. What travels to every task is checked by its bytes: the grams go as a bit set, or
beyond ``max_bits`` by a join, which is shuffled beyond ``max_bytes``; so is the windows' join. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import fresh, materialize, table, words

#: Bits of the gram set for each gram, and the largest set (bits) that is carried in the plan.
BITS_PER_GRAM = 32
MAX_BITS = 1 << 24
#: Most bytes of a table that is broadcast.
MAX_BYTES = 64 << 20


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """``window_text, n_words, items``: every distinct window and the sorted ids (text) that hold it."""
    w = words(F.col(text_col))
    n = F.size("w")
    starts = F.when(n >= window, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).otherwise(F.array(F.lit(1)))
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), w.alias("w"))
        .filter((n > 0) & F.col("item").isNotNull())
        .withColumn("i", F.explode(starts))
        .select("item", F.slice("w", F.col("i"), F.least(n, F.lit(window))).alias("g"))
        .groupBy(F.array_join("g", " ").alias("window_text"), F.size("g").alias("n_words"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _gram(length: int) -> tuple[int, int]:
    g = (length + 1) // 2
    return g, length - g + 1


def _starts(length: int) -> Column:
    """Where the aligned grams of windows of ``length`` words begin in the words ``w``."""
    g, stride = _gram(length)
    some = F.sequence(F.lit(1), F.greatest(F.size("w") - g + 1, F.lit(1)), F.lit(stride))
    return F.when(F.size("w") >= length, some).otherwise(F.array().cast("array<int>"))


def _in_set(held: Column, n_bits: int, g: int):
    """Whether the gram of ``g`` words at position ``i`` of ``w`` has its bit in the set."""

    def hit(i):
        p = F.pmod(F.xxhash64(F.slice("w", i, F.lit(g))), F.lit(n_bits)).cast("int")
        cell = F.get(held, F.shiftright(p, 6))
        return F.call_function("shiftrightunsigned", cell, p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1

    return hit


def _around(length: int):
    """What is needed of the gram at position ``i``: its window length, its place, and the words of all windows that hold it."""
    g, _ = _gram(length)

    def words_near(i):
        low = F.greatest(i - (length - g), F.lit(1))
        return F.struct(F.lit(length).alias("length"), low.alias("low"), F.slice("w", low, i + length - low).alias("near"))

    return words_near


def _hash_of(w: Column, g: int):
    return lambda i: F.xxhash64(F.slice(w, i, F.lit(g)))


def _hashed(length: int):
    near, gram = _around(length), _hash_of(F.col("w"), _gram(length)[0])
    return lambda i: F.struct(near(i).alias("x"), gram(i).alias("h"))


def _benchmark_grams(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``length, h``: the hashes of all grams of all windows, which stand anywhere in them."""
    grams = None
    for length in lengths:
        g, stride = _gram(length)
        cut = F.transform(F.sequence(F.lit(1), F.lit(stride)), _hash_of(F.split("window_text", " "), g))
        some = windows.filter(F.col("n_words") == length).select(F.lit(length).alias("length"), F.explode(cut).alias("h"))
        grams = some if grams is None else grams.union(some)
    return grams.distinct()


def _bit_set(grams: DataFrame, n: int) -> tuple[Column, int]:
    """The bit set of all ``n`` grams as one constant array of longs, and its size in bits."""
    bits = 1 << 12
    while bits < n * BITS_PER_GRAM:
        bits *= 2
    at = F.pmod("h", F.lit(bits))
    cells = grams.groupBy(F.shiftright(at, 6).cast("int").alias("c")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {bits}) % 64 as int)))").alias("v"))
    held = [0] * (bits // 64)
    for r in cells.collect():  # at most max_bits / 64 numbers
        held[r["c"]] = r["v"]
    return F.from_json(F.lit("[" + ",".join(map(str, held)) + "]"), "array<bigint>"), bits


def _fits(windows: DataFrame, max_bytes: int) -> bool:
    size = F.octet_length("window_text") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64
    return (windows.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_bits: int = MAX_BITS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``row_id, doc_id, text_key, n_words, spans, items``.

    ``spans`` are the hits, sorted and merged, as ``struct<first, last>`` in words from 1; ``items`` the sorted ids
    of the items with a window in the text; ``text_key`` is the text's MD5, null for a null text: rows of one key have equal
    hits. Null and empty texts have no words and no hits; repeated rows and rows with a null id each get their
    own row; items without words or with a null id take no part; an empty benchmark hits nothing. Other columns play no part.
    """
    windows = materialize(benchmark_windows(benchmark, window, item_col, item_text_col), "windows")
    lengths = sorted(r[0] for r in windows.select("n_words").distinct().collect())  # at most `window` values
    base = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.md5(F.col(text_col).cast("binary")).alias("text_key"),
        words(F.col(text_col)).alias("w"),
    )
    row = [F.col("row_id"), F.col("doc_id"), F.col("text_key"), F.size("w").cast("long").alias("n_words")]
    if not lengths:
        none = F.array().cast("array<struct<first:int,last:int>>")
        return base.select(*row, none.alias("spans"), F.array().cast("array<string>").alias("items"))
    grams = materialize(_benchmark_grams(windows, lengths), "grams")
    n = grams.count()
    # a place of length 0 stands for the row itself, so that rows without hits stay
    itself = F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("low"), F.array().cast("array<string>").alias("near")))
    if n * BITS_PER_GRAM <= max_bits:
        held, n_bits = _bit_set(grams, n)
        places = [F.transform(F.filter(_starts(k), _in_set(held, n_bits, _gram(k)[0])), _around(k)) for k in lengths]
        near = base.select(*row, F.explode(F.concat(itself, *places)).alias("x")).select("row_id", "doc_id", "text_key", "n_words", "x.*")
    else:
        places = [F.transform(_starts(k), _hashed(k)) for k in lengths]
        all_ = base.select(*row, F.explode_outer(F.concat(*places)).alias("y")).select("row_id", "doc_id", "text_key", "n_words", "y.x.*", "y.h")
        found = all_.join(F.broadcast(grams) if n * 64 <= max_bytes else grams, ["length", "h"], "left_semi").drop("h")
        near = base.select(*row, itself[0].alias("x")).select("row_id", "doc_id", "text_key", "n_words", "x.*").unionByName(found)
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("near") - F.col("length"), F.lit(0))),
        lambda k: F.struct(
            (F.col("low") + k).alias("first"),
            (F.col("low") + k + F.col("length") - 1).alias("last"),
            F.array_join(F.slice("near", k + 1, F.col("length")), " ").alias("window_text"),
        ),
    )
    blank = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("").alias("window_text")))
    scanned = near.select("row_id", "doc_id", "text_key", "n_words", F.explode(F.when(F.col("length") > 0, cut).otherwise(blank)).alias("c"))
    scanned = scanned.select("row_id", "doc_id", "text_key", "n_words", "c.*")
    right = windows.select("window_text", F.col("items").alias("held_by"))
    if _fits(windows, max_bytes):
        right = F.broadcast(right)
    hits = scanned.join(right, "window_text", "left").filter((F.col("first") == 0) | F.col("held_by").isNotNull())
    found = F.struct("first", "last")
    per_row = hits.groupBy("row_id", "doc_id", "text_key", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("first") > 0, found))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("held_by")))).alias("items"),
    )
    return per_row.select("row_id", "doc_id", "text_key", "n_words", _merged("all").alias("spans"), "items")


def _merged(name: str) -> Column:
    """Spans sorted by first word, with overlapping and adjacent ones joined."""
    kind = "array<struct<first:int,last:int>>"
    return F.expr(
        f"aggregate({name}, struct(0 as reach, cast(array() as {kind}) as out), (a, x) -> if(x.last <= a.reach, a, "
        f"struct(x.last as reach, if(a.reach >= x.first - 1 and size(a.out) > 0, "
        f"concat(slice(a.out, 1, size(a.out) - 1), array(struct(element_at(a.out, -1).first as first, x.last as last))), "
        f"concat(a.out, array(struct(x.first as first, x.last as last)))) as out)), a -> a.out)"
    )


def _hit_texts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``text_key, spans`` of the distinct texts with hits; marked for broadcast if they are few enough."""
    got = contamination(docs, benchmark, **options).filter(F.size("spans") > 0)
    hits = materialize(got.groupBy("text_key").agg(F.first("spans").alias("spans")), "hits")
    size = hits.agg(F.sum(F.size("spans") * 16 + 96)).first()[0] or 0
    return F.broadcast(hits) if size <= options.get("max_bytes", MAX_BYTES) else hits


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text has no window of the benchmark. Columns as given, whatever their names.

    Each row is judged by its text: null and repeated ids change nothing. Null and empty texts stay; an empty benchmark drops nothing.
    """
    hits = _hit_texts(docs, benchmark, **options).select("text_key")
    (key,) = fresh(docs, "text_key")
    marked = docs.withColumn(key, F.md5(F.col(options.get("text_col", "text")).cast("binary")))
    return marked.join(hits.withColumnRenamed("text_key", key), key, "left_anti").select(docs.columns)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words, and the gaps after them, cut out of the texts. Columns as given, whatever their names.

    Each row is cut by its own text: null and repeated ids change nothing. Null and empty texts, and those without hits, stay as they are.
    """
    text = options.get("text_col", "text")
    hits = _hit_texts(docs, benchmark, **options)
    key, spans = fresh(docs, "text_key", "spans")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    marked = docs.withColumn(key, F.md5(F.col(text).cast("binary")))
    joined = marked.join(hits.select(F.col("text_key").alias(key), F.col("spans").alias(spans)), key, "left")
    parts = F.split(text, rf"(?<={gap})(?!{gap})", -1)
    lead = F.when(F.col(text).rlike(rf"^{gap}"), 0).otherwise(1)  # a leading gap is a part without a word
    kept = F.filter(parts, lambda x, i: ~F.exists(spans, lambda s: (i + lead >= s["first"]) & (i + lead <= s["last"])))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).select(docs.columns)


def op7_ngram_decontamination(spark, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.last - x.first + 1)")
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
