"""Secret scan: base patterns, and random-looking tokens told apart by two character Markov models.

Two first-order models, one of random strings and one of ordinary identifiers, are counted from labelled
samples with DataFrame operations. A token's score is the mean log-likelihood ratio of its characters
under the two; the threshold is where a part of the samples that the models have not seen is parted best.
The samples of random strings and of identifiers are made by a fixed rule; to the ordinary ones come the long
words of all texts, which the rule ``WORD`` labels: letters alone, lower-case after the first. No token of random characters
keeps to that for long. Scanning is one projection: no rows move between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm._common import materialize, table
from locusflow.llm._spans import digest, labelled, listing, with_matches

# The base patterns. Equal to the contract's patterns, written without backtracking.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")

#: What the Markov models judge: runs of at least this many characters of the alphabet.
MIN_TOKEN = 16
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Words of the corpus that count as ordinary: as long as a token, or a little less.
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z][a-z]{11,}+(?![A-Za-z0-9+/_-])"
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+"

#: Cheap signs that any text with a match has.
SIGNS = {"a": "[:=]", "k": "AKIA", "h": "[0-9a-f]{24}", "r": f"[A-Za-z0-9+/_-]{{{MIN_TOKEN}}}"}

# Common parts of identifiers.
IDENTIFIER_PARTS = (
    "account add address agent app array async audit auth base batch block body buffer build button cache call "
    "channel check class clear client close cluster code column command commit config connect container content "
    "context control copy count create current data date default delete deploy detail device dialog directory "
    "document domain driver edit element email enable encode engine entry error event example export factory field "
    "file filter find first folder font form format frame from function gateway get global graph group handle "
    "handler header height helper host image import index info input instance integration interface internal item "
    "job key label language last layout length level library limit line link list load local lock log manager map "
    "mask memory menu message method metric mode model module monitor name network node number object offset open "
    "option order output owner package page panel parameter parent parse partition path pattern permission picture "
    "pipeline plan platform player plugin point policy pool port prefix process product profile project property "
    "provider proxy public query queue range read record reference region register release remote remove render "
    "report request reset resource response result return root route rule runtime sample schedule schema scope "
    "screen script search section security select send sequence server service session set setting setup shape shared "
    "size snapshot socket sort source space spec stage start state status step storage store stream string style "
    "submit switch symbol sync system table target task template test text thread time title total trace track "
    "transaction transfer tree trigger type unit update upload user util validate value variable vector version view "
    "virtual warning web width window worker wrapper write zone"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """``token, is_random, n, fold``: ``n`` random strings and ``n`` identifiers made by a fixed rule.

    Random strings are cut from SHA-256 digests as base64, hexadecimal or upper-case text; identifiers join three to
    five common parts in snake, kebab, camel, path or plain style, some with a number or a date. Folds are 0 to 4.
    """
    parts = F.array(*[F.lit(p) for p in IDENTIFIER_PARTS])
    ids = spark.range(n)
    bits = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    wide = F.concat(bits, F.sha2(F.concat(F.lit("more:"), F.col("id").cast("string")), 256))
    length = (F.lit(20) + F.pmod(F.col("id"), F.lit(25))).cast("int")
    b64 = F.regexp_replace(F.base64(F.unhex(wide)), r"[=\s]", "")
    random = F.when(F.col("id") % 4 == 3, wide).when(F.col("id") % 4 == 2, F.upper(F.regexp_replace(b64, "[+/]", ""))).otherwise(b64)
    secret = ids.select(F.expr("id").alias("id"), F.substring(random, F.lit(1), length).alias("token"), F.lit(1).alias("is_random"))
    picks = F.transform(
        F.sequence(F.lit(1), (F.lit(3) + F.pmod(F.col("id"), F.lit(3))).cast("int")),
        lambda i: F.get(parts, F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(IDENTIFIER_PARTS))).cast("int")),
    )
    style = F.pmod(F.xxhash64("id"), F.lit(8))
    plain = F.array_join("p", "")
    camel = F.array_join(F.transform("p", lambda x: F.initcap(x)), "")
    number = F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(1000)).cast("string")
    name = (
        F.when(style == 0, F.array_join("p", "_"))
        .when(style == 1, F.array_join("p", "-"))
        .when(style == 2, camel)
        .when(style == 3, F.concat(F.array_join("p", "_"), F.lit("_"), number))
        .when(style == 4, F.upper(F.array_join("p", "_")))
        .when(style == 5, F.array_join("p", "/"))
        .when(style == 6, F.concat(F.date_add(F.lit("2000-01-01"), F.pmod(F.xxhash64(F.lit("d"), "id"), F.lit(12_000)).cast("int")), F.lit("-"), F.array_join("p", "-")))
        .otherwise(plain)
    )
    ordinary = ids.withColumn("p", picks).select("id", name.alias("token"), F.lit(0).alias("is_random"))
    return secret.union(ordinary).select("token", "is_random", F.lit(1).cast("long").alias("n"), (F.col("id") % 5).cast("int").alias("fold"))


def corpus_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``token, is_random, n, fold``: the distinct long words of all texts, which count as ordinary and each once."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.explode(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).alias("token")).distinct()
    return some.select("token", F.lit(0).alias("is_random"), F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("token"), F.lit(5)).cast("int").alias("fold"))


def _codes(token: Column) -> Column:
    """Positions of a token's characters in the alphabet, from 1; 0 for others."""
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row of the ``(1 + len(ALPHABET))`` square."""
    size = len(ALPHABET) + 1
    c = samples.filter(F.col("token").isNotNull()).withColumn("c", _codes(F.col("token")))
    pair = F.expr("zip_with(slice(c, 1, greatest(size(c) - 1, 0)), slice(c, 2, greatest(size(c) - 1, 0)), (a, b) -> struct(a, b))")
    rows = c.select("is_random", "n", F.explode(pair).alias("x")).groupBy("is_random", "x.a", "x.b").agg(F.sum("n").alias("n")).collect()
    counts = {(int(r["is_random"]), r["a"], r["b"]): r["n"] for r in rows}  # at most 2 * size * size
    return _ratios(counts, size, smoothing)


def _ratios(counts: dict, size: int, smoothing: float) -> list[float]:
    import math

    out = []
    for a in range(size):
        totals = [sum(counts.get((y, a, b), 0) for b in range(size)) + smoothing * size for y in (0, 1)]
        for b in range(size):
            p = [(counts.get((y, a, b), 0) + smoothing) / totals[y] for y in (0, 1)]
            out.append(math.log(p[1]) - math.log(p[0]))
    return out


def markov_score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair; over zero means that the random model fits better."""
    size = len(ALPHABET) + 1
    held = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    c = _codes(token)
    start = F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        c,
        start,
        lambda acc, x: F.struct(
            x.alias("p"),
            F.when(acc["p"] < 0, F.lit(0.0)).otherwise(acc["s"] + F.coalesce(F.get(held, acc["p"] * size + x), F.lit(0.0))).alias("s"),
            (acc["n"] + 1).alias("n"),
        ),
        lambda acc: F.when(acc["n"] > 1, acc["s"] / (acc["n"] - 1)).otherwise(F.lit(-1.0)),
    )


def fit_threshold(samples: DataFrame, ratios: list[float]) -> float:
    """The score that parts the samples best, with a wrong alarm counted ten times and both kinds weighed alike; the middle of the gap."""
    long = samples.filter(F.length("token") >= MIN_TOKEN)
    scored = long.select("is_random", F.round(markov_score(F.col("token"), ratios), 2).alias("s"))
    rows = scored.groupBy("s").agg(F.sum("is_random").alias("r"), F.sum(1 - F.col("is_random")).alias("o")).orderBy("s").collect()
    random, ordinary = (max(1, sum(r[k] for r in rows)) for k in ("r", "o"))
    missed, wrong, best = 0, ordinary, (float("inf"), 0.0)
    for i, r in enumerate(rows):  # one row per hundredth of score
        missed, wrong = missed + r["r"], wrong - r["o"]
        above = rows[min(i + 1, len(rows) - 1)]["s"]
        best = min(best, (missed / random + 10 * wrong / ordinary, (r["s"] + above) / 2))
    return best[1]


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, added``, arrays of ``struct<start, rank, end, kind>``.

    ``base`` holds the spans of the three patterns, ``added`` the tokens that the Markov models call random and
    that touch no base span. Null and empty texts have none; null ids and repeated rows are kept as they
    are; an empty table gives an empty result; other columns play no part. ``samples`` (``token, is_random, n, fold``) replace those
    made here; fold 0 is not used, fold 1 sets the threshold, the others train the models.
    """
    if samples is None:
        samples = labelled_samples(docs.sparkSession).union(corpus_words(docs, text_col))
    samples = materialize(samples, "samples")
    ratios = train_markov(samples.filter("fold > 1"))
    threshold = fit_threshold(samples.filter("fold = 1"), ratios)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for name, pattern in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("r", TOKEN)):
        df = with_matches(df, "t", pattern, name, SIGNS[name])
    value = f"char_length(regexp_extract(x.m, {_sql(ASSIGN)}, 2)) >= 6"
    base = F.concat(labelled("a", 0, "assign", value), labelled("k", 1, "access"), labelled("h", 2, "hex"))
    df = df.select("doc_id", base.alias("base"), "r").withColumn(
        "r",
        F.filter("r", lambda x: (markov_score(x["m"], ratios) > threshold) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))),
    )
    return df.select("doc_id", "base", labelled("r", 3, "random").alias("added"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def op9_markov_secrets(spark, sf_dir: str) -> DataFrame:
    got = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return got.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        digest(listing(F.col("base"))).alias("base_sha256"),
        listing(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
