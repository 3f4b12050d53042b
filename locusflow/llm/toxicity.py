"""Toxicity: a counterfactually regularised logistic classifier over words.

The words that part the labels best are counted over the labelled rows and, with a fixed list of identity terms, are
the features. In every labelled text that names a group the identity terms are swapped for others of their kind, and
the training objective penalises the square of the change in score between the text and its counterfactual, so that a
neutral mention of a group does not move the score. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import hash_sample, neutral, table

WORD = re.compile(rb"[a-z\x80-\xff]+")

# Identity terms by kind, in the four languages of the corpus.
IDENTITY_TERMS = (
    "women men girls boys mothers fathers wives husbands frauen männer femmes hommes mujeres hombres",
    "woman man girl boy mother father wife husband frau mann femme homme mujer hombre",
    "muslim christian jewish hindu buddhist catholic atheist sikh muslime christ jude musulman chrétien juif musulmán cristiano judío",
    "muslims christians jews hindus buddhists catholics atheists sikhs christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "black white asian african european american arab latino indian chinese mexican turkish german french spanish",
    "gay straight lesbian bisexual transgender heterosexual homosexual queer",
    "blind deaf disabled autistic sighted",
    "old young elderly teenage",
    "immigrants refugees foreigners natives migrants flüchtlinge ausländer réfugiés étrangers inmigrantes refugiados",
)

#: Bounds of what is learnt from: labelled rows (about so many, chosen by hash of the id) and words.
MAX_LABELLED = 40_000
MAX_WORDS = 1_000
MIN_ROWS = 3
#: Least z statistic of a word; noise among a million words stays below it.
MIN_Z = 5.0
FLUSH = 300_000


def words_of(text: str | None) -> set[bytes]:
    return set(WORD.findall(text.encode("utf-8", "surrogatepass").lower())) if text else set()


def held_out(id_col: str, modulus: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``modulus``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``t, y`` of about ``max_rows`` labelled rows at most, chosen by hash, outside the held-out fold; of several labels the largest counts."""
    some = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
    )
    some = hash_sample(some, F.col("_id"), max_rows)
    text = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("t"))
    return text.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("t", "y")


def choose_words(rows: DataFrame, max_words: int) -> list[bytes]:
    """The words whose presence differs most between the labels, by the two-proportion z statistic."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pd.DataFrame(
                {"w": [w.decode("utf-8", "replace") for w, _ in seen], "y": [y for _, y in seen], "n": list(seen.values())}
            )

        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                seen.update((w, y) for w in words_of(t))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    one, zero = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not one or not zero:
        return []
    c = rows.mapInPandas(count, "w string, y int, n long").groupBy("w").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum("n").alias("n")
    )
    p = F.col("n") / (one + zero)
    gap = F.col("n1") / one - (F.col("n") - F.col("n1")) / zero
    z = F.abs(gap) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / one + 1 / zero))
    top = c.withColumn("z", z).filter((F.col("n") >= MIN_ROWS) & (F.col("z") >= MIN_Z)).orderBy(F.desc("z"), "w").limit(max_words).select("w").collect()
    return [r["w"].encode() for r in top]


def counterfactual(words: set[bytes], terms: dict[bytes, bytes]) -> set[bytes]:
    """The words with every identity term swapped for the next one of its kind."""
    return {terms.get(w, w) for w in words}


def swaps() -> dict[bytes, bytes]:
    out = {}
    for kind in IDENTITY_TERMS:
        names = [w.encode() for w in kind.split()]
        out |= dict(zip(names, [*names[1:], names[0]], strict=True))
    return out


class _Sparse:
    """Rows of a 0/1 (or signed) matrix, with the two products that training needs."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, int)
        self.col = np.array([c for r in rows for c in r], dtype=np.int64)
        self.val = np.array([v for r in rows for v in r.values()], dtype=float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * r[self.row], minlength=self.width)


def fit(features: list[list[int]], y: np.ndarray, changes: list[dict[int, float]], width: int, l2: float, counter: float) -> np.ndarray:
    """Weights, the last one the bias, by Newton steps with conjugate gradients.

    Minimises the log loss plus ``l2 / 2`` of the squared weights plus ``counter / 2`` of the squared score changes that
    the counterfactual swaps cause.
    """
    x = _Sparse([{**dict.fromkeys(f, 1.0), width: 1.0} for f in features], width + 1)
    d = _Sparse(changes, width + 1)
    w = np.zeros(width + 1)
    ridge = np.full(width + 1, l2)
    ridge[-1] = 1e-3

    def loss(w):
        z = x.dot(w)
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (ridge * w * w).sum() + 0.5 * counter * (d.dot(w) ** 2).sum()

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        g = x.back(p - y) + ridge * w + counter * d.back(d.dot(w))
        if np.abs(g).max() < 1e-4 * max(1, len(y)) ** 0.5:
            break
        s = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -g
        q, rr = r.copy(), r @ r
        for _ in range(60):
            h = x.back(s * x.dot(q)) + ridge * q + counter * d.back(d.dot(q))
            a = rr / (q @ h)
            step += a * q
            r = r - a * h
            new = r @ r
            if new < 1e-8 * (g @ g):
                break
            q, rr = r + new / rr * q, new
        at, size = loss(w), 1.0
        while size > 1e-4 and loss(w + size * step) > at:
            size /= 2
        w = w + size * step
    return w


def train(rows: DataFrame, max_words: int = MAX_WORDS, l2: float = 0.02, counter: float = 5.0) -> tuple[dict[bytes, float], float]:
    """Word weights and bias. Without labels of both kinds there are no words and the bias is the smoothed rate."""
    terms = swaps()
    names = list(dict.fromkeys([*choose_words(rows, max_words), *terms]))
    index = {w: i for i, w in enumerate(names)}

    def encode(batches):
        for pdf in batches:
            out = []
            for t in pdf["t"]:
                w = words_of(t)
                here = {index[x] for x in w if x in index}
                swapped = {index[x] for x in counterfactual(w, terms) if x in index} if w & terms.keys() else here
                out.append((sorted(here), sorted(here - swapped), sorted(swapped - here)))
            got = pd.DataFrame(out, columns=["x", "gone", "new"])
            yield got.assign(y=pdf["y"].to_numpy())

    got = rows.mapInPandas(encode, "x array<int>, gone array<int>, new array<int>, y int").toPandas()  # at most MAX_LABELLED rows
    y = got["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return {}, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    changes = [
        {**dict.fromkeys(map(int, g), 1.0), **dict.fromkeys(map(int, n), -1.0)} for g, n in zip(got["gone"], got["new"], strict=True) if len(g) or len(n)
    ]
    w = fit([list(map(int, r)) for r in got["x"]], y, changes, len(names), l2, counter)
    return {n: float(v) for n, v in zip(names, w, strict=False) if v}, float(w[-1])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``keep`` columns, ``held_out``, ``score``, ``predicted``.

    Learns from about ``max_labelled`` labelled rows at most, outside the held-out fold. Null and empty texts have no words and
    get the bias alone; null ids count as '' for the fold; labels that are null, or whose id is, are left out;
    repeated rows are scored each time; an empty table gives an empty result. Other columns play no part.
    """
    weights, bias = train(labelled_rows(docs, labels, id_col, text_col, label_col, max_labelled))
    return apply_weights(docs, weights, bias, id_col, text_col, keep)


def apply_weights(docs: DataFrame, weights: dict[bytes, float], bias: float, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # at most MAX_WORDS words and the identity terms

    def score(batches):
        w, b = shared.value
        known = w.keys()
        for pdf in batches:
            z = np.array([b + sum(w[x] for x in words_of(t) & known) for t in pdf["_t_"]], dtype=float)
            yield pdf.drop(columns=["_t_"]).assign(score=1 / (1 + np.exp(-np.clip(z, -500, 500))))

    some = docs.select(F.col(id_col).alias("doc_id"), *keep, held_out(id_col).alias("held_out"), F.col(text_col).alias("_t_"))
    scored = some.mapInPandas(score, some.drop("_t_").schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject. Columns as given, whatever their names."""
    weights, bias = train(labelled_rows(docs, labels, "doc_id", "text", "toxic", MAX_LABELLED))
    kept = neutral(docs.select(*docs.columns, "doc_id", "text"))
    *carried, id_, body = kept.columns
    scored = apply_weights(kept, weights, bias, id_, body, tuple(carried))
    return scored.filter(F.col("predicted") == 0).select(*carried).toDF(*docs.columns)


def op4_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
