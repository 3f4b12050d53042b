"""Mixing to target weights with soft memberships.

A naive Bayes classifier over hashed words is counted from the labelled rows and gives every text a posterior over domains
(language and quality). Nonnegative rates ``r`` per document are then fitted so that the expected domain tokens
``sum(r * tokens * posterior)`` meet the targets, by projected gradient descent on the squared distance, with a faint pull of all
rates to 1 that makes the solution unique. The descent projects late, as in dual averaging: what is kept is the
sum of the steps, by domain, and the rates are its projection ``max(0, 1 - posterior @ step)``. The gradient is scaled by the
second moments of the documents whose rate is not 0, and a step is only taken if it lowers the objective enough. So a
document's rate depends on its posterior and ``D`` numbers alone, and a round costs two distributed sums of ``D * D``.
"""

from __future__ import annotations

import warnings
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from locusflow.llm._common import hash_sample, materialize, neutral, table

#: Hash buckets of words, and labelled rows that are learnt from (about so many, chosen by hash of the id).
BUCKETS = 1 << 14
MAX_LABELLED = 40_000
#: A text's evidence counts as that of this many words at most, so that posteriors stay soft.
EVIDENCE = 25.0

# Target shares of the token budget by language and quality label, and the budget as a share of all tokens.
TARGETS = {
    "en:1": 0.50, "de:1": 0.16, "fr:1": 0.16, "es:1": 0.12,
    "en:0": 0.03, "de:0": 0.01, "fr:0": 0.01, "es:0": 0.01,
}
BUDGET = 1.1


def buckets_of(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    crc = zlib.crc32
    return np.array([crc(w) for w in words], dtype=np.int64) & (BUCKETS - 1)


def labelled_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """``t, domain`` of about ``max_rows`` labelled rows at most: the row's language and its largest quality label."""
    some = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("quality").alias("q"))
    )
    some = hash_sample(some, F.col("_id"), max_rows)
    text = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("t"), F.col("lang").alias("l"))
    joined = text.join(F.broadcast(some), F.col("_doc") == F.col("_id")).filter(F.col("l").isNotNull())
    return joined.select("t", F.concat_ws(":", "l", F.col("q").cast("string")).alias("domain"))


def train_domains(rows: DataFrame, domains: list[str], smoothing: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of buckets by domain and log priors; domains without rows keep the smoothed values."""
    index = {d: i for i, d in enumerate(domains)}

    def count(batches):
        c, n = np.zeros((len(domains), BUCKETS)), np.zeros(len(domains))
        for pdf in batches:
            for t, d in zip(pdf["t"], pdf["domain"], strict=True):
                if d in index:
                    n[index[d]] += 1
                    c[index[d]] += np.bincount(buckets_of(t), minlength=BUCKETS)
        flat = np.concatenate([n, c.ravel()])
        i = np.nonzero(flat)[0]
        yield pd.DataFrame({"i": i.astype(np.int32), "v": flat[i]})

    got = rows.mapInPandas(count, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # one row per parameter
    flat = np.zeros(len(domains) * (1 + BUCKETS))
    flat[got["i"].to_numpy(dtype=np.int64)] = got["v"]
    n, c = flat[: len(domains)] + smoothing, flat[len(domains) :].reshape(len(domains), BUCKETS) + smoothing
    return np.log(c / c.sum(axis=1, keepdims=True)), np.log(n / n.sum())


def posteriors(docs: DataFrame, columns: list[str], text_col: str, log_p: np.ndarray, log_prior: np.ndarray) -> DataFrame:
    """``columns``, ``n_tokens`` and ``p``, the posterior over domains; a text without words has the prior."""
    some = docs.select(*columns, F.col(text_col).alias("_t_"))
    held = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(log_p.T), log_prior))

    def run(batches):
        by_bucket, prior = held.value
        for pdf in batches:
            n, p = [], []
            for t in pdf["_t_"]:
                b = buckets_of(t)
                z = prior.copy()
                if len(b):
                    z += by_bucket[b].sum(axis=0) * (min(len(b), EVIDENCE) / len(b))
                z = np.exp(z - z.max())
                n.append(len(b))
                p.append(z / z.sum())
            yield pdf.drop(columns=["_t_"]).assign(n_tokens=np.array(n, dtype=np.int64), p=p)

    return some.mapInPandas(run, some.drop("_t_").schema.add("n_tokens", "long").add("p", ArrayType(DoubleType())))


def rates(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The rates after the projected step ``u`` from rate 1."""
    return np.maximum(0.0, 1 - p @ u)


@dataclass
class Fit:
    """The step; the expected domain tokens reached and wanted, as shares of all tokens; whether the descent settled."""

    step: np.ndarray
    have: np.ndarray
    goal: np.ndarray
    settled: bool


#: Weight of the distance from rate 1; what a domain may be off, in shares of all tokens, for the descent to be settled.
PULL = 1e-7
TOLERANCE = 1e-8
#: Step sizes that one pass tries.
SIZES = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4)


def descend(passed, shares: np.ndarray, budget: float, rounds: int = 100) -> Fit:
    """Projected descent; ``passed(f)`` sums the vectors ``f(p, tokens)`` over all documents.

    Least is ``|have - goal|^2 + PULL * sum(t * (r - 1)^2)``, all in shares of the tokens. At its minimum the rates are the
    projected step ``max(0, 1 - p @ u)`` with ``PULL * u = have - goal``, and ``u`` is where the convex function ``height`` is least.
    """
    d = len(shares)
    total = passed(lambda p, t: t.sum(keepdims=True))[0]
    goal, u = shares / shares.sum() * budget, np.zeros(d)

    def heights(us: list[np.ndarray]) -> np.ndarray:
        got = passed(lambda p, t: np.array([(t * rates(p, x) ** 2).sum() for x in us])) / total
        return np.array([0.5 * h + x @ goal + 0.5 * PULL * (x @ x) for h, x in zip(got, us, strict=True)])

    for _ in range(rounds):

        def moments(p, t, u=u):
            r = rates(p, u)
            return np.concatenate([(t * r) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel(), ((t * r * r).sum(keepdims=True))])

        got = passed(moments) / total
        have, metric, here = got[:d], got[d:-1].reshape(d, d), 0.5 * got[-1] + u @ goal + 0.5 * PULL * (u @ u)
        fall = have - goal - PULL * u
        if np.abs(fall).max() <= TOLERANCE:
            return Fit(u, have, goal, True)
        step = np.linalg.solve(metric + PULL * np.eye(d), fall)
        tried = [u + s * step for s in SIZES]
        fair = np.nonzero(heights(tried) <= here - 1e-4 * np.array(SIZES) * (fall @ step) + 1e-15 * abs(here))[0]
        if not len(fair):
            return Fit(u, have, goal, False)
        u = tried[fair[0]]
    return Fit(u, have, goal, False)


def fit_rates(soft: DataFrame, targets: np.ndarray, budget: float, rounds: int = 100) -> Fit:
    """The step that brings the expected domain tokens to ``targets * budget * all tokens``; warns if it did not settle."""
    narrow = soft.select("n_tokens", "p")

    def passed(f) -> np.ndarray:
        def run(batches):
            acc = None
            for pdf in batches:
                if len(pdf):
                    got = f(np.array(list(pdf["p"])), pdf["n_tokens"].to_numpy(dtype=float))
                    acc = got if acc is None else acc + got
            if acc is not None:
                yield pd.DataFrame({"i": np.arange(len(acc), dtype=np.int32), "v": acc})

        rows = narrow.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # some D * D numbers
        return np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows)])

    if narrow.filter("n_tokens > 0").isEmpty():
        return Fit(np.zeros(len(targets)), np.zeros(len(targets)), np.zeros(len(targets)), True)
    fit = descend(passed, targets, budget, rounds)
    if not fit.settled:
        warnings.warn(f"rates did not settle: domains are {fit.have - fit.goal} of all tokens off their targets", stacklevel=2)
    return fit


def mixture_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    budget: float = BUDGET,
    columns: tuple[str, ...] = ("doc_id",),
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: ``columns``, ``n_tokens, domain, posterior, posteriors, rate, copies``.

    ``posteriors`` are those of all domains in order of their names, ``domain`` and ``posterior`` the largest. ``copies`` rounds ``rate`` up or down by a seeded hash of the id, so that its mean is the rate. Null and empty texts have
    no tokens, the prior as posterior, and a rate like any other; repeated rows get equal rates; a row without id
    rounds like any other value; targets that no document can serve are approached as far as the rates allow; an empty
    table gives an empty result. Other columns play no part.
    """
    domains = sorted(targets)
    log_p, prior = train_domains(labelled_domains(docs, labels), domains)
    kept = neutral(docs.select(*columns, "doc_id", "text"))
    *carried, id_, body = kept.columns
    some = kept.withColumn("_key_", F.coalesce(F.col(id_).cast("string"), F.lit("null")))
    soft = materialize(posteriors(some, [*carried, "_key_"], body, log_p, prior), "posteriors")
    step = fit_rates(soft, np.array([targets[d] for d in domains]), budget).step
    names = np.array(domains)

    def run(batches):
        for pdf in batches:
            p = np.array(list(pdf["p"])).reshape(len(pdf), len(names))
            best = p.argmax(axis=1)
            yield pdf.assign(domain=names[best], posterior=p[np.arange(len(p)), best], rate=rates(p, step))

    out = soft.mapInPandas(run, StructType([*soft.schema.fields]).add("domain", "string").add("posterior", "double").add("rate", "double"))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("_key_")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")
    made = out.select(*carried, "n_tokens", "domain", "posterior", F.col("p").alias("posteriors"), "rate", copies.cast("int").alias("copies"))
    return made.toDF(*columns, *made.columns[len(carried) :])


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` drawn at the fitted rates: each row as often as its ``copies`` say. Columns as given, whatever their names.

    Null and empty texts are drawn by the rate that the prior gets; rows without id, and rows that share one, round alike; repeated
    rows are each drawn; an empty table gives an empty result.
    """
    got = neutral(mixture_rates(docs, labels, columns=tuple(docs.columns), **options))
    copies = got.columns[-1]
    drawn = got.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies))))
    return drawn.select(*got.columns[: len(docs.columns)]).toDF(*docs.columns)


def op1_soft_mixture(spark, sf_dir: str) -> DataFrame:
    return mixture_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=("doc_id", "source", "lang"))
