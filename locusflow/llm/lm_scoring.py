"""Language-model scoring with a hidden Markov model.

Words are counted over all training texts. The most frequent words are symbols of their own, ``symbols`` of them at least and
more with the vocabulary, as the root of its size; every other word belongs to one of eight shape classes, which are symbols
too, and has add-one probability within its class. A hidden Markov model over these symbols is trained by Baum-Welch: each
round's expected counts are computed per partition over all training texts, summed by Spark and normalised on the driver
(``states * symbols`` numbers). Every round's log-likelihood is kept in the model's ``trace``.
Texts are scored by the scaled forward recursion, exactly: long texts are cut into chunks whose transfer matrices are
multiplied, which gives the same likelihood as one pass over the text.

The most frequent words, ``head`` at most, travel to every task; what the remaining words need is
joined by word, so that no word's rows are many.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import materialize, table

N_CLASSES = 8
#: Own symbols for each unit of the root of the number of distinct words.
GROWTH = 4
CHUNK = 256
#: Chunks that are worked on together; bounds the memory of a task whatever the texts' lengths.
GROUP = 512
#: Distinct words that a counting task holds at most, and about how many characters they may have together.
FLUSH, FLUSH_CHARS = 600_000, 32 << 20
#: Words that a counting task hands over at once at most, and characters after which none is added.
PIECE, PIECE_CHARS = 50_000, 4 << 20
#: About how many bytes of text are encoded at once; encoding takes some ten times that.
SLICE_BYTES = 2 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; ``bytes.split`` and ``bytes.lower`` know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ENDS = frozenset(b".,;:!?")
_DIGIT = re.compile(rb"[0-9]").search


def shape_class(word: bytes) -> int:
    """Whether a word ends in punctuation (1), has a character beyond ASCII (2), has a digit (4)."""
    return (word != b"" and word[-1] in _ENDS) + 2 * (not word.isascii()) + 4 * (_DIGIT(word) is not None)


def _shape_column(word: Column) -> Column:
    return (
        word.rlike("[.,;:!?]$").cast("int") + 2 * word.rlike(r"[^\x00-\x7F]").cast("int") + 4 * word.rlike("[0-9]").cast("int")
    )


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over column ``t``; the end of a text counts as the word ''."""

    def count(batches):
        seen: Counter = Counter()
        chars = 0  # the words held have no more than this

        def out():
            """What is held, a piece at a time: on its way to the JVM a piece takes several times its words' memory."""
            words, n, size = [], [], 0
            while seen:
                w, c = seen.popitem()
                words.append(w.decode("utf-8", "replace"))
                n.append(c)
                size += len(w)
                if len(words) == PIECE or size > PIECE_CHARS or not seen:
                    yield pd.DataFrame({"word": words, "n": n})
                    words, n, size = [], [], 0

        for pdf in batches:
            for t in pdf["t"]:
                seen.update(tokens(t))
                seen[b""] += 1
                chars += len(t or "")
                full = len(seen) > FLUSH
                if chars > FLUSH_CHARS:
                    chars = sum(map(len, seen))
                    full = full or chars > FLUSH_CHARS // 2
                if full:
                    yield from out()
                    chars = 0
        yield from out()

    return texts.select("t").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words, their symbols, log10 of count + 1; and each class's log10 denominator.

    Symbols from ``own`` on are classes; ``dtype`` names the integers that hold a symbol.
    """

    words: list[str]
    symbol: np.ndarray
    log_count: np.ndarray
    log_class: np.ndarray
    symbol_counts: np.ndarray
    total: int
    distinct: int
    own: int
    dtype: str


def vocabulary(counts: DataFrame, head: int, symbols: int) -> Vocabulary:
    # the least count of a head word, from how many words have each count: no task has to rank all words
    at_least, seen = 1, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        seen += r["n"]
        if seen > head:
            at_least = r["c"] + 1
            break
    top = counts.filter(F.col("c") >= at_least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    c = top["c"].to_numpy(dtype=np.int64)
    names = [w.encode() for w in top["word"]]
    rows = counts.groupBy(_shape_column(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(N_CLASSES), np.zeros(N_CLASSES)
    for r in rows:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    total, distinct = int(n.sum()), int(v.sum())
    slots = max(symbols, min(head, GROWTH * math.isqrt(distinct)))
    own, dtype = min(slots, len(names)), "<i2" if slots + N_CLASSES < 1 << 15 else "<i4"
    symbol = np.array([i if i < own else slots + shape_class(w) for i, w in enumerate(names)], dtype=dtype)
    for w, x in zip(names[:own], c[:own], strict=True):
        n[shape_class(w)] -= x
        v[shape_class(w)] -= 1
    each = np.zeros(slots + N_CLASSES)
    each[:own], each[slots:] = c[:own], n
    return Vocabulary(top["word"].tolist(), symbol, np.log10(c + 1.0), np.log10(n + v + 1), each, total, distinct, slots, dtype)


def token_lists(texts: pa.Array) -> pa.Array:
    """``tokens`` of each text, as strings and with '' for the text's end: all of a batch without a Python object for each."""
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), none)))
    # splitting leaves one '' after a last space, and of an empty text
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(t, none), none, pc.binary_join_element_wise(t, none, space)))


def encode(docs: DataFrame, shared, n_own: int) -> DataFrame:
    """Each text's symbols, its sums over frequent words, and its other words for the join."""

    def run(batches):
        names, symbol, log_count, log_class = shared.value
        names = pa.array(names, pa.large_string())
        # the last entry is for words that are not there; their symbols are replaced below
        symbol, log_count = np.append(symbol, np.zeros(1, symbol.dtype)), np.append(log_count, 0.0)
        for pdf in batches:
            texts = pa.array(pdf["t"], pa.large_string(), from_pandas=True)
            step = max(1, len(pdf) * SLICE_BYTES // max(1, texts.nbytes))
            for at in range(0, len(pdf), step):
                lists = token_lists(texts[at : at + step])
                n = pc.list_value_length(lists).to_numpy().astype(np.int64)
                words, begin = lists.flatten(), np.cumsum(n) - n  # no text is without tokens
                ids = pc.fill_null(pc.index_in(words, names), -1).to_numpy()
                known = ids >= 0
                sym, logs = symbol[ids], log_count[ids]
                rest = words.filter(pa.array(~known)).to_pylist()
                sym[~known] = [n_own + shape_class(w.encode("utf-8", "surrogatepass")) for w in rest]
                classed = np.where(sym >= n_own, logs, 0.0)
                classed[sym >= n_own] -= log_class[sym[sym >= n_own] - n_own]
                head = np.add.reduceat(known.astype(np.int64), begin)
                ends = np.cumsum(n - head)
                out = {
                    "n_tokens": n,
                    "head_known": head,
                    "head_log": np.add.reduceat(logs, begin),
                    "class_log": np.add.reduceat(classed, begin),
                    "sym": [sym[i : i + k].tobytes() for i, k in zip(begin.tolist(), n.tolist(), strict=True)],
                    "rest": [" ".join(rest[j - k : j]) for j, k in zip(ends.tolist(), (n - head).tolist(), strict=True)],
                }
                yield pdf[["doc_id", "held_out"]].iloc[at : at + step].assign(**out)
        pa.default_memory_pool().release_unused()  # the worker lives on and would keep it

    schema = "doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, class_log double, sym binary, rest string"
    return docs.mapInPandas(run, schema)


@dataclass
class Hmm:
    """``start`` is the state before the first symbol; ``trans[i, j]``; ``emit[s, j]``."""

    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray
    trace: list[float] = field(default_factory=list)

    @staticmethod
    def initial(states: int, unigram: np.ndarray, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.lognormal(0.0, 0.7, (len(unigram), states))
        trans = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Hmm(np.full(states, 1 / states), trans, emit / emit.sum(axis=0))


class _Batch:
    """Texts cut into chunks; chunks sorted by length so that a step works on a leading slice."""

    def __init__(self, seqs: list[np.ndarray]):
        self.flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int16)
        lengths = np.array([len(s) for s in seqs], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if seqs else lengths
        per = -(-lengths // CHUNK)
        self.doc = np.repeat(np.arange(len(seqs)), per)
        self.part = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        self.begin = offsets[self.doc] + self.part * CHUNK
        self.length = np.minimum(CHUNK, lengths[self.doc] - self.part * CHUNK)
        self.first = np.cumsum(per) - per
        self.per = per

    def groups(self, which: np.ndarray):
        order = which[np.argsort(-self.length[which], kind="stable")]
        for i in range(0, len(order), GROUP):
            g = order[i : i + GROUP]
            n = self.length[g]
            active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
            idx = np.minimum(self.begin[g][None, :] + np.arange(n[0])[:, None], len(self.flat) - 1)
            yield g, n, active, self.flat[idx]


def _transfer(batch: _Batch, hmm: Hmm, which: np.ndarray) -> np.ndarray:
    """Transfer matrices of chunks ``which``, each scaled to a largest entry of 1."""
    k = len(hmm.start)
    out = np.zeros((len(batch.doc), k, k))
    for g, _, active, obs in batch.groups(which):
        m = np.tile(np.eye(k), (len(g), 1, 1))
        for t, a in enumerate(active):
            m[:a] = (m[:a].reshape(a * k, k) @ hmm.trans).reshape(a, k, k) * hmm.emit[obs[t, :a]][:, None, :]
            if t % 16 == 15:
                m[:a] /= m[:a].max(axis=(1, 2), keepdims=True)
        out[g] = m / m.max(axis=(1, 2), keepdims=True)
    return out


def _edges(batch: _Batch, hmm: Hmm, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """State weights before each chunk and, if asked, the weights of what follows it."""
    k, n = len(hmm.start), len(batch.doc)
    before, after, one = np.tile(hmm.start, (n, 1)), np.ones((n, k)), np.ones(k)
    long = np.nonzero(batch.per > 1)[0]
    if len(long):
        m = _transfer(batch, hmm, np.nonzero(batch.per[batch.doc] > 1)[0])
        for j in range(1, int(batch.per.max())):
            at = batch.first[long[batch.per[long] > j]] + j
            x = (before[at - 1][:, None, :] @ m[at - 1])[:, 0, :]
            before[at] = x / (x @ one)[:, None]
        for j in range(int(batch.per.max()) - 2, -1, -1) if backward else ():
            at = batch.first[long[batch.per[long] > j + 1]] + j
            x = (m[at + 1] @ after[at + 1][:, :, None])[:, :, 0]
            after[at] = x / (x @ one)[:, None]
    return before, after


def log_likelihoods(seqs: list[np.ndarray], hmm: Hmm) -> np.ndarray:
    """Natural log-likelihood of each sequence."""
    batch = _Batch(seqs)
    out, one = np.zeros(len(seqs)), np.ones(len(hmm.start))
    before, _ = _edges(batch, hmm, False)
    for g, lengths, active, obs in batch.groups(np.arange(len(batch.doc))):
        a, scale = before[g], np.ones(obs.shape)
        for t, n in enumerate(active):
            x = (a[:n] @ hmm.trans) * hmm.emit[obs[t, :n]]
            c = x @ one
            a[:n] = x / c[:, None]
            scale[t, :n] = c
        np.add.at(out, batch.doc[g], np.log(scale).sum(axis=0))
    return out


def expected_counts(seqs: list[np.ndarray], hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected start states, transitions and emissions, and the log-likelihood.

    Backward weights are scaled to a product of 1 with the forward weights at each chunk's end; the forward scales then
    keep it at 1 throughout, so the products are the state probabilities themselves.
    """
    batch = _Batch(seqs)
    k, s = len(hmm.start), len(hmm.emit)
    one, back = np.ones(k), np.ascontiguousarray(hmm.trans.T)
    start, trans, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((s, k)), 0.0
    before, after = _edges(batch, hmm, True)
    for g, lengths, active, obs in batch.groups(np.arange(len(batch.doc))):
        steps = len(active)
        a, scale = np.zeros((steps + 1, len(g), k)), np.ones((steps, len(g)))
        a[0] = before[g]
        seen = hmm.emit[obs]
        for t, n in enumerate(active):
            x = (a[t, :n] @ hmm.trans) * seen[t, :n]
            c = x @ one
            scale[t, :n] = c
            a[t + 1, :n] = x / c[:, None]
        total += float(np.log(scale).sum())
        seen /= scale[:, :, None]
        b = after[g]
        b /= ((a[lengths, np.arange(len(g))] * b) @ one)[:, None]
        for t in range(steps - 1, -1, -1):
            n = active[t]
            x = seen[t, :n] * b[:n]
            a[t + 1, :n] *= b[:n]
            trans += a[t, :n].T @ x
            b[:n] = x @ back
        live = np.arange(steps)[:, None] < lengths[None, :]
        symbol, weight = obs[live], a[1:][live]
        for j in range(k):
            emit[:, j] += np.bincount(symbol, weights=weight[:, j], minlength=s)
        heads = batch.part[g] == 0
        start += (a[0][heads] * b[heads]).sum(axis=0)
    return start, trans * hmm.trans, emit, total


def _parts(blobs, dtype: str, most: int = 400_000):
    """Runs of texts with about ``most`` symbols together."""
    run, size = [], 0
    for blob in blobs:
        x = np.frombuffer(blob, dtype=dtype).astype(np.int64)
        run.append(x)
        size += len(x)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def train_hmm(encoded: DataFrame, states: int, symbol_counts: np.ndarray, rounds: int, gain: float, dtype: str) -> Hmm:
    """Baum-Welch over all rows of ``encoded``; without rows a uniform model.

    It ends with the round that began with less than ``gain`` nats a token above the one before, or after ``rounds``. ``trace`` holds the natural log-likelihood of all rows under the model that each round began with.
    """
    spark, n_symbols = encoded.sparkSession, len(symbol_counts)
    n_all = states + states * states + n_symbols * states

    def summed(partial) -> dict[int, float]:
        got = encoded.select("sym").mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        pdf = got.toPandas()  # one row per parameter
        return dict(zip(pdf["i"].tolist(), pdf["v"].tolist(), strict=True))

    unigram = (symbol_counts + 0.1) / (symbol_counts + 0.1).sum()
    enough = gain * symbol_counts.sum()
    hmm = Hmm.initial(states, unigram)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((hmm.start, hmm.trans, hmm.emit))

        def expect(batches, held=held):
            model, acc = Hmm(*held.value), None
            for pdf in batches:
                for run in _parts(pdf["sym"], dtype):
                    got = expected_counts(run, model)
                    acc = got if acc is None else tuple(x + y for x, y in zip(acc, got, strict=True))
            if acc is not None:
                v = np.concatenate([np.ravel(x) for x in acc])
                i = np.nonzero(v)[0]
                yield pd.DataFrame({"i": i.astype(np.int32), "v": v[i]})

        flat = np.zeros(n_all + 1)
        for i, v in summed(expect).items():
            flat[i] = v
        start, trans, emit, (total,) = np.split(flat, [states, states + states * states, n_all])
        trans = trans.reshape(states, states) + 0.1
        emit = emit.reshape(n_symbols, states) + unigram[:, None]  # one expected symbol a state as prior
        start = start + 0.1
        hmm = Hmm(start / start.sum(), trans / trans.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), [*hmm.trace, float(total)])
        held.unpersist()
        if len(hmm.trace) > 1 and hmm.trace[-1] - hmm.trace[-2] < enough:
            break
    return hmm


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    states: int = 6,
    symbols: int = 4000,
    head: int = 131_072,
    rounds: int = 8,
    gain: float = 0.01,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows that are not held out. A null or empty text is one token, its end; null ids
    count as '' for the fold; repeated rows are scored, and learnt from, each time; an empty table gives
    an empty result; without training rows every count is 0. Other columns play no part. Ids are longs.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), held_out(id_col, modulus, remainder).alias("held_out"))
    counts = materialize(word_counts(base.filter(~F.col("held_out"))), "counts")
    vocab = vocabulary(counts, head, symbols)
    shared = spark.sparkContext.broadcast((vocab.words, vocab.symbol, vocab.log_count, vocab.log_class))
    encoded = materialize(encode(base, shared, vocab.own).withColumn("rid", F.monotonically_increasing_id()), "encoded")
    rest = encoded.filter(F.col("rest") != "").select("rid", F.explode(F.split("rest", " ")).alias("word"))
    rest = (
        rest.join(counts, "word")
        .groupBy("rid")
        .agg(F.sum(F.log10(F.col("c") + 1.0)).alias("rest_log"), F.count("*").alias("rest_known"))
    )
    hmm = train_hmm(encoded.filter(~F.col("held_out")), states, vocab.symbol_counts, rounds, gain, vocab.dtype)
    model, dtype = spark.sparkContext.broadcast((hmm.start, hmm.trans, hmm.emit)), vocab.dtype

    def forward(batches):
        trained = Hmm(*model.value)
        for pdf in batches:
            logs = [log_likelihoods(run, trained) for run in _parts(pdf["sym"], dtype)]
            yield pdf.drop(columns=["sym"]).assign(log_p=reduce(lambda a, b: np.concatenate([a, b]), logs, np.zeros(0)) / np.log(10))

    columns = "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, class_log double"
    scored = encoded.select(*[c.split()[0] for c in columns.split(", ")], "sym").mapInPandas(forward, columns + ", log_p double")
    denominator = float(np.log10(vocab.total + vocab.distinct + 1.0))
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rest_log - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("log_p") + F.col("class_log") + rest_log).alias("score"),
    )


def op10_hmm_scores(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
