"""The registered queries over a whole small table, against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from locusflow.llm.queries import ORACLE, QUERIES
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in rows("documents")}


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize(("name", "kinds", "added"), [("op5_weak_supervision_pii", brute.PII, {"number", "spelled", "name"}), ("op9_markov_secrets", brute.SECRETS, {"random"})])
def test_spans(spark, texts, name, kinds, added):
    got = QUERIES[name](spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.spans(texts[r.doc_id], kinds)
        assert r.base_sha256 == brute.sha(want)
        n = collections.Counter(s.split(":")[0] for s in want.split(",") if s)
        assert all(r[f"n_{k}"] == n[k] for k, _, _ in kinds)
        listed = [s for s in r.spans.split(",") if s]
        assert [s for s in listed if s.split(":")[0] not in added] == [s for s in want.split(",") if s]


def test_simhash(spark, texts):
    prints = {i: brute.fingerprint(t) for i, t in texts.items()}
    want = brute.components(prints)
    got = QUERIES["op3_simhash_tiles"](spark, DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_decontamination(spark, texts):
    wins = brute.windows([(r["item_id"], r["text"]) for r in rows("benchmark")])
    got = QUERIES["op7_ngram_decontamination"](spark, DIR).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute.contamination(t, wins) for i, t in texts.items()}


def test_sharding(spark, texts):
    source = {r["doc_id"]: r["source"] for r in rows("documents")}
    got = QUERIES["op6_stratified_shards"](spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    shards = collections.defaultdict(list)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r)
    sizes = [len(x) for x in shards.values()]
    assert set(shards) == set(range(24)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in shards.values())
    share = collections.Counter(source.values())
    for x in shards.values():  # every shard holds each source in proportion
        for s, n in collections.Counter(source[r.doc_id] for r in x).items():
            assert abs(n - share[s] * len(x) / len(texts)) < 2


def test_hmm(spark, texts):
    want = brute.unigram(texts)
    got = QUERIES["op10_hmm_scores"](spark, DIR).collect()
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the model predicts unseen texts better


def test_ann(spark):
    e = rows("embeddings")
    ids, v = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], dtype=float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in sorted(QUERIES["op2_adaptive_scan"](spark, DIR).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    assert set(got) == set(ids[ids % 50 == 0].tolist())
    hit = 0
    for i in np.nonzero(ids % 50 == 0)[0]:
        found, s = got[ids[i]], u @ u[i]
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and ids[i] not in [r.vec_id for r in found]
        assert all(math.isclose(r.score, s[ids == r.vec_id][0], rel_tol=1e-12) for r in found)
        assert sorted(found, key=lambda r: (-r.score, r.vec_id)) == found
        s[i] = -2
        hit += len(set(ids[np.lexsort((ids, -s))[:5]].tolist()) & {r.vec_id for r in found})
    assert hit >= 0.9 * 5 * len(got)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}
    got = [r for r in QUERIES["op4_counterfactual_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    yes = np.array([r.score for r in got if labels[r.doc_id]])
    no = np.array([r.score for r in got if not labels[r.doc_id]])
    assert np.mean([(no < s).mean() + (no == s).mean() / 2 for s in yes]) > 0.9
    assert (yes >= 0.5).mean() > 0.8 and (no >= 0.5).mean() < 0.02


def test_toxicity_scores_against_plain_python(spark):
    """Word choice by z, swaps and a dense Newton solution of the penalised loss; the texts name no groups, so some are put in."""
    from locusflow.llm import toxicity

    d = "/root/testdata/sf0.01"
    groups = ["", " muslims", " christians", " gay", ""]
    text = {r["doc_id"]: (r["text"] or "") + groups[r["doc_id"] % 5] for r in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    label = {}
    for r in pq.read_table(f"{d}/labels.parquet").to_pylist():
        if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["toxic"])
    learnt = [i for i in text if i in label]
    bags = {i: set(re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())) for i, t in text.items()}
    y = np.array([label[i] for i in learnt], dtype=float)
    n = collections.Counter(w for i in learnt for w in bags[i])
    n1 = collections.Counter(w for i in learnt if label[i] for w in bags[i])
    one, zero = y.sum(), len(y) - y.sum()

    def z(w):
        p = n[w] / len(y)
        return abs(n1[w] / one - (n[w] - n1[w]) / zero) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / one + 1 / zero))

    chosen = [w for w in n if n[w] >= 3 and z(w) >= 5.0]
    assert 0 < len(chosen) < 1000
    swap = {}
    for kind in toxicity.IDENTITY_TERMS:
        names = kind.encode().split()
        swap |= {names[i - 1]: names[i] for i in range(len(names))}
    names = sorted({*chosen, *swap})
    row = lambda words: np.array([*(w in words for w in names), 1], dtype=float)
    x = np.array([row(bags[i]) for i in learnt])
    change = x - np.array([row({swap.get(w, w) for w in bags[i]}) for i in learnt])
    assert change.any()
    ridge = np.array([0.02] * len(names) + [1e-3])
    w = np.zeros(len(names) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + ridge * w + 5.0 * change.T @ (change @ w)
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + np.diag(ridge) + 5.0 * change.T @ change
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 2.0 / np.abs(step).max())
    assert np.abs(g).max() < 1e-6
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert set(got) == set(text)
    want = {i: 1 / (1 + math.exp(-float(row(bags[i]) @ w))) for i in text}
    assert max(abs(got[i] - want[i]) for i in text) < 0.02


def test_mixture_meets_its_targets(spark):
    from locusflow.llm.mixing import BUDGET, TARGETS

    d = "/root/testdata/sf0.01"
    got = QUERIES["op1_soft_mixture"](spark, d).toPandas()
    p = np.array(list(got.posteriors))
    assert (got.rate >= 0).all() and len(got) == 1000 and np.allclose(p.sum(axis=1), 1)
    assert (np.array(sorted(TARGETS))[p.argmax(axis=1)] == got.domain).all()
    expected = (got.rate * got.n_tokens).to_numpy() @ p / (BUDGET * got.n_tokens.sum())
    assert np.allclose(expected, [TARGETS[k] for k in sorted(TARGETS)], atol=1e-5)
    assert abs((got.copies * got.n_tokens).sum() / (got.rate * got.n_tokens).sum() - 1) < 0.05


def test_mixture_posteriors_and_rates_against_plain_python(spark):
    """Counts of words by domain, Bayes' rule and a long projected gradient, on a table that is read whole."""
    from locusflow.llm.mixing import BUCKETS, EVIDENCE, TARGETS

    quality = collections.defaultdict(int)
    for r in rows("labels"):
        quality[r["doc_id"]] = max(quality.get(r["doc_id"], 0), r["quality"])
    domains = sorted(TARGETS)
    n, c = np.full(len(domains), 0.5), np.full((len(domains), BUCKETS), 0.5)
    docs = rows("documents")
    hashed = {r["doc_id"]: [zlib.crc32(w) % BUCKETS for w in (r["text"] or "").encode().lower().split()] for r in docs}
    for r in docs:
        if r["doc_id"] in quality and (k := f"{r['lang']}:{quality[r['doc_id']]}") in domains:
            n[domains.index(k)] += 1
            for x in hashed[r["doc_id"]]:
                c[domains.index(k), x] += 1
    log_p, prior = np.log(c / c.sum(axis=1, keepdims=True)), np.log(n / n.sum())
    for r in QUERIES["op1_soft_mixture"](spark, DIR).collect():
        x = hashed[r.doc_id]
        z = prior + (log_p[:, x].sum(axis=1) * min(1.0, EVIDENCE / len(x)) if x else 0)
        want = np.exp(z - z.max())
        assert r.n_tokens == len(x) and np.allclose(r.posteriors, want / want.sum())


def test_fuzzy_lines(spark, texts):
    from locusflow.llm.line_dedup import normal_lines

    first, occurrences = {}, []
    for d in sorted(texts):
        for n, x in normal_lines(texts[d]):
            occurrences.append((d, n, x))
            first.setdefault(x, (d, n))
    lines = list(first)
    sets = brute.Sets(range(len(lines)))
    for i, j in brute.near_lines(lines):
        sets.join(i, j)
    best, at = {}, {x: i for i, x in enumerate(lines)}
    for i, x in enumerate(lines):
        best[sets.root(i)] = min(best.get(sets.root(i), first[x]), first[x])
    want = collections.defaultdict(list)
    for d, n, x in occurrences:
        if best[sets.root(at[x])] != (d, n):
            want[d].append(n)
    got = {r.doc_id: [int(n) for n in r.removed.split(",") if n] for r in QUERIES["op8_fuzzy_lines"](spark, DIR).collect()}
    assert set(got) == set(texts)
    gone, found = ({(d, n) for d, ns in x.items() for n in ns} for x in (want, got))
    assert len(gone & found) >= 0.98 * len(gone) and len(found - gone) <= 0.02 * len(found)
