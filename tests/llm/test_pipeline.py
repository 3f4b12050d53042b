import collections

import pytest

import corpus_pipeline
from locusflow.llm import mixing, simhash, toxicity
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_stages_are_the_operators(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_decontamination_stage_against_brute_force(spark, docs):
    wins = brute.windows([(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    want = {r.doc_id for r in docs.collect() if not brute.contamination(r.text, wins)[4]}
    got = corpus_pipeline.decontamination(spark, docs, DIR)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def similar_pairs(rows, limit):
    """All pairs of ids whose sets of five-word shingles have a similarity of ``limit`` or more, by an inverted index."""
    sets, where = {}, collections.defaultdict(list)
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
        for x in sets[r.doc_id]:
            where[x].append(r.doc_id)
    out = []
    for a, s in sets.items():
        for b, n in collections.Counter(b for x in s for b in where[x] if b > a).items():
            if n >= limit * (len(s) + len(sets[b]) - n):
                out.append((a, b))
    return out


def test_near_duplicate_stage_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, d)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    pairs = similar_pairs(docs.collect(), 0.8)
    group = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert kept == set(group.values())
    found = [group[a] == group[b] for a, b in pairs]
    assert len(found) > 50 and sum(found) >= 0.98 * len(found)
    like = {x for p in pairs for x in p}
    assert all(a in like for a in group if a not in kept)  # nothing goes without a partner of 0.8 or more
    sets = brute.Sets(group)
    for a, b in pairs:
        sets.join(a, b)
    assert all(sets.root(a) == sets.root(g) for a, g in group.items())


def test_toxicity_stage_drops_what_the_operator_rejects(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    want = {r.doc_id for r in toxicity.score_toxicity(docs, labels).filter("predicted = 0").collect()}
    got = corpus_pipeline.toxicity(spark, docs, DIR)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_mixing_stage_draws_by_copies(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    want = {r.doc_id: r.copies for r in mixing.mixture_rates(docs, labels).collect() if r.copies}
    got = collections.Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, DIR).collect())
    assert dict(got) == want


def test_whole_run(spark, docs):
    got = corpus_pipeline.run(spark, DIR).collect()
    n = collections.Counter(r.shard for r in got)
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 1
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_an_empty_table(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0


