import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusflow.functions import sequences as sq
from locusflow.operators import geometry, network

FOUR = ["ATCGATCG", "ATCGTTCG", "TTCGATCG", "ATCGATCC"]
THREE = ["ATCG", "ATCC", "TTCG"]


def frame(spark, *lists):
    rows = [(n, i, s, [f"s{i}"]) for n, seqs in enumerate(lists) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "net_id long, id int, sequence string, samples array<string>")


def edges(parts, net=0):
    return sorted((r.source, r.target, r.weight) for r in network.edges_of(parts).filter(F.col("net_id") == net).collect())


def test_spanning(spark):
    parts = network.network_parts(frame(spark, FOUR, THREE), "msn")
    assert edges(parts) == [(0, 1, 1), (0, 2, 1), (0, 3, 1)] and edges(parts, 1) == [(0, 1, 1), (0, 2, 1)]


def test_parsimony(spark):
    parts = network.network_parts(frame(spark, FOUR, THREE, ["A" * 10, "A" * 9 + "C", "A" * 6 + "C" * 4, "C" * 10]), "TCS")
    assert edges(parts) == [(0, 1, 1), (1, 2, 2)] and edges(parts, 1) == [(0, 1, 1), (1, 2, 2)]
    assert edges(parts, 2) == [(0, 1, 1), (1, 2, 3), (2, 3, 6)]
    medians = network.nodes_of(parts).filter("is_median").groupBy("net_id").count().collect()
    assert {r.net_id: r["count"] for r in medians} == {0: 1, 1: 1, 2: 7}
    plain = network.network_parts(frame(spark, FOUR), "tcs", medians=False)
    assert edges(plain) == [(0, 1, 1), (1, 2, 2)] and network.nodes_of(plain).count() == 4


def test_median_joining(spark):
    same = network.network_parts(frame(spark, ["ATCGATCG", "ATCGTTCG", "TTCGTTCG"]), "mjn")
    assert edges(same) == [(0, 1, 1), (1, 2, 1)]
    star = network.network_parts(frame(spark, ["CAA", "ACA", "AAC"]), "mjn", epsilon=3)
    assert ("AAA", True) in {(r.sequence, r.is_median) for r in network.nodes_of(star).collect()}
    assert {(0, 3, 1), (1, 3, 1), (2, 3, 1)} <= set(edges(star))
    with pytest.raises(ValueError):
        network.network_parts(frame(spark, THREE), "upgma")


def test_json_and_degrees(spark):
    parts = network.network_parts(frame(spark, THREE), "msn")
    row = json.loads(network.network_json(parts).first().json)
    assert row["edges"][0] == {"source": 0, "target": 1, "weight": 1} and row["nodes"][0]["samples"] == ["s0"]
    nodes, e = network.nodes_of(parts), network.edges_of(parts)
    assert {r.id: r.degree for r in network.degrees(nodes, e).collect()} == {0: 2, 1: 1, 2: 1}
    paths = {(r.source, r.target): (r.hops, r.length) for r in network.shortest_paths(nodes, e).collect()}
    assert paths[1, 2] == (2, 2) and paths[0, 0] == (0, 0)


def test_unreachable_and_unique(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(3)], "net_id long, id int")
    e = spark.createDataFrame([(0, 1, 0, 4), (0, 0, 1, 2)], "net_id long, source int, target int, weight int")
    assert {(r.source, r.target): r.hops for r in network.shortest_paths(nodes, e).collect()}[0, 2] == -1
    assert [tuple(r) for r in network.unique_edges(e).collect()] == [(0, 0, 1, 2)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ACGT", min_size=5, max_size=5), min_size=2, max_size=9))
def test_spanning_tree_weight_is_least(spark, seqs):
    got = edges(network.network_parts(frame(spark, seqs), "msn"))
    d = network.distance_matrix(seqs)
    seen, total = {0}, 0
    while len(seen) < len(seqs):  # Prim
        w, j = min((d[i, j], j) for i in seen for j in range(len(seqs)) if j not in seen)
        seen.add(j)
        total += w
    assert sum(w for *_, w in got) == total and len(got) == len(seqs) - 1


def test_distributed_spanning_tree(spark, tmp_path):
    rng = np.random.default_rng(1)
    seqs = ["".join(x) for x in rng.choice(list("ACGT"), (14, 6))]
    h = frame(spark, seqs)
    k = iter(range(1000))

    def keep(df):
        p = str(tmp_path / str(next(k)))
        df.write.parquet(p)
        return spark.read.parquet(p)

    got = network.spanning_edges(network.pair_distances(h).select("i", "j", "d"), keep)
    assert sorted(tuple(r) for r in got.collect()) == edges(network.network_parts(h, "msn"))


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ATCGATCG", "TTTTTTTT"), ("AC", "ACGT"), ("", "A"), ("acgt", "ACGT")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(sq.char_distance(a, b)).collect()] == [6, 2, 1, 4]
    assert [r[0] for r in df.select(sq.char_distance(a, b, False)).collect()] == [6, 0, 0, 4]
    assert df.select(sq.packed_distance(sq.pack(a), sq.pack(b))).first()[0] == 6
    assert [r[0] for r in df.select(sq.pack(a)).collect()][3] == [0b11100100]
    m = spark.createDataFrame([("AAC", "ACA", "CAA"), ("AT", "CG", "GC")], "a string, b string, c string")
    got = [r[0] for r in m.select(sq.quasi_medians(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] == ["AAA"] and len(got[1]) == 9
    assert m.select(sq.median_cost(F.col("a"), F.col("b"), F.col("c"), F.lit("AAA"))).first()[0] == 3
    assert df.select(sq.intermediate(a, b, F.lit(1), F.lit(2))).first()[0] == "TTTTATCG"


def test_layout_keeps_path_lengths():
    """On random trees: near nodes lie nearer than far ones, edges are about as long as their weight, and no circles meet."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 12, 30):
        links = [(int(rng.integers(0, i)), i, int(rng.integers(1, 4))) for i in range(1, n)]
        radii = rng.uniform(0.3, 1.0, n)
        pos = geometry.stress_layout(n, links, radii)
        assert pos.shape == (n, 2) and np.allclose(pos.mean(axis=0), 0) and np.isfinite(pos).all()
        if n < 2:
            continue
        gap, want = np.linalg.norm(pos[:, None] - pos[None], axis=2), geometry.path_lengths(n, links)
        i, j = np.triu_indices(n, 1)
        assert n < 4 or np.corrcoef(gap[i, j], want[i, j])[0, 1] > 0.8
        assert (gap[i, j] > 0.5 * (radii[i] + radii[j])).mean() > 0.97
        long = [gap[a, b] - radii[a] - radii[b] for a, b, w in links if w == 3]
        short = [gap[a, b] - radii[a] - radii[b] for a, b, w in links if w == 1]
        assert not long or not short or np.mean(long) > np.mean(short)
    apart = geometry.stress_layout(4, [(0, 1, 1), (2, 3, 1)], np.full(4, 0.3))
    assert np.linalg.norm(apart[0] - apart[2]) > np.linalg.norm(apart[0] - apart[1])


def test_layout_is_stable_and_ticks_count(spark):
    parts = network.network_parts(frame(spark, FOUR), "msn")
    nodes = network.nodes_of(parts).withColumn("count", F.lit(3))
    nodes = geometry.node_radii(nodes)
    placed = geometry.layout(nodes, network.edges_of(parts))
    first, again = (sorted((r.id, r.x, r.y) for r in placed.collect()) for _ in range(2))
    assert first == again and abs(sum(x for _, x, _ in first)) < 1e-6
    ticks = geometry.edge_ticks(geometry.edge_segments(network.edges_of(parts), placed))
    assert ticks.count() == 3
    assert geometry.size_legend(nodes).count() == 0
