"""Haplotype networks: minimum spanning, statistical parsimony and median joining.

``haps(net_id, id, sequence, samples)`` holds the haplotypes of any number of networks, ids from 0 in each. Networks are
independent, so each is built in one task by numpy and many are built at once. ``spanning_edges`` is the way for one
network that is too large for a task: rounds of DataFrame joins.
"""

from __future__ import annotations

from itertools import islice, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions.sequences import MEDIAN_CAP, char_distance, state_distance

METHODS = ("tcs", "msn", "mjn")
MAX_ROUNDS = 100
PART_SCHEMA = "net_id long, kind string, id int, sequence string, is_median boolean, samples array<string>, source int, target int, weight int"


def pair_distances(haps: DataFrame, metric: str = "char") -> DataFrame:
    """``net_id, i, j, d`` of all pairs ``i < j`` of one network; ``metric`` is ``char`` or ``site``."""
    distance = char_distance if metric == "char" else state_distance
    a = haps.select("net_id", F.col("id").alias("i"), F.col("sequence").alias("a"))
    b = haps.select("net_id", F.col("id").alias("j"), F.col("sequence").alias("b"))
    return a.join(b, "net_id").filter("i < j").select("net_id", "i", "j", distance(F.col("a"), F.col("b")).alias("d"))


def _codes(sequences: list[str], metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers per sequence, filled up with zeros, and the lengths."""
    if metric == "site":
        names: dict[str, int] = {}
        rows = [np.array([names.setdefault(x, len(names) + 1) for x in s.split("|")], dtype=np.int32) for s in sequences]
    elif all(s.isascii() for s in sequences):
        rows = [np.frombuffer(s.encode(), dtype=np.uint8) for s in sequences]
    else:
        rows = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in sequences]
    size = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.zeros((len(rows), int(size.max(initial=0))), dtype=rows[0].dtype if rows else np.uint8)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, size


def distance_matrix(sequences: list[str], metric: str = "char") -> np.ndarray:
    """Differing characters plus the difference in length; or differing states of ``|``-joined haplotypes."""
    codes, size = _codes(sequences, metric)
    n = len(sequences)
    out = np.zeros((n, n), dtype=np.int64)
    even = bool((size == size[:1]).all())
    column = np.arange(codes.shape[1])
    for i in range(n - 1):
        differ = codes[i + 1 :] != codes[i]
        if not even:
            differ &= column < np.minimum(size[i + 1 :], size[i])[:, None]
        out[i, i + 1 :] = np.count_nonzero(differ, axis=1)
    if metric == "char" and not even:
        out += np.triu(np.abs(size[:, None] - size[None, :]), 1)
    return out + out.T


def _spanning(d: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges of the spanning tree that is smallest by weight, then by ends."""
    n = len(d)
    i, j = np.triu_indices(n, 1)
    w = d[i, j]
    order = np.lexsort((j, i, w))
    component, out = list(range(n)), []
    for a, b, x in zip(i[order].tolist(), j[order].tolist(), w[order].tolist(), strict=True):
        keep, gone = component[a], component[b]
        if keep != gone:
            component = [keep if c == gone else c for c in component]
            out.append((a, b, x))
            if len(out) == n - 1:
                break
    return out


def _between(a: str, b: str, total: int) -> list[str]:
    """The sequences on the way from ``a`` to ``b`` in ``total`` steps, without the ends."""
    if total < 2:
        return []
    places = [k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
    now, done, out = list(a), 0, []
    for step in range(1, total):
        upto = len(places) * step // total
        for k in places[done:upto]:
            now[k] = b[k]
        done = upto
        out.append("".join(now))
    return out


def _parsimony(d: np.ndarray, sequences: list[str], medians: bool) -> tuple[list[tuple[int, int, int]], list[str]]:
    """Edges, and the sequences of the medians: at each distance one pair of components is merged.

    The pair is that of the first haplotypes, by ``i`` and ``j``, that lie in different components; all their links of that
    distance are kept. A link of ``w`` mutations is one edge of weight ``w``; the ``w - 1`` medians of its path have no edges left.
    """
    n = len(d)
    component = np.arange(n)
    i, j = np.triu_indices(n, 1)
    w = d[i, j]
    edges, between = [], []
    for level in np.unique(w):
        at = w == level
        a, b = i[at], j[at]
        ca, cb = component[a], component[b]
        apart = ca != cb
        if not apart.any():
            continue
        a, b, ca, cb = a[apart], b[apart], ca[apart], cb[apart]
        low, high = np.minimum(ca, cb), np.maximum(ca, cb)
        first, second = low[0], high[0]
        for k in np.nonzero((low == first) & (high == second))[0]:
            u, v = (a[k], b[k]) if ca[k] < cb[k] else (b[k], a[k])
            edges.append((int(min(u, v)), int(max(u, v)), int(max(level, 1)) if medians else int(level)))
            if medians:
                between += _between(sequences[u], sequences[v], int(level))
        component = np.where(component == second, first, component - (component > second))
    return edges, between


def _char_distance(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))


def _quasi_medians(a: str, b: str, c: str) -> list[str]:
    choices = [(x,) if x in (y, z) else (y,) if y == z else (x, y, z) for x, y, z in zip(a, b, c, strict=False)]
    return sorted({"".join(p) for p in islice(product(*choices), MEDIAN_CAP + 1)})


def _median_joining(d: np.ndarray, sequences: list[str], epsilon: int) -> tuple[list[tuple[int, int, int]], list[str]]:
    """The spanning tree, and medians of neighbour triplets that cost at most ``epsilon``; each round adds the cheapest.

    Medians with fewer than three edges lose them.
    """
    weight = {(a, b): w for a, b, w in _spanning(d)}
    all_sequences, known, n = list(sequences), set(sequences), len(sequences)
    near: dict[int, list[int]] = {k: [] for k in range(n)}
    for a, b in weight:
        near[a].append(b)
        near[b].append(a)
    for _ in range(MAX_ROUNDS if epsilon > 0 else 0):
        best = None
        for u in range(len(all_sequences)):
            around = near[u]
            for x in range(len(around)):
                for y in range(x + 1, len(around)):
                    three = [all_sequences[k] for k in (u, around[x], around[y])]
                    for m in _quasi_medians(*three):
                        if m not in known:
                            cost = sum(_char_distance(s, m) for s in three)
                            if best is None or cost < best[0]:
                                best = (cost, m, (u, around[x], around[y]))
        added = best is not None and best[1] != "" and best[0] <= epsilon
        if added:
            k = len(all_sequences)
            all_sequences.append(best[1])
            known.add(best[1])
            near[k] = []
            for v in best[2]:
                w = _char_distance(best[1], all_sequences[v])
                if w > 0 and (v, k) not in weight:
                    weight[v, k] = w
                    near[k].append(v)
                    near[v].append(k)
        cut = [k for k in range(n, len(all_sequences)) if 0 < len(near[k]) < 3]
        for k in cut:
            for v in near[k]:
                weight.pop((min(v, k), max(v, k)), None)
                near[v].remove(k)
            near[k] = []
        if not added and not cut:
            break
    return [(a, b, w) for (a, b), w in weight.items()], all_sequences[n:]


def network_parts(haps: DataFrame, method: str = "tcs", epsilon: int = 0, metric: str = "char", medians: bool = True) -> DataFrame:
    """Rows of kind ``node`` and ``edge`` of every network, see ``PART_SCHEMA``.

    ``medians=False`` gives the plain variant of ``tcs``: edges weigh their distance and there are no medians. Median joining
    measures characters. Unknown methods raise.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown network method: {method}")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sequences = pdf["sequence"].tolist()
        d = distance_matrix(sequences, metric)
        if method == "tcs":
            edges, extra = _parsimony(d, sequences, medians)
        elif method == "msn":
            edges, extra = _spanning(d), []
        else:
            edges, extra = _median_joining(d, sequences, epsilon)
        n = len(sequences)
        rows = [("node", k, s, False, list(m) if m is not None else [], None, None, None) for k, (s, m) in enumerate(zip(sequences, pdf["samples"], strict=True))]
        rows += [("node", n + k, s, True, [], None, None, None) for k, s in enumerate(extra)]
        rows += [("edge", None, None, None, None, a, b, w) for a, b, w in edges]
        out = pd.DataFrame(rows, columns=["kind", "id", "sequence", "is_median", "samples", "source", "target", "weight"])
        out.insert(0, "net_id", pdf["net_id"].iloc[0])
        return out.astype({"id": "Int32", "source": "Int32", "target": "Int32", "weight": "Int32", "is_median": "boolean"})

    return haps.select(F.col("net_id").cast("long"), F.col("id").cast("int"), "sequence", "samples").groupBy("net_id").applyInPandas(build, PART_SCHEMA)


def nodes_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'node'").select("net_id", "id", "sequence", "is_median", "samples")


def edges_of(parts: DataFrame) -> DataFrame:
    return parts.filter("kind = 'edge'").select("net_id", "source", "target", "weight")


def network_json(parts: DataFrame) -> DataFrame:
    """``net_id, json`` with the nodes and edges of each network in id order."""
    node = F.when(F.col("kind") == "node", F.struct("id", "is_median", "samples", "sequence"))
    edge = F.when(F.col("kind") == "edge", F.struct("source", "target", "weight"))
    per = parts.groupBy("net_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.array_sort(F.collect_list(node)).alias("nodes"))
    return per.select("net_id", F.to_json(F.struct("edges", "nodes")).alias("json"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``net_id, id, degree``, zero for nodes without edges."""
    ends = edges.select("net_id", F.explode(F.array("source", "target")).alias("id"))
    n = ends.groupBy("net_id", "id").agg(F.count("*").cast("int").alias("degree"))
    return nodes.select("net_id", "id").join(n, ["net_id", "id"], "left").select("net_id", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def unique_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Undirected edges once each, smaller end first; of several weights the first by ``order``, else the smallest."""
    a, b = F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")
    first = F.min_by("weight", order) if order else F.min("weight")
    return edges.select("net_id", a, b, "weight", *([order] if order else [])).groupBy("net_id", "source", "target").agg(first.alias("weight"))


def shortest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``net_id, source, target, hops, length`` of all ordered pairs; -1 where no path leads."""

    def paths(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(left["id"].to_numpy())
        n = len(ids)
        far = 1 << 30
        hops = np.full((n, n), far, dtype=np.int64)
        np.fill_diagonal(hops, 0)
        length = hops.copy()
        a, b = np.searchsorted(ids, right["source"]), np.searchsorted(ids, right["target"])
        for x, y in ((a, b), (b, a)):
            hops[x, y] = 1
            np.minimum.at(length, (x, y), right["weight"].to_numpy(dtype=np.int64))
        for k in range(n):
            hops = np.minimum(hops, hops[:, k, None] + hops[None, k, :])
            length = np.minimum(length, length[:, k, None] + length[None, k, :])
        i, j = np.divmod(np.arange(n * n), max(n, 1))
        clean = lambda m: np.where(m >= far, -1, m)[i, j].astype(np.int32)
        return pd.DataFrame({"net_id": left["net_id"].iloc[0] if n else 0, "source": ids[i], "target": ids[j], "hops": clean(hops), "length": clean(length)})

    schema = "net_id long, source int, target int, hops int, length int"
    return nodes.select("net_id", "id").groupBy("net_id").cogroup(edges.toDF(*edges.columns).groupBy("net_id")).applyInPandas(paths, schema)


def spanning_edges(pairs: DataFrame, materialize) -> DataFrame:
    """The spanning forest of ``pairs(i, j, d)`` that is smallest by ``(d, i, j)``, by Boruvka rounds of joins.

    ``materialize`` writes a DataFrame where all executors can read it and reads it back; every round halves the
    components at least.
    """
    edges = pairs.select("i", "j", "d")
    labels = materialize(edges.select(F.explode(F.array("i", "j")).alias("v")).distinct().select("v", F.col("v").alias("c")))
    chosen = None
    while True:
        named = edges.join(labels.select(F.col("v").alias("i"), F.col("c").alias("ci")), "i").join(labels.select(F.col("v").alias("j"), F.col("c").alias("cj")), "j")
        across = named.filter("ci <> cj")
        key = F.struct("d", "i", "j", "ci", "cj")
        best = across.select(F.explode(F.array("ci", "cj")).alias("c"), key.alias("k")).groupBy("c").agg(F.min("k").alias("k"))
        picked = materialize(best.select("c", "k.d", "k.i", "k.j", "k.ci", "k.cj"))
        if picked.isEmpty():
            return chosen if chosen is not None else edges.limit(0)
        new = picked.select("i", "j", "d").distinct()
        chosen = new if chosen is None else chosen.union(new)
        # each component points at the one across its edge; of a pair that point at each other the smaller is the root
        up = picked.select("c", F.when(F.col("ci") == F.col("c"), F.col("cj")).otherwise(F.col("ci")).alias("p"))
        back = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = materialize(up.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        while True:
            twice = up.join(up.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
            twice = materialize(twice)
            up = twice.select("c", "p")
            if twice.filter("moved").isEmpty():
                break
        labels = materialize(labels.join(up, "c", "left").select("v", F.coalesce("p", "c").alias("c")))


def compute_network(spark, sequences: list[str], samples: list[list[str]], method: str = "tcs", epsilon: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one network given as lists. Lists of different length raise."""
    if len(sequences) != len(samples):
        raise ValueError("sequences and samples must have one length")
    rows = [(0, i, s, list(m)) for i, (s, m) in enumerate(zip(sequences, samples, strict=True))]
    haps = spark.createDataFrame(rows, "net_id long, id int, sequence string, samples array<string>")
    parts = network_parts(haps, method, epsilon)
    return nodes_of(parts).drop("net_id"), edges_of(parts).drop("net_id")


def compute_tcs_network(spark, sequences: list[str], samples: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    return compute_network(spark, sequences, samples, "tcs")


def compute_msn_network(spark, sequences: list[str], samples: list[list[str]], epsilon: int = 0) -> tuple[DataFrame, DataFrame]:
    """``epsilon`` adds no edges: once all haplotypes are connected there is nothing left to join."""
    return compute_network(spark, sequences, samples, "msn", epsilon)


def compute_mjn_network(spark, sequences: list[str], samples: list[list[str]], epsilon: int = 0) -> tuple[DataFrame, DataFrame]:
    return compute_network(spark, sequences, samples, "mjn", epsilon)
