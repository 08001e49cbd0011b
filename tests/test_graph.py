import heapq
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from essenta.operators import graph as G

EDGES = [("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("B", "D", 3.0), ("E", "F", 2.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, weight double").cache()


def names(spark, *items):
    return spark.createDataFrame([(x,) for x in items], "node string")


def random_graph(seed, n=18, m=40):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    return [(f"n{a:02d}", f"n{b:02d}", float(rng.integers(1, 4))) for a, b in sorted(pairs)]


def adjacency(rows):
    out = {}
    for a, b, w in rows:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def test_walk_equals_power_iteration(spark, split):
    rows = random_graph(1)
    adj = adjacency(rows)
    order = sorted(adj)
    p_mat = np.array([[adj[a].get(b, 0.0) for b in order] for a in order])
    p_mat /= p_mat.sum(1, keepdims=True)
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    hubs = spark.createDataFrame([("x", order[0]), ("x", order[1]), ("y", order[2]), ("y", "absent")], "seed_set string, node string")
    got = G.random_walk(df, hubs).toPandas().pivot(index="node", columns="seed_set", values="probability").sort_index()
    for name, seeds in (("x", [0, 1]), ("y", [2])):
        start = np.zeros(len(order))
        start[seeds] = 1 / len(seeds)
        p = start.copy()
        for _ in range(1000):
            step = 0.6 * p @ p_mat + 0.4 * start
            if np.abs(step - p).sum() < 1e-9:
                break
            p = step
        assert np.allclose(got[name].to_numpy(), p, atol=2e-9) and got[name].sum() == pytest.approx(1, abs=1e-8)


def test_walk_needs_a_hub_and_fills_zero(spark, edges):
    with pytest.raises(ValueError):
        G.random_walk(edges, spark.createDataFrame([("x", "nowhere")], "seed_set string, node string"))
    got = {r.node: r.probability for r in G.random_walk(edges, spark.createDataFrame([("x", "E")], "seed_set string, node string")).collect()}
    assert got["A"] == 0.0 and got["E"] > got["F"] > 0 and len(got) == 6


def test_hop_paths(spark, edges, split):
    got = {r.node: (r.distance, r.n_paths, r.path) for r in G.hop_paths(edges, names(spark, "A")).collect()}
    assert got == {"A": (0, 1.0, "A"), "B": (1, 1.0, "A:B"), "C": (2, 1.0, "A:B:C"), "D": (2, 1.0, "A:B:D")}
    square = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    assert {r.node: r.n_paths for r in G.hop_paths(square, names(spark, "a")).collect()}["d"] == 2.0


def test_steiner_known_answers(spark, edges):
    terminals = spark.createDataFrame([(0, "A"), (0, "D"), (1, "A"), (1, "C"), (2, "A"), (2, "E"), (2, "F")], "grp int, node string")
    got = {}
    for r in G.steiner_trees(edges, terminals).collect():
        got.setdefault(r.grp, set()).add((r.src, r.dst))
    assert got == {0: {("A", "B"), ("B", "C"), ("C", "D")}, 1: {("A", "B"), ("B", "C")}, 2: {("E", "F")}}


@pytest.mark.parametrize("seed", [2, 3])
def test_steiner_trees_are_trees_within_twice_the_optimum(spark, seed):
    rows = random_graph(seed, 10, 22)
    adj = adjacency(rows)
    order = sorted(adj)
    terminals = order[:4]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    tree = {(r.src, r.dst) for r in G.steiner_trees(df, spark.createDataFrame([(0, x) for x in terminals], "grp int, node string")).collect()}

    def joined(edge_set):
        comp = {x: x for x in order}

        def find(x):
            while comp[x] != x:
                x = comp[x]
            return x

        loops = 0
        for a, b in edge_set:
            ra, rb = find(a), find(b)
            loops += ra == rb
            comp[ra] = rb
        return loops, {find(x) for x in terminals}

    loops, roots = joined(tree)
    assert loops == 0
    ends = [x for e in tree for x in e]
    assert all(x in terminals for x in ends if ends.count(x) == 1)
    if len(joined([(a, b) for a, b, _ in rows])[1]) == 1:
        assert len(roots) == 1
        cost = sum(adj[a][b] for a, b in tree)
        best = min(
            sum(w for *_, w in pick) for k in range(3, 7) for pick in itertools.combinations(rows, k)
            if len(joined([(a, b) for a, b, _ in pick])[1]) == 1)
        assert best <= cost <= 2 * best


def test_steiner_subgraph_is_seeded(spark, edges):
    a = G.steiner_subgraph(edges, names(spark, "A", "C", "D", "nowhere"), 3).collect()
    b = G.steiner_subgraph(edges, names(spark, "A", "C", "D", "nowhere"), 3).collect()
    assert sorted(a) == sorted(b)
    assert G.sample_nodes(edges, names(spark, "A", "B", "C", "D", "E"), 2, 0.7).groupBy("grp").count().toPandas()["count"].to_list() == [3, 3]


def brute_betweenness(rows, sources, targets):
    """All shortest paths by search, counted node by node."""
    adj = adjacency(rows)
    total = dict.fromkeys(adj, 0.0)
    for s in sources:
        dist = {s: 0.0}
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for v, w in adj[u].items():
                if d + w < dist.get(v, 1e18):
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))

        def paths(v):
            if v == s:
                return [[s]]
            return [p + [v] for u, w in adj[v].items() if u in dist and dist[u] + w == dist[v] for p in paths(u)]

        for t in targets:
            if t != s and t in dist:
                every = paths(t)
                for p in every:
                    for v in p[1:-1]:
                        total[v] += 1 / len(every)
    n = len(adj)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_subset_betweenness_against_all_paths(spark):
    rows = random_graph(5, 14, 30)
    order = sorted(adjacency(rows))
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = {r.node: r.betweenness for r in G.subset_betweenness(df, names(spark, *order[:4]), names(spark, *order[3:9])).collect()}
    want = brute_betweenness(rows, order[:4], order[3:9])
    assert got == pytest.approx(want)


@pytest.mark.parametrize("hub_degree", [3, 100])
def test_hop_betweenness_against_all_paths(spark, monkeypatch, hub_degree):
    monkeypatch.setattr(G, "_HUB_DEGREE", hub_degree, raising=False)
    for name in ("_SETS", "_FEWEST_SETS"):  # several passes
        monkeypatch.setattr(G, name, 2, raising=False)
    rows = [(a, b, 1.0) for a, b, _ in random_graph(5, 16, 24)] + [("n90", "n91", 1.0)]
    order = sorted(adjacency(rows))
    # twice, the other way round, a loop, a missing end: the last two are nodes too
    odd = [rows[0], (rows[1][1], rows[1][0], 1.0), ("lonely", "lonely", 1.0), (order[0], None, 1.0)]
    df = spark.createDataFrame(rows + odd, "src string, dst string, weight double")
    sources, targets = [*order[:5], "n90", "lonely", "absent"], [*order[3:9], "n91", "lonely"]
    got = {r.node: r.betweenness for r in G.subset_betweenness(df, names(spark, *sources), names(spark, *targets), None).collect()}
    n = len(order)
    want = brute_betweenness(rows, [*order[:5], "n90"], [*order[3:9], "n91"])
    assert sum(want.values()) > 0
    scaled = {k: v * (n - 1) * (n - 2) / ((n + 1) * n) for k, v in want.items()}
    assert got == pytest.approx({**scaled, "lonely": 0.0, None: 0.0})


def test_hop_betweenness_of_nothing(spark):
    loops = spark.createDataFrame([("a", "a"), ("b", "b")], "src string, dst string")
    for sources in (["a"], ["absent"]):
        got = G.subset_betweenness(loops, names(spark, *sources), names(spark, "b"), None).collect()
        assert sorted((r.node, r.betweenness) for r in got) == [("a", 0.0), ("b", 0.0)]
    assert G.subset_betweenness(loops.limit(0), names(spark, "a"), names(spark, "b"), None).collect() == []


def test_hop_betweenness_stores_no_row_per_edge_and_source(spark, monkeypatch):
    leaves = [f"l{i:03d}" for i in range(150)]
    df = spark.createDataFrame([("hub", x) for x in leaves], "src string, dst string")
    stored, cut, write = [], G.cut, G._write_level

    def seen(df):
        out = cut(df)
        stored.append(out.count())
        return out

    def written(rows, path):
        out = write(rows, path)
        stored.append(out[1])
        return out

    monkeypatch.setattr(G, "cut", seen)
    monkeypatch.setattr(G, "_write_level", written)
    got = {r.node: r.betweenness for r in G.subset_betweenness(df, names(spark, *leaves[:10]), names(spark, *leaves[20:30]), None).collect()}
    assert {k for k, v in got.items() if v} == {"hub"} and got["hub"] == pytest.approx(100 / (150 * 149))
    assert max(stored) <= 2 * len(leaves)


def test_what_a_hub_sends_is_added_up_where_its_edges_are(spark):
    leaves = [f"l{i:03d}" for i in range(150)]
    pairs = spark.createDataFrame([(x, "z") for x in leaves] + [("l000", "l001")], "a string, b string")
    held = G.SharedEdges(pairs)
    assert [r.node for r in held.hubs.collect()] == ["z"]
    assert held.table.count() == 152 and held.table.where("src = 'z'").count() == 0
    state = spark.createDataFrame([("z", 1.0), ("l000", 10.0), ("l002", 100.0)], "node string, v double")
    got = {r.node: r.v for r in held.sent(state).groupBy("node").agg(F.sum("v").alias("v")).collect()}
    assert got == {**dict.fromkeys(leaves, 1.0), "l001": 11.0, "z": 110.0}
    held.release()


def test_former_iterates_of_weighted_betweenness_are_deleted(spark, monkeypatch):
    left = []
    for hops in (4, 9):
        df = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 2.0) for i in range(hops)], "src string, dst string, weight double")
        kept, cut = [], G.cut
        with monkeypatch.context() as m:
            m.setattr(G, "cut", lambda df: kept.append(cut(df)) or kept[-1])
            got = {r.node: r.betweenness for r in G.subset_betweenness(df, names(spark, "c0"), names(spark, f"c{hops}")).collect()}
        assert sum(1 for v in got.values() if v) == hops - 1
        files = [x._jdf.queryExecution().logical().rdd().getCheckpointFile().get() for x in kept]
        left.append(sum(os.path.exists(f.removeprefix("file:")) for f in files))
    assert left[0] == left[1]


def test_interaction_helpers(spark):
    rows = spark.createDataFrame([("a", f"b{i}", 600.0 + 20 * i) for i in range(20)], "src string, dst string, score double")
    kept = G.confident_edges(rows)
    assert kept.count() == 10 and kept.agg({"score": "min"}).first()[0] == 800.0
    aliases = spark.createDataFrame([("x", "id1", 1), ("x", "id2", 2), ("y", "id3", 1)], "alias string, id string, place int")
    got = {r.name: r.id for r in G.map_names(spark.createDataFrame([("x",), ("z",)], "name string"), aliases).collect()}
    assert got == {"x": "id2", "z": None}
    assert {r.node: r.degree for r in G.degree(rows).collect()}["a"] == 20


def test_hubs_are_split_by_the_rows_of_all_groups(spark, monkeypatch):
    rows = [("hub", f"l{i:02d}", 1.0) for i in range(60)] + [("l00", "l01", 1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    kept = []

    class Seen(G.HeldEdges):
        def __init__(self, *args):
            super().__init__(*args)
            kept.append((self.hubs is not None, self.table.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]))

    monkeypatch.setattr(G, "HeldEdges", Seen)
    spark.conf.set("spark.essenta.splitRows", "100")
    try:
        sources, targets = [f"l{i:02d}" for i in range(5)], ["l07", "l08"]
        got = {r.node: r.betweenness for r in G.subset_betweenness(df, names(spark, *sources), names(spark, *targets)).collect()}
    finally:
        spark.conf.unset("spark.essenta.splitRows")
    # 60 edges of the hub meet 5 state rows each, 300 rows: above the 100 of a task
    assert kept and all(split and largest < 60 for split, largest in kept)
    assert {k for k, v in got.items() if v} == {"hub"}
    assert got["hub"] == pytest.approx(10 / (60 * 59))
