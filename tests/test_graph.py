import collections
import itertools
import os
import random

import pytest

from tidewheel.operators import graph


def pairs(spark, edges):
    return spark.createDataFrame([tuple(sorted(map(str, e))) for e in edges], "a string, b string")


def of(df, value):
    return {r["node_id"]: r[value] for r in df.collect()}


def test_local_metrics_triangle_with_tail(spark):
    m = graph.local_metrics(pairs(spark, ["AB", "BC", "AC", "CD", "EE"]), [])
    assert of(m, "degree") == {"A": 2, "B": 2, "C": 3, "D": 1, "E": 0}
    assert of(m, "clustering") == pytest.approx({"A": 1, "B": 1, "C": 1 / 3, "D": 0, "E": 0})
    assert of(m, "effective_size") == pytest.approx({"A": 1, "B": 1, "C": 3 - 2 / 3, "D": 1, "E": 0})
    c = of(m, "network_constraint")
    assert c["D"] == pytest.approx(1.0) and c["E"] is None
    assert c["A"] == pytest.approx((1 / 2 + 1 / 2 * 1 / 3) ** 2 + (1 / 2 + 1 / 2 * 1 / 2) ** 2)
    assert of(m, "degree_centrality")["C"] == pytest.approx(3 / 4)


def test_pagerank_and_eigenvector_star(spark):
    star = pairs(spark, ["AB", "AC", "AD"])
    pr = of(graph.pagerank(star, [], iterations=24), "pagerank")
    assert sum(pr.values()) == pytest.approx(1)
    leaf = (0.15 / 4 + 0.85 * pr["A"] / 3)
    assert pr["B"] == pytest.approx(leaf, abs=5e-3)
    ev = of(graph.eigenvector(star, [], iterations=24), "eigenvector_centrality")
    assert ev["A"] == pytest.approx(1) and ev["B"] == pytest.approx(3**-0.5, abs=1e-4)


def test_paths(spark):
    path = pairs(spark, ["AB", "BC", "CD", "XY"])
    c = of(graph.closeness(path), "closeness")
    assert c["A"] == pytest.approx(3 / 6 * 3 / 5) and c["X"] == pytest.approx(1 * 1 / 5)
    b = of(graph.betweenness(path), "betweenness")
    assert b["B"] == pytest.approx(2 / ((5 * 4) / 2)) and b["A"] == 0
    with pytest.raises(ValueError):
        graph.closeness(path, limit=3)


def test_yearly_pairs_match_loop(spark):
    rows = [("1", "2", 1995, 2002), ("2", "1", 2001, None), ("3", "3", 2000, 2001), ("2", "3", 2003, 2001), ("4", "1", 2004, None)]
    e = spark.createDataFrame(rows, "s string, t string, a int, b int")
    for mode in ("cumulative", "active"):
        got = {(r["year"], r["a"], r["b"]) for r in graph.yearly_pairs(e, mode, 2000, 2005, "s", "t", "a", "b").collect()}
        want = {(y, *sorted(r[:2])) for y in range(2000, 2006) for r in rows if r[2] <= y and (mode == "cumulative" or r[3] is None or r[3] >= y)}
        assert got == want
        assert {tuple(sorted(x)) for x in graph.asof_edges(e, 2002, mode, "s", "t", "a", "b").collect()} == {(a, b) for y, a, b in want if y == 2002}
    with pytest.raises(ValueError):
        graph.asof_edges(e, 2002, "other", "s", "t", "a", "b")


@pytest.mark.parametrize("mode", ["cumulative", "active"])
def test_metrics_of_years_match_each_year(spark, mode):
    rng = random.Random(12)
    rows = [(*(rng.sample("abcdefghijkl", 2) if rng.random() < 0.97 else "zz"), rng.randint(1997, 2007), rng.choice([None, rng.randint(1999, 2008)])) for _ in range(90)]
    e = spark.createDataFrame([(*r, 1) for r in rows], "s string, t string, a int, b int, mask int")
    where = (mode, 2000, 2005, "s", "t", "a", "b")
    want = {(r["year"], r["node_id"]): r for r in graph.local_metrics(graph.yearly_pairs(e, *where), ["year"]).collect()}
    got = {(r["year"], r["node_id"]): r for r in graph.local_metrics_of_years(graph.yearly_masks(e, *where), 2000, 2005).collect()}
    assert set(got) == set(want) and len({y for y, _ in want}) == 6
    for k, r in want.items():
        for c in ("degree", "degree_centrality", "clustering", "effective_size", "network_constraint", "brokerage"):
            assert got[k][c] == (r[c] if r[c] is None else pytest.approx(r[c])), (k, c)
    assert graph.local_metrics_of_years(graph.yearly_masks(e.limit(0), *where), 2000, 2005).count() == 0
    with pytest.raises(ValueError):
        graph.yearly_masks(e, mode, 1900, 2005, "s", "t", "a", "b")


def test_network_panel(spark):
    e = spark.createDataFrame([("1", "2", 2000, 2000), ("2", "3", 2001, None), ("1", "3", 2001, None)], "s string, t string, a int, b int")
    got = {(r["year"], r["node_id"]): r for r in graph.network_panel(e, "active", 2000, 2001, "s", "t", "a", "b").collect()}
    assert set(got) == {(2000, "1"), (2000, "2"), (2001, "1"), (2001, "2"), (2001, "3")}
    assert got[(2000, "1")]["pagerank"] == pytest.approx(0.5) and got[(2001, "3")]["eigenvector_centrality"] == pytest.approx(1) and got[(2001, "1")]["eigenvector_centrality"] == pytest.approx(2**-0.5)


def test_weights(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(a, b, float(rng.randint(1, 5)), k) for k in range(2) for a, b in itertools.combinations("ABCDEFG", 2) if rng.random() < 0.55] + [("A", "B", 2.0, 9), ("B", "A", 3.0, 8)]
    e = spark.createDataFrame(rows, "s string, t string, w double, k int")
    pairs = graph.simple_graph(e, "s", "t", "w", "k")
    w = {(r["a"], r["b"]): r["weight"] for r in pairs.collect()}
    assert w[("A", "B")] == 2.0 and all(w[tuple(sorted(r[:2]))] == max(((q[3], q[2]) for q in rows if sorted(q[:2]) == sorted(r[:2])))[1] for r in rows)
    names = sorted({x for p in w for x in p})
    m = np.zeros((len(names), len(names)))
    for (a, b), v in w.items():
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = v
    n = len(names)
    rank = np.linalg.solve(np.eye(n) - 0.85 * (m / m.sum(axis=1, keepdims=True)).T, np.full(n, 0.15 / n))
    assert of(graph.pagerank(pairs, [], weight="weight"), "pagerank") == pytest.approx(dict(zip(names, rank)))
    values, vectors = np.linalg.eigh(m)
    top = np.abs(vectors[:, -1])
    assert of(graph.eigenvector(pairs, [], "l2", weight="weight"), "eigenvector_centrality") == pytest.approx(dict(zip(names, top)), abs=1e-6)
    # every simple path between two nodes, by brute force
    through = collections.Counter()
    for a, b in itertools.combinations(names, 2):
        paths = []
        for k in range(n - 1):
            for mid in itertools.permutations([x for x in names if x not in (a, b)], k):
                steps = list(zip((a, *mid), (*mid, b)))
                if all(tuple(sorted(s)) in w for s in steps):
                    paths.append((sum(w[tuple(sorted(s))] for s in steps), mid))
        if not paths:
            continue
        least = min(paths)[0]
        short = [mid for d, mid in paths if d == least]
        for mid in short:
            for x in mid:
                through[x] += 1 / len(short)
    got = of(graph.betweenness(pairs, weight="weight"), "betweenness")
    assert got == pytest.approx({x: through[x] * 2 / ((n - 1) * (n - 2)) for x in names})
    m = graph.all_metrics(e, "s", "t", weight="w", order="k")
    assert m.count() == n and of(m, "pagerank") == pytest.approx(dict(zip(names, rank)))


def test_connection_panel_and_core(spark):
    raw = spark.createDataFrame([("1.0", "2", 1999, None), ("1", "3", 2001, None), ("1", "3", 2002, None), ("x", "3", 2001, None), ("4", "5", None, None), ("4", "6", 2002, 2003)], "s string, t string, a int, b int")
    core = graph.edges_core(raw, "s", "t", "a", "b")
    assert core.count() == 4
    got = {(r["s"], r["year"]): r["n_unique_connected"] for r in graph.connection_panel(core, "s", "t", "a", 2000, 2002).collect()}
    assert got == {("1", 2000): 0, ("1", 2001): 1, ("1", 2002): 1, ("4", 2000): 0, ("4", 2001): 0, ("4", 2002): 1}
    prior = graph.connection_panel(core, "s", "t", "a", 2000, 2002, include_prior=True)
    assert {(r["s"], r["year"]): r["n_unique_connected"] for r in prior.collect()}[("1", 2002)] == 2


def test_empty_graph_keeps_its_columns(spark):
    m = graph.local_metrics(spark.createDataFrame([], "a string, b string"), [])
    assert m.count() == 0 and "network_constraint" in m.columns


def test_complete_graph(spark):
    k4 = pairs(spark, itertools.combinations("ABCD", 2))
    m = graph.local_metrics(k4, [])
    assert set(of(m, "clustering").values()) == {1.0} and graph.triangles(k4, []).count() == 4


def test_all_metrics(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), (None, "C")], "s string, t string")
    m = {r["node_id"]: r for r in graph.all_metrics(e, "s", "t").collect()}
    assert set(m) == {"A", "B", "C"} and m["B"]["betweenness"] == pytest.approx(1) and m["B"]["closeness"] == pytest.approx(1)
    assert sum(r["eigenvector_centrality"] ** 2 for r in m.values()) == pytest.approx(1)


SF = "/root/testdata/sf0.001"


def brute_paths(edges, nodes):
    """Closeness and betweenness of every node by counting the shortest paths between all pairs."""
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    dist, ways = {}, {}
    for s in nodes:
        dist[s], ways[s], queue = {s: 0}, collections.Counter({s: 1}), [s]
        for v in queue:
            for w in near[v]:
                if w not in dist[s]:
                    dist[s][w] = dist[s][v] + 1
                    queue.append(w)
                if dist[s][w] == dist[s][v] + 1:
                    ways[s][w] += ways[s][v]
    n = len(nodes)
    close = {s: (len(d) - 1) ** 2 / (sum(d.values()) or 1) / (n - 1) for s, d in dist.items()}
    between = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, far in dist[s].items():
            for v, x in dist[s].items():
                if v not in (s, t) and s != t and x + dist[v].get(t, n) == far:
                    between[v] += ways[s][v] * ways[v][t] / ways[s][t] / ((n - 1) * (n - 2))
    return close, between


def test_paths_match_brute_force(spark):
    rng = random.Random(5)
    edges = {tuple(sorted((f"v{rng.randint(0, 59)}", f"v{rng.randint(0, 59)}"))) for _ in range(75)} | {("w", "w"), ("y", "z")}
    close, between = brute_paths(edges, sorted({x for e in edges for x in e}))
    assert of(graph.closeness(pairs(spark, edges)), "closeness") == pytest.approx(close)
    assert of(graph.betweenness(pairs(spark, edges)), "betweenness") == pytest.approx(between)


def test_paths_of_many_nodes(spark):
    star = spark.range(5_200).selectExpr("'c' as a", "concat('l', id) as b")
    c, b = of(graph.closeness(star), "closeness"), of(graph.betweenness(star), "betweenness")
    assert len(c) == len(b) == 5_201
    assert c["c"] == b["c"] == pytest.approx(1) and c["l7"] == pytest.approx(5_200 / (1 + 2 * 5_199)) and b["l7"] == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_path_queries_use_the_directors(spark):
    from tidewheel.plans import relations

    edges = [tuple(r) for r in relations._snapshot(spark, SF).collect()]
    close, between = brute_paths(edges, sorted({x for e in edges for x in e}))
    assert of(relations.closeness(spark, SF), "closeness") == pytest.approx(close, abs=1e-9)
    assert of(relations.betweenness(spark, SF), "betweenness") == pytest.approx(between, abs=1e-9)


def matrix(edges):
    import numpy as np

    ids = sorted({x for e in edges for x in e})
    near = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        if a != b:
            near[ids.index(a), ids.index(b)] = near[ids.index(b), ids.index(a)] = 1
    return ids, near


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_eigenvector_query_has_converged(spark):
    import numpy as np
    from tidewheel.plans import relations

    ids, near = matrix([tuple(r) for r in relations._snapshot(spark, SF).collect()])
    want = np.abs(np.linalg.eigh(near)[1][:, -1])
    got = of(relations.eigenvector(spark, SF), "eigenvector_centrality")
    assert [got[i] for i in ids] == pytest.approx(list(want / want.max()), abs=1e-6)


def test_eigenvector_of_snapshots_and_ties(spark):
    rows = [(1, "A", "B"), (1, "C", "D"), (1, "E", "F"), (2, "A", "A"), (3, "A", "B"), (3, "B", "C"), (3, "D", "E")]
    df = spark.createDataFrame(rows, "year int, a string, b string")
    got = {(r["year"], r["node_id"]): r["eigenvector_centrality"] for r in graph.eigenvector(df, ["year"]).collect()}
    want = {(1, x): 1 for x in "ABCDEF"} | {(2, "A"): 1, (3, "A"): 0.5**0.5, (3, "B"): 1, (3, "C"): 0.5**0.5, (3, "D"): 0, (3, "E"): 0}
    assert got == pytest.approx(want, abs=1e-8)
    with pytest.warns(RuntimeWarning):
        graph.eigenvector(pairs(spark, ["AB", "BC", "CD", "DE", "EF", "BD"]), [], iterations=1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pagerank_query_has_converged(spark):
    import numpy as np
    from tidewheel.plans import relations

    ids, near = matrix([tuple(r) for r in relations._snapshot(spark, SF).collect()])
    n, d = len(ids), near.sum(axis=0)
    step = np.where(d > 0, near / np.maximum(d, 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * step, np.full(n, 0.15 / n))
    got = of(relations.pagerank(spark, SF), "pagerank")
    assert [got[i] for i in ids] == pytest.approx(list(want), abs=1.1e-9)


def hubs_and_leaves(rng, count=400):
    """Links of some hubs with many nodes of one or two neighbours, a path, and two nodes only linked to each other."""
    links = {tuple(sorted((rng.randrange(12), 20 + k))) for k in range(count) for _ in range(rng.choice((1, 1, 2, 3)))}
    return sorted(links | {(0, 1), (2, 3)} | {(1000 + k, 1001 + k) for k in range(9)} | {(2000, 2001)})


def test_searches_of_many_sources_at_once():
    import numpy as np
    from tidewheel.operators.graph_arrays import BitSearch, Folded

    g = Folded(*np.array(hubs_and_leaves(random.Random(3))).T)
    assert 0 < len(g.core) < len(g.ids) and g.weight.sum() == len(g.ids) and (np.diff(g.start) > BitSearch.PIECE).any()
    far = np.full((len(g.core), len(g.core)), -1)
    for s in range(len(g.core)):
        far[s, s], queue = 0, [s]
        for v in queue:
            for w in g.adj[g.start[v] : g.start[v + 1]]:
                if far[s, w] < 0:
                    far[s, w] = far[s, v] + 1
                    queue.append(w)
    search = BitSearch(g.start, g.adj)
    for sources in (np.arange(len(g.core)), np.arange(0, len(g.core), 7)):
        found, reached, total = search.distances(sources, g.weight)
        there, w = far[sources] >= 0, g.weight[sources][:, None]
        assert (found == there.sum(axis=0)).all() and (reached == (there * w).sum(axis=0)).all() and (total == (there * w * far[sources]).sum(axis=0)).all()


def test_closeness_of_hubs_and_leaves(spark):
    edges = [(str(a), str(b)) for a, b in hubs_and_leaves(random.Random(4), 60)] + [("x", "x")]
    close, _ = brute_paths(edges, sorted({x for e in edges for x in e}))
    assert of(graph.closeness(pairs(spark, edges)), "closeness") == pytest.approx(close)


def test_betweenness_of_hubs_and_leaves(spark):
    import numpy as np

    edges = [(str(a), str(b)) for a, b in hubs_and_leaves(random.Random(4), 60)] + [("x", "x")]
    _, between = brute_paths(edges, sorted({x for e in edges for x in e}))
    assert of(graph.betweenness(pairs(spark, edges)), "betweenness") == pytest.approx(between)
    # ends of paths count by weight: leaves are not searched
    size, delta = graph._search(np.array([0, 1, 3, 4]), np.array([1, 0, 2, 1]), np.array([0]), np.array([3, 1, 2]))
    assert list(size) == [6] and list(delta) == [0, 6, 0]


@pytest.mark.parametrize("mode", ["cumulative", "active"])
def test_network_panel_in_arrays_matches_joins(spark, mode):
    rng = random.Random(21)
    rows = [(*(rng.sample("abcdefghijkl", 2) if rng.random() < 0.95 else "zz"), rng.randint(1998, 2004), rng.choice([None, rng.randint(1999, 2005)])) for _ in range(40)] + [("q", "q", 1990, None)]
    e = spark.createDataFrame(rows, "s string, t string, a int, b int")
    where = (mode, 1999, 2004, "s", "t", "a", "b")
    got, want = ({(r["year"], r["node_id"]): r for r in graph.network_panel(e, *where, most_pairs=n).collect()} for n in (graph.MOST_PAIRS, 0))
    assert got.keys() == want.keys() and len({y for y, _ in got}) == 6
    for k, r in want.items():
        assert list(r.asDict()) == list(got[k].asDict())
        for c in r.asDict():
            assert got[k][c] == (r[c] if r[c] is None else pytest.approx(r[c], abs=1e-8)), (k, c)
    assert graph.network_panel(e.limit(0), *where).count() == 0
