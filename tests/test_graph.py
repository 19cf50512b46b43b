import random

import pytest

from sparkloom.operators import graph as G

NODES = [("d", "root"), ("f", "App.py"), ("c", "Cls"), ("m", "run"), ("g", "helper"), ("x", "x")]
EDGES = [("e1", "CONTAINS", "d", "f"), ("e2", "CONTAINS", "f", "c"), ("e3", "CONTAINS", "c", "m"), ("e4", "CONTAINS", "f", "g"), ("e5", "CALLS", "m", "g"), ("e6", "CALLS", "g", "g"), ("e7", "CALLS", "m", "gone")]
VALUES = {"d": {"meta_type": "Directory"}, "f": {"meta_type": "File", "relative_path": "App.py"}, "c": {"meta_type": "Class", "n": 5}, "m": {"meta_type": "Method", "is_async": True}, "g": {"meta_type": "Function", "n": 12}, "e5": {"weight": 2}}


@pytest.fixture(scope="module")
def graph(spark):
    return G.from_rows(spark, [(i, label) for i, label in NODES], [(i, rel, s, t) for i, rel, s, t in EDGES], VALUES).cache()


def ids(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_search(graph):
    found = lambda **kw: [r.id for r in G.search_elements(graph, **kw).collect()]
    assert found(kind="node", meta_type="File") == ["f"]
    assert found(label_contains="CLS") == ["c"]
    assert found(properties_filter={"is_async": True}) == ["m"]
    assert found(properties_filter={"relative_path": "App.*"}) == ["f"]
    assert found(properties_filter={"relative_path": "App?py"}) == []  # a question mark is live with a star only
    assert found(properties_filter={"relative_path": "*?p[xy]"}) == ["f"]
    assert found(kind="node", sort_order="desc", limit=2) == ["x", "m"]
    page = G.search_elements(graph, kind="edge", offset=2, limit=3).collect()
    assert [r.id for r in page] == ["e3", "e4", "e5"] and page[0].total == 7


def test_element_and_neighbors(spark, graph):
    m = G.get_element(graph, "m", ("edges", "neighbors")).first()
    assert [e.edge_id for e in m.edges] == ["e3", "e5", "e7"]
    assert [(n.id, n.label) for n in m.neighbors] == [("c", "Cls"), ("g", "helper"), ("gone", "gone")]
    assert m.props["is_async"] == "True"
    with pytest.raises(G.GraphError, match="ELEMENT_NOT_FOUND"):
        G.get_element(graph, "nope")
    near = lambda *a: sorted(r.id for r in G.get_neighbors(graph, ids(spark, "center", "g"), *a).collect())
    assert near("in") == ["f", "g", "m"] and near("out") == ["g"] and near("in", "CONTAINS") == ["f"]
    assert G.get_neighbors(graph, ids(spark, "center", "unknown")).count() == 0


def test_traverse(spark, graph):
    walk = lambda *a, **kw: sorted(tuple(r.node_ids) for r in G.traverse(graph, ids(spark, "start", "d"), *a, **kw).collect())
    assert walk(0) == [("d",)] and walk(0, None, 0) == [("d",)]
    assert walk(2) == [("d", "f", "c"), ("d", "f", "g")]
    assert walk(3) == [("d", "f", "c", "m"), ("d", "f", "g", "m")]
    assert walk(3, ["CONTAINS", "CONTAINS", {"edge_label": "CALLS", "direction": "in"}]) == [("d", "f", "g", "m")]
    assert walk(3, ["CONTAINS"], 1) == [("d", "f", "c", "m")] and walk(3, None, 0) == []
    with pytest.raises(G.GraphError):
        walk(1, [5])
    assert G.first_failing_step(graph, ids(spark, "start", "d"), ["CONTAINS", "CALLS"]) == 2


def model_find(nodes, edges, start, kind, depth):
    """A breadth-first walk over sorted neighbours, against the edges."""
    into = {}
    for _, _, s, t in edges:
        into.setdefault(t, set()).add(s)
    queue, seen = [(start, (start,))], {start}
    while queue:
        at, path = queue.pop(0)
        if nodes.get(at) == kind:
            return at, len(path) - 1, list(path)
        if len(path) <= depth:
            for n in sorted(into.get(at, ())):
                if n not in seen:
                    seen.add(n)
                    queue.append((n, path + (n,)))
    return None


@pytest.mark.parametrize("seed", range(2))
def test_find_connected_equals_a_walk(spark, seed):
    r = random.Random(seed)
    kinds = {f"n{k}": r.choice(["A", "B", "B", "B"]) for k in range(25)}
    edges = [(f"e{k}", "R", f"n{r.randrange(25)}", f"n{r.randrange(25)}") for k in range(40)]
    g = G.from_rows(spark, [(k, k) for k in kinds], edges, {k: {"meta_type": v} for k, v in kinds.items()}).cache()
    got = {x.start: (x.id, x.depth, x.path) for x in G.find_connected(g, ids(spark, "start", *kinds), "A", max_depth=3).collect()}
    want = {k: w for k in kinds if (w := model_find(kinds, edges, k, "A", 3))}
    assert got == want


def test_find_connected_makes_no_pairs_of_starts(spark, monkeypatch):
    """2,000 starts around one node that isn't of the type: each level has a row a node, not one a pair of starts."""
    n = 2_000
    edges = [(f"e{k}", "R", f"s{k}", "hub") for k in range(n)] + [("x", "R", "top", "hub")]
    kinds = {"top": "A", "hub": "B"} | {f"s{k}": "B" for k in range(n)}
    g = G.from_rows(spark, [(k, k) for k in kinds], edges, {k: {"meta_type": v} for k, v in kinds.items()}).cache()
    most, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: most.append((out := cut(df)).count()) or out)
    found = G.find_connected(g, ids(spark, "start", *kinds), "A", None, "both", 3).collect()
    assert {r.start: (r.id, r.depth, tuple(r.path)) for r in found} == {"top": ("top", 0, ("top",)), "hub": ("top", 1, ("hub", "top"))} | {f"s{k}": ("top", 2, (f"s{k}", "hub", "top")) for k in range(n)}
    assert max(most) <= 2 * len(edges)
