from sparkloom.operators import explore as X
from sparkloom.operators import graph as G


def test_tools_give_all_of_a_hub(spark):
    ids = [f"n{k:04}" for k in range(1100)]
    g = G.from_rows(spark, [("hub", "H"), *((i, i) for i in ids)], [(f"e{i}", "R", "hub", i) for i in reversed(ids)], {})
    tools = X.registry(g)
    near = tools["get_neighbors"](id="hub")
    assert [x["id"] for x in near] == ids
    assert X.render(near).endswith("(1080 more)")
    assert [x["node_ids"] for x in tools["traverse"](start_id="hub", max_depth=1)] == [["hub", i] for i in ids]
    assert [x["id"] for x in tools["search_elements"](kind="node")] == ["hub", *ids]
    assert len(tools["search_elements"](kind="node", limit=3)) == len(tools["traverse"](start_id="hub", max_depth=1, limit_paths=3)) == 3
    answers = iter(['{"function": {"name": "get_neighbors", "arguments": {"id": "hub"}}}', "DONE"])
    assert set(X.explore(lambda talk, t: next(answers), tools, "what?").touched) == set(ids)
