import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import context as C
from sparkloom.operators import evaluate as E
from sparkloom.operators import explore as X
from sparkloom.operators import extract as XT
from sparkloom.operators import graph as G
from sparkloom.operators import rank as R
from sparkloom.operators import repair as RP
from sparkloom.operators import spans as S
from sparkloom.operators import validate as VA
from sparkloom.operators import vectors as V
from sparkloom.operators import write as WR
from sparkloom.sources import files as FS
from sparkloom.streaming import progress as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_text(spark):
    assert one(spark, "a\r\nb\x0bc\n", T.split_lines) == ["a", "b", "c"] and one(spark, "", T.split_lines) == []
    assert one(spark, "a\nb\nc", lambda x: T.line_range(x, F.lit(2), F.lit(9))) == "b\nc"
    assert one(spark, "## h\n12 x = 1\ny", T.unnumbered) == "x = 1\ny"
    assert one(spark, "[start of a/b.py]\nbody\n[end of a/b.py]\n[start of c.py]", lambda x: T.files_with_content(x)) == [("a/b.py", "body"), ("c.py", "")]
    assert one(spark, "x [start of p] y", T.marked_files) == ["p"] and one(spark, "x [start of p] y", lambda x: T.marked_files(x, "strict")) == []
    assert one(spark, "+++ b/a\n+++ b/c d\n+++ b/a\n", T.patched_files) == ["a", "c d"]
    assert one(spark, "+++ b/a\n+  long line \n+x\n-no", lambda x: T.added_lines(x, 2)) == ["long line"]
    assert one(spark, 'say ["a", "b"] or ["c"]', T.list_answer) == ["a", "b"] and one(spark, "[1]", T.list_answer) is None
    assert [one(spark, t, T.comparator_answer) for t in ("A", "file_b", "file_a or file_b", "no")] == ["a", "b", None, None]
    text = 'Go:\n```json\n{"function": "f"}\n```\n```\nbroken {\n```\n```json\n[{"a": 1}, 2]\n```'
    assert [json.loads(x) for x in one(spark, text, T.json_objects)] == T.python_json(text) == [{"function": "f"}, {"a": 1}]
    assert len(one(spark, text, T.function_calls)) == 1
    assert one(spark, "click>=8.0 # c", T.requirement) == ("click", ">=8.0") and one(spark, "-r x", T.requirement) is None
    assert one(spark, "a__b__" + "0" * 40, T.graph_identity) == ("a__b", "0" * 40)
    assert T.parse_signals("sim, freq", ("freq", "sim")) == ["freq", "sim"]
    with pytest.raises(ValueError):
        T.parse_signals("x", ("freq",))


def test_metrics(spark):
    ranked = spark.createDataFrame([("m", "i", k + 1, x) for k, x in enumerate("abcde")], "method string, instance string, pos int, item string")
    gold = spark.createDataFrame([("i", x) for x in "abz"] + [("j", "a")], "instance string, item string")
    rows = {r.instance: r for r in E.per_instance(ranked, gold, ["m"]).collect()}
    assert [round(rows["i"][f"recall_frac_{k}"], 4) for k in (1, 3, 5)] == [0.3333, 0.6667, 0.6667]
    assert rows["i"].hit_any_1 and not rows["i"].cover_5 and not rows["j"].hit_any_5
    s = E.token_stats(spark.range(1, 11), [], F.col("id")).first()
    assert (s["mean"], s["median"], s["p90"], s["upper_median"]) == (5.5, 5.5, 9.0, 6.0)
    rows = spark.createDataFrame([("m", "a", 100, 1, True), ("m", "b", 200, 1, False), ("m", "c", 300, 1, True)], "method string, instance string, tokens int, files int, hit boolean")
    assert E.method_summary(rows).first().tokens_per_hit == 300
    calls = spark.createDataFrame([("a", '[{"usage":{"prompt_tokens":7000,"completion_tokens":300}},{"usage":null},{"usage":{"prompt_tokens":5000,"completion_tokens":400}}]'), ("b", None), ("c", '{"usage":{"prompt_tokens":1}}')], "instance string, traj string")
    assert {r.instance: tuple(r)[1:] for r in E.usage_totals(calls).collect()} == {"a": (12000, 700, 2), "b": (0, 0, 0), "c": (1, 0, 1)}
    rows = spark.createDataFrame([("a", "", 0), ("b", "x", 1), ("a", "ctx", 2), ("c", "", 3), ("b", "", 4)], "id string, t string, n int")
    assert [(r.id, r.t) for r in E.keep_last(rows, "id", "n", "t").orderBy("first_pos").collect()] == [("a", "ctx"), ("b", "x")]
    added = spark.createDataFrame([("i", "gold line")], "instance string, line string")
    assert E.leaks(added, spark.createDataFrame([("i", "a gold line b"), ("i", "no")], "instance string, text string")).first().n_texts == 1


def test_spans(spark):
    rows = spark.createDataFrame([("f", 1, 3), ("f", 20, 22), ("f", 12, 14)], "file string, start long, end long")
    assert [(r.start, r.end) for r in S.merge_intervals(rows, ["file"], 3).orderBy("start").collect()] == [(1, 6), (9, 25)]
    hunk = lambda a, b, n: (0, "f", a, b, n, False)
    node = spark.createDataFrame([("n", "f", 45, 78)], "node_id string, file string, line_start long, line_end long")
    for h, inside in ((hunk(50, 60, 11), 1), (hunk(40, 60, 21), 0), (hunk(78, 78, 1), 1), (hunk(78, 78, 0), 0)):
        df = spark.createDataFrame([h], "hunk_id long, file string, h_start long, h_end long, count long, is_new_file boolean")
        assert S.hunk_nodes(df, node).count() == inside
    items = spark.createDataFrame([("a", k, n) for k, n in enumerate([50, 3, 3, 90, 1])], "key string, k int, n int")
    assert [r.k for r in S.budget_pack(items, ["key"], ["k"], F.col("n"), 56).orderBy("k").collect()] == [0, 1, 2]
    got = S.greedy_batches(items, ["key"], "k", "k", F.col("n"), 2, 60).orderBy("k").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 3]


def test_repair():
    text = "### a.py\n<<<<<<< SEARCH\nx = 1\n=======\nx = 2\n>>>>>>> REPLACE\n### b.py\nnothing"
    assert RP.search_replace(text) == [("a.py", "x = 1", "x = 2")]
    assert RP.apply_search_replace("x = 1\ny", "x = 1", "z") == "z\ny"
    assert RP.apply_search_replace("x\nx", "x", "z") is None and RP.apply_search_replace("xx", "x", "z") is None and RP.apply_search_replace("x", "", "z") is None
    patch, failed = RP.synthesise({"a.py": "x = 1\n", "b.py": "k\n"}, RP.search_replace(text) + [("c.py", "q", "r")])
    assert failed == 1 and "-x = 1" in patch and "+x = 2" in patch and "b.py" not in patch
    edits = RP.node_edits("### f in a.py\n```python\ndef f():\n    return 2\n```")
    patch, failed = RP.synthesise_nodes({"a.py": "def f():\n    return 1\n"}, edits, {("f", "a.py"): (1, 2, "def f():\n    return 1")})
    assert failed == 0 and "+    return 2" in patch
    h = lambda head: [(x.start, x.end, x.count) for x in RP.hunks(f"diff --git a/f b/f\n--- a/f\n+++ b/f\n{head}\n")]
    assert h("@@ -12,7 +12,9 @@") == [(12, 18, 7)] and h("@@ -5 +5,2 @@") == [(5, 5, 1)] and h("@@ -10,0 +11,3 @@") == [(10, 10, 0)]
    assert RP.hunks("diff --git a/n b/n\n--- /dev/null\n+++ b/n\n@@ -0,0 +1,2 @@\n")[0].is_new_file
    assert RP.greedy_cover({"a": {1, 2}, "b": {2, 3}, "c": {1, 2, 3}}, {"a": 1, "b": 1, "c": 4}) == ["a", "b"]
    assert RP.greedy_cover({"a": {1}}, {"a": 0}) == ["a"]
    cut = RP.truncate_sections([("a", "x" * 500), ("b", "y" * 500), ("c", "z")], 2, 200, 250)
    assert [p for p, _ in cut] == ["a", "b"] and cut[0][1] == "x" * 100 + "\n[300 characters left out]\n" + "x" * 100 and cut[1][1] == RP.STUB


@pytest.mark.parametrize("costs", [(1, 2, 2, 3, 5), (0, 0, 1, 4, 9), (-3, -1, -1, 2, 4)])
def test_offered_covers_equal_the_greedy_ones(spark, costs, monkeypatch):
    """Elements up to 12 an instance, repeated needs and offers, an unknown set, an element without offers, a null instance, batches of 7 rows."""
    r = random.Random(sum(costs))
    sets = {k: float(r.choice(costs)) for k in range(90, 130)}
    offers = [(e, r.choice([*sets, 7])) for e in range(30) for _ in range(r.randrange(1, 14))] * 2
    need = [(i, r.randrange(31)) for i in range(120) for _ in range(r.randrange(1, 13))] + [(500, 30), (None, 1)]
    want = {}
    for i in {i for i, _ in need if i is not None}:
        held = {}
        for e, k in offers:
            if (i, e) in need and k in sets:
                held.setdefault(str(k), set()).add(e)
        if held:
            want[i] = RP.greedy_cover(held, {k: sets[int(k)] for k in held})
    frames = [spark.createDataFrame(need, "instance long, element int"), spark.createDataFrame(offers, "element int, set_id long"), spark.createDataFrame([*sets.items()], "set_id long, cost double")]
    monkeypatch.setattr(RP, "covers", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = RP.offered_covers(*frames).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {x.instance: x.picked for x in got} == want
    monkeypatch.undo()
    monkeypatch.setattr(RP, "BROADCAST_SETS", 10)
    if costs[0]:
        assert {x.instance: x.picked for x in RP.offered_covers(*frames).collect()} == want


def test_rank(spark):
    pool = spark.createDataFrame([("i", k, x) for k, x in enumerate("abcd")], "instance string, pos int, item string")
    chunks = spark.createDataFrame([("i", 0, 0, "b"), ("i", 1, 0, "d"), ("i", 0, 1, "a"), ("i", 1, 1, "zz"), ("i", 1, 2, "b")], "instance string, chunk int, pos int, item string")
    assert [r.item for r in R.merge_chunks(chunks, pool).orderBy("rank").collect()] == ["b", "d", "a", "c"]
    blocks = {x: x * 10 for x in "abcd"}
    assert R.listwise(list("abcd"), blocks, 20, lambda c: c[::-1] + ["q"]) == (["b", "d", "a", "c"], False)
    assert R.listwise(list("abcd"), blocks, 20, lambda c: None) == (list("abcd"), True)
    assert R.listwise(["a"], {}, 5, lambda c: 1 / 0) == (["a"], False)
    assert R.comparator_sort(list("cab"), lambda x, y: "a" if x < y else "b")[0] == list("abc")
    assert R.comparator_sort(list("cab"), lambda x, y: None)[::2] == (list("cab"), True)
    ctx = spark.createDataFrame([("i", "H", "F", "|", {"a": "A", "b": "B"}, ["a", "b"]), ("j", "H", "F", "|", {"a": "A"}, ["a"])], "instance string, header string, footer string, separator string, blocks map<string,string>, order array<string>")
    out = {r.instance: r for r in R.rebuild(ctx, spark.createDataFrame([("i", ["b", "q", "a", "b"])], "instance string, ranked array<string>")).collect()}
    assert out["i"].context == "HB|AF" and out["i"].missing == ["q"] and out["j"].context == "HAF" and not out["j"].rerank_used
    docs = spark.createDataFrame([(1, "red cat"), (2, "red red dog"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in R.bm25(docs, spark.createDataFrame([(0, "cat")], "query_id long, text string")).collect()] == [1]


def test_validate_and_write(spark, tmp_path):
    g = G.from_rows(spark, [("a", "A"), ("b", "B"), ("c", "C")], [("e", "R", "a", "b"), ("f", "S", "a", "gone"), ("h", "R", "b", "c")], {"a": {"meta_type": "X", "v": "12a"}, "b": {"meta_type": "Y"}, "c": {"meta_type": "Q"}})
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = VA.data_checks(g, df([("X",), ("Y",)], "meta_type string"), df([("R", "X", "Y")], "label string, source_type string, target_type string"), df([("Y", "name", "True")], "meta_type string, key string, mandatory string"), df([("X", "v", "[0-9]+$")], "meta_type string, key string, pattern string"), df([("X", "R", 2, None)], "meta_type string, label string, min_count int, max_count int"))
    assert sorted((r.error_type, r.element_id) for r in found.collect()) == sorted(
        [("INVALID_NODE_TYPE", "c"), ("INVALID_EDGE_TYPE", "f"), ("INVALID_EDGE_SIGNATURE", "h"), ("REFERENTIAL_INTEGRITY", "f"), ("MISSING_REQUIRED_PROPERTY", "b"), ("PATTERN_VALIDATION_FAILED", "a"), ("CARDINALITY_VIOLATION_MIN", "a")]
    )
    kinds = df([("integer", "true"), ("integer", "1.5"), ("float", "1"), ("string", '"x"'), ("boolean", '"true"'), ("url", "5")], "k string, j string")
    assert [r[0] for r in kinds.select(VA.value_type_ok(F.col("k"), F.schema_of_variant(F.try_parse_json("j")))).collect()] == [True, False, True, True, False, True]
    meta = G.from_rows(spark, [("p", "p"), ("q", "q")], [("e", "HAS_PROPERTY", "p", "nope")], {"p": {"meta_type": "PropertyType", "dataType": "money", "minCount": 3, "maxCount": 1}, "q": {}})
    assert sorted(r.error_type for r in VA.meta_checks(meta).collect()) == ["INVALID_CARDINALITY", "INVALID_DATATYPE", "MISSING_TARGET", "UNKNOWN_TYPE"]
    assert not VA.satisfiable(meta)

    ids = lambda *x: df([(i,) for i in x], "id string")
    bad = WR.update_graph(spark, g, WR.Batch(deleted_nodes=ids("b")))
    assert (bad.status, bad.errors) == ("unsat", [("REFERENTIAL_INTEGRITY", "b")])
    ok = WR.update_graph(spark, g, WR.Batch(nodes=df([("d", None), ("a", "AA"), ("d", "D2")], "id string, label string").coalesce(1), edges=df([("k", "R", "d", "c")], "id string, label string, source string, target string"), values=df([("d", "meta_type", "X"), ("a", "w", "1"), ("a", "w", "2")], "id string, key string, value string").coalesce(1), deleted_nodes=ids("b"), deleted_edges=ids("e", "h")))
    assert ok.committed, ok.errors
    nodes = {r.id: r for r in ok.graph.nodes.collect()}
    assert set(nodes) == {"a", "c", "d"} and nodes["d"].label == "D2" and nodes["a"].label == "AA" and nodes["a"].props == {"meta_type": "X", "v": "12a", "w": "2"} and nodes["d"].meta_type == "X"
    assert WR.update_graph(spark, g, WR.Batch(edges=df([("z", "R", "a", "no")], "id string, label string, source string, target string"))).errors == [("REFERENTIAL_INTEGRITY", "z")]
    assert WR.update_graph(spark, g, WR.Batch(values=df([("a", "code_path", "../x")], "id string, key string, value string"))).errors == [("STORE_PATH_INVALID", "a")]
    assert WR.payload_errors(spark, [{"id": "a", "x": 1}, {}], [{"id": "e"}], {"a": {"k": [1]}}) == [("FORBIDDEN_PROPERTY", "a"), ("MISSING_ID", "node"), ("MISSING_ID", "e"), ("NESTED_PROPERTIES_NOT_ALLOWED", "a")]
    WR.save_snapshot(spark, g, str(tmp_path), 1)
    WR.save_snapshot(spark, ok.graph, str(tmp_path), 2)
    assert WR.load_snapshot(spark, str(tmp_path)).nodes.count() == 3 and WR.load_snapshot(spark, str(tmp_path), 1).edges.count() == 3


MAIN = '''import os
from util import helper as h, Tool

VERSION: int = 1

class App(Tool):
    size = 3

    @property
    def run(self):
        """Runs."""
        self.helper()
        try:
            if a and b:
                raise ValueError("x")
        except (KeyError, OSError):
            pass
        except:
            raise

    def helper(self):
        err = KeyError("q")
        raise err

async def main() -> None:
    helper()
    App()
'''


def test_extract(spark):
    files = spark.createDataFrame([("main.py", MAIN), ("pkg/util.py", "class Tool:\n    pass\n\ndef helper(x):\n    return [i for i in x if i]\n"), ("bad.py", "def ("), (".venv_alpine/x.py", "a = 1"), ("r.txt", "")], "path string, content string")
    deps = spark.createDataFrame([("click>=8.0",), ("# no",), ("",)], "line string")
    g, errors = XT.build_graph(files, deps)
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {r.id for r in g.edges.collect()}
    assert [r.path for r in errors.collect()] == ["bad.py"]
    assert {"Directory-.", "Directory-pkg", "File-main.py", "Class-main.py-App", "Method-main.py-App-run", "Function-main.py-main", "Variable-File-main.py-VERSION", "Variable-Class-main.py-App-size", "Decorator-Method-main.py-App-run-property", "Import-File-main.py-0", "Dependency-click", "Exception-KeyError", "TypeAnnotation-int"} <= set(nodes)
    assert not any("venv" in i or "r.txt" in i for i in nodes)
    assert [r.ord for r in g.nodes.orderBy("ord").collect()] == list(range(len(nodes))) and g.nodes.schema["ord"].dataType.simpleString() == "bigint"
    more = WR.Batch(nodes=spark.createDataFrame([("n", "N")], "id string, label string"), edges=spark.createDataFrame([("e", "R", "n", "File-main.py")], "id string, label string, source string, target string"))
    done = WR.update_graph(spark, g, more)
    assert done.committed and {r.id for r in done.graph.nodes.collect()} == set(nodes) | {"n"} and done.graph.edges.count() == len(edges) + 1
    run = nodes["Method-main.py-App-run"].props
    assert run["docstring"] == "Runs." and run["complexity"] == "5" and run["line_start"] == "10" and "source_code" in run
    assert nodes["Function-main.py-main"].props["is_async"] == "True" and nodes["Function-main.py-main"].props["return_type"] == "None"
    assert {"Method-main.py-App-run-CALLS-Method-main.py-App-helper", "Function-main.py-main-CALLS-Function-pkg/util.py-helper", "Function-main.py-main-CALLS-Class-main.py-App", "Class-main.py-App-INHERITS-Class-pkg/util.py-Tool", "File-main.py-IMPORTS-Class-pkg/util.py-Tool", "Method-main.py-App-run-RAISES-Exception-ValueError", "Method-main.py-App-helper-RAISES-Exception-KeyError", "Method-main.py-App-run-CATCHES-Exception-Exception", "Variable-File-main.py-VERSION-HAS_TYPE-TypeAnnotation-int", "File-main.py-DEPENDS_ON-Dependency-click", "Directory-.-CONTAINS-Directory-pkg"} <= edges
    assert "Method-main.py-App-run-CATCHES-Exception-KeyError" not in edges  # a tuple of exceptions gives none


def test_context(spark):
    issues = spark.createDataFrame([("i", "broken")], "instance string, issue string")
    files = spark.createDataFrame([("i", "a.py", "\n".join(f"l{k}" for k in range(1, 31))), ("i", "b.py", "x")], "instance string, path string, content string")
    ranked = spark.createDataFrame([("i", "a.py", 1), ("i", "b.py", 2), ("i", "none.py", 3)], "instance string, path string, rank int")
    full = C.file_level(ranked, files, issues).first().context
    assert "[start of a.py]\nl1\n" in full and "none.py" not in full and full.index("a.py") < full.index("b.py")
    spans = spark.createDataFrame([("i", "a.py", 0, 5, 6), ("i", "a.py", 1, 20, 20), ("i", "b.py", 2, 1, 1)], "instance string, path string, seq int, start long, end long")
    text = C.file_snippets(spans, files, issues, 10_000, pad=1).first().context
    assert "4 l4\n5 l5\n6 l6\n7 l7\n(11 lines omitted)\n19 l19" in text and "1 x" in text
    assert "[start of b.py]" in C.file_snippets(spans, files, issues, 25, pad=1).first().context  # the first file's excess doesn't shut out the next
    nodes = spark.createDataFrame([("i", "a.py", 0, "C-a", "Class", 1, 3, "c\nd\ne"), ("i", "a.py", 1, "M-b", "Method", 2, 2, "d")], "instance string, path string, seq int, id string, kind string, start long, end long, source_code string")
    text = C.node_sources(nodes, spark.createDataFrame([("C-a", "CALLS f")], "id string, text string"), issues, 1000).first().context
    assert "## Class a lines 1-3\n## CALLS f\n1 c\n2 d" in text and "Method" not in text
    out = C.gold_files(ranked, files, issues, 30).first()
    assert out.dropped == ["b.py", "none.py"]  # missing files are told
    assert C.gold_files(ranked, files, issues, 40).first().dropped == ["none.py"]
    first = C.gold_files(ranked.where("rank >= 2").withColumn("rank", 4 - F.col("rank")), files, issues, 0).first()
    assert first.dropped == ["none.py"] and "[start of b.py]" in first.context  # the first file that is there is exempt
    assert C.mode("nothing") is C.file_level


def test_explore(spark):
    g = G.from_rows(spark, [("a", "A"), ("b", "B")], [("e", "R", "a", "b")], {"a": {"meta_type": "X"}})
    answers = iter(["no calls here", '{"function": {"name": "get_neighbors", "arguments": {"id": "a"}}}', '{"function": {"name": "get_element", "arguments": {"id": "zz"}}}', "DONE"])
    heats = []
    state = X.explore(lambda talk, t: heats.append(t) or next(answers), X.registry(g), "why?")
    assert list(state.touched) == ["b"] and state.calls == 2 and state.rejections == 1 and heats[:2] == [0.0, 0.15]
    assert state.log[1][2]  # the unknown element was an error, not an end
    assert X.validate_calls('[{"function": {"name": "f", "arguments": 3}}, {"x": 1}, {"function": {"name": "q"}}, {"function": "f", "arguments": {}}]', {"f"})[0] == []
    assert X.validate_calls('[{"function": {"name": "f", "arguments": {"a": 1}}}, {"function": {"name": "f"}}]', {"f"}) == ([("f", {"a": 1}), ("f", {})], [])


def test_vectors(spark):
    nodes = spark.createDataFrame([("a", "Function", {"name": "auth", "source_code": "x"}), ("b", "Function", {"name": "auth", "source_code": "x"}), ("c", "Directory", {"name": "d"})], "id string, meta_type string, props map<string,string>")
    calls = []
    index, cache = V.build_index(nodes, spark.createDataFrame([], "key string, vector array<float>"), 4)
    assert index.count() == 2 and cache.count() == 1
    again, _ = V.cache_split(V.embeddable(nodes), cache, 4)
    assert again.count() == 2 and not calls
    e = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", [1.0, 1.0])], "id string, embedding array<double>")
    got = V.knn(e, spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>"), 5).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in got] == [("x", 1.0), ("z", 0.7071)]
    many = spark.range(300).select(F.col("id"), F.array(*[F.cos(F.col("id") * k) for k in range(1, 6)]).alias("embedding"))
    asked = many.where("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    by_blocks = V.knn(many, asked, 4, query_block=10, vector_block=60)
    assert sorted(map(tuple, by_blocks.collect())) == sorted(map(tuple, V.knn(many, asked, 4).collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes_data": [{"id": "a", "label": "A"}], "edges": [{"id": "e", "label": "R", "source": "a", "target": "a"}], "allValues": {"a": {"meta_type": "X", "t": True, "n": 1, "s": "1", "z": None}}}))
    g = FS.read_graph(spark, str(tmp_path / "g.json"))
    a = g.nodes.first()
    assert a.meta_type == "X" and a.props == {"meta_type": "X", "t": "True", "n": "1", "s": "1"} and g.edges.first().target == "a"
    (tmp_path / "l.json").write_text(json.dumps({"nodes": [{"id": "b"}], "edges": [], "allValues": [{"id": "b", "origin_type": "O"}]}))
    assert FS.read_graph(spark, str(tmp_path / "l.json")).nodes.first().meta_type == "O"
    with pytest.raises(G.GraphError, match="GRAPH_FILE_NOT_FOUND"):
        FS.read_graph(spark, str(tmp_path / "no.json"))
    (tmp_path / "x.json").write_text("{")
    with pytest.raises(G.GraphError, match="INVALID_JSON"):
        FS.read_graph(spark, str(tmp_path / "x.json"))
    (tmp_path / "p.jsonl").write_text('{"instance_id": "i", "text_inputs": "t"}\n\nbroken\n{"instance_id": "j", "text_inputs": ""}\n')
    rows = FS.read_lines(spark, str(tmp_path / "p.jsonl"), FS.INSTANCE)
    assert rows.count() == 2 and [r[0] for r in FS.finished(rows).collect()] == ["i"]
    hits = spark.createDataFrame([("i", [("README.md", 9.0), ("a", 1.0), ("b", 2.0)])], FS.RETRIEVAL)
    assert [r.item for r in FS.retrieved(hits).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "src" / "README").write_text("r")
    tree = FS.read_tree(spark, str(tmp_path / "src")).collect()
    assert [(r.path, r.content) for r in tree] == [("m.py", "x = '�'\n")]
    assert FS.readmes(FS.read_tree(spark, str(tmp_path / "src"), "*")).first().path == "README"
    assert FS.output_path("o/", "dev", "a/b", "v") == "o/split=dev/model=a_b/variant=v"
    assert FS.markdown(spark.createDataFrame([("x", 0.5)], "m string, v double"), ["m", "v"], ["m"]) == "| m | v |\n|---|---|\n| x | 0.5 |\n"


def test_streams(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long").write.json(src)
    for more in ([("a", 5)], []):
        P.keep_latest(P.stream_lines(spark, src, "k string, v long"), "k", "v", out, ck).awaitTermination()
        if more:
            spark.createDataFrame(more, "k string, v long").write.mode("append").json(src)
    assert sorted(map(tuple, spark.read.parquet(out + "/v1").collect())) == [("a", 5), ("b", 2)]
    turns = spark.createDataFrame([(1, "user", "ab"), (1, "assistant", "c"), (2, "user", "")], "conv_id long, role string, text string")
    turns.write.json(src + "2")
    q = P.conversation_state(P.stream_lines(spark, src + "2", "conv_id long, role string, text string")).writeStream.format("memory").queryName("conv").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from conv").collect())) == [(1, 2, 1, 3), (2, 1, 0, 0)]
    state = [0]
    assert P.run_until_complete(lambda: state.__setitem__(0, state[0] + 1), lambda: state[0], 3) and not P.run_until_complete(lambda: None, lambda: 0, 1, 2)
