"""The builder, caches, loaders and list-wise ranking over small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import builder as B
from sparkloom.operators import caches as K
from sparkloom.operators import evaluate as E
from sparkloom.operators import graph as G
from sparkloom.operators import localise as L
from sparkloom.operators import repair as RP
from sparkloom.operators import reports as RE
from sparkloom.operators import spans as S
from sparkloom.operators import validate as VA
from sparkloom.operators import write as WR
from sparkloom.operators.lineage import numbered
from sparkloom.sources import files as FS

FIVE = [(f"m{k}.py", f"class C{k}:\n    def run{k}(self):\n        return f{k}()\n\ndef f{k}():\n    return {k}\n") for k in range(5)]


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_batch_size_changes_commits_only(spark):
    files = df(spark, FIVE, "path string, content string")
    ran = sorted(B.EXECUTORS.values(), key=lambda e: e.phase)
    graphs = {}
    for size in (0, 2):
        graph, told = B.build(spark, files, ran, batch_size=size, verify=VA.dangling)
        graphs[size] = {r.id for r in graph.nodes.collect()}, {r.id for r in graph.edges.collect()}, told
    assert graphs[0][:2] == graphs[2][:2] and graphs[2][2].committed_batches > graphs[0][2].committed_batches
    assert graphs[0][2].verification_passed and not graphs[0][2].errors and "0 skipped" in str(graphs[0][2])
    assert "Function-m3.py-f3" in graphs[0][0] and "Method-m1.py-C1-run1-CALLS-Function-m1.py-f1" in graphs[0][1]


def test_a_failing_executor_does_not_end_the_build(spark):
    files = df(spark, FIVE[:1], "path string, content string")

    def broken(ctx):
        raise ValueError("broken")

    ran = [B.EXECUTORS["python:folders"], B.Executor("bad", 1, broken), B.EXECUTORS["python:sources"]]
    graph, told = B.build(spark, files, ran)
    assert [e["source"] for e in told.errors] == ["bad"] and graph.nodes.where("meta_type = 'Class'").count() == 1
    meta = G.from_rows(spark, [("A", "A"), ("B", "B"), ("E", "E")], [], {"A": {"meta_type": "NodeType", "executor": "x:y"}, "B": {"meta_type": "NodeType", "executor": "x:y"}, "E": {"meta_type": "EdgeType"}})
    assert [tuple(r) for r in B.schema_executors(meta).collect()] == [("x:y", ["A", "B"])]
    with pytest.raises(LookupError, match="x:y.*A, B"):
        B.resolve(B.schema_executors(meta))


def test_built_once_a_commit(spark, tmp_path):
    calls = []

    def load():
        calls.append(1)
        return df(spark, FIVE[:2], "path string, content string")

    ran = [B.EXECUTORS["python:folders"]]
    key = "org__repo__" + "0" * 40
    out = B.build_all(spark, {key: load, "bad": lambda: 1 / 0}, str(tmp_path), ran)
    assert out[key] == "built" and "division" in out["bad"]
    again, told = B.build_cached(spark, key, str(tmp_path), load, ran)
    assert told is None and len(calls) == 1 and again.nodes.count() == 3


def test_caches(spark, tmp_path):
    nodes = df(spark, [("a", "Function", {"name": "auth"}), ("b", "Function", {"name": "auth"}), ("c", "Function", {"name": "db"})], "id string, meta_type string, props map<string,string>")
    at, cache = str(tmp_path / "ix"), str(tmp_path / "cache")
    asked = []
    spend = spark.sparkContext.accumulator(0)

    def provider(texts):
        spend.add(len(texts))
        return [[1.0, 0.0] for _ in texts]

    args = (cache, "m|2", "m", 2)
    assert K.precompute(spark, {"g1": nodes}, at, *args, provider) == {"built": 1, "skipped": 0} and spend.value == 2
    assert K.precompute(spark, {"g1": nodes, "g2": nodes.where("id <> 'a'")}, at, *args, provider) == {"built": 1, "skipped": 1} and spend.value == 2 and not asked
    assert K.is_complete(spark, f"{at}/g1", "m|2") and not K.is_complete(spark, f"{at}/g1", "other") and not K.is_complete(spark, f"{at}/none")
    spark.read.parquet(f"{at}/g2/rows").limit(1).write.mode("append").parquet(f"{at}/g2/rows")
    assert not K.is_complete(spark, f"{at}/g2")  # more rows than its stamp says
    assert K.open_cache(spark, cache, "m|2", "m", 2)[0].count() == 2
    fresh, version = K.open_cache(spark, cache, "m|3", "m", 3)
    assert fresh.count() == 0 and version == 1
    other = str(tmp_path / "other")
    assert K.backfill(spark, [f"{at}/g1", f"{at}/g2"], other, "m|2", "m", 2) == {"added": 1, "skipped": 1, "vectors": 2}
    assert K.backfill(spark, [f"{at}/g1"], other, "m|2", "m", 2)["vectors"] == 0


def test_graph_document_round_trip(spark, tmp_path):
    g = G.from_rows(spark, [("a", "A"), ('b"', "B")], [("e", "R", "a", 'b"')], {"a": {"meta_type": "X", "q": 'x "y"\n'}, "e": {"w": 1}})
    for style in ("short", "long"):
        FS.write_graph_document(g, f"{tmp_path}/{style}", style)
        back = FS.read_graph(spark, f"{tmp_path}/{style}")
        assert [tuple(r) for r in back.nodes.orderBy("ord").collect()] == [tuple(r) for r in g.nodes.orderBy("ord").collect()]
        assert [(r.id, r.source, r.target, r.props) for r in back.edges.collect()] == [("e", "a", 'b"', {"w": "1"})]


def test_loaders(spark, tmp_path):
    assert FS.read_corpus(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c" / "i-1").mkdir(parents=True)
    (tmp_path / "c" / "i-1" / "documents.jsonl").write_text('{"id": "a.py", "contents": "x"}\n\n{"id": "b.py"}\n')
    assert sorted(map(tuple, FS.read_corpus(spark, str(tmp_path / "c")).collect())) == [("i-1", "a.py", "x"), ("i-1", "b.py", "")]
    (tmp_path / "p.jsonl").write_text('{"instance_id": "i", "text": "old"}\n{"instance_id": "i", "text": "new"}\n{"instance_id": "j"}\n')
    assert sorted(map(tuple, FS.prompt_texts(spark, str(tmp_path / "p.jsonl")).collect())) == [("i", "new"), ("j", "")]
    df(spark, [("k", "t")], "instance_id string, text string").write.parquet(f"{tmp_path}/ds/split=dev")
    assert [tuple(r) for r in FS.prompt_texts(spark, f"{tmp_path}/ds").collect()] == [("k", "t")]
    rows = df(spark, [(0, "a"), (1, None), (2, None)], "line_no long, repo string")
    assert sorted(map(tuple, FS.skip_first(rows, 1, defaults={"repo": ""}).collect())) == [(1, ""), (2, "")]


def test_rank_run_resumes(spark, tmp_path):
    blocks = df(spark, [(i, k, f"{i}{k}.py", f"### {i}{k}.py\nx") for i in "abc" for k in range(3)] + [("d", 0, "one.py", "### one.py")], "instance string, pos int, item string, block string")
    issues = df(spark, [(i, "broken") for i in "abcd"], "instance string, issue string")

    def ask(prompt, temperature, thinking):
        if "### c0" in prompt:
            raise OSError("no answer")
        names = [x[4:] for x in prompt.split("\n") if x.startswith("### ")]
        return json.dumps([names[-1], "unknown.py"])

    path = str(tmp_path / "progress")
    assert L.rank_run(spark, blocks, issues, path, ask, dry_run=True) == {"instances": 4, "skipped": 0, "processed": 0, "failed": 0, "comparisons": 0, "estimated_comparisons": 4}
    first = L.rank_run(spark, blocks, issues, path, ask, "m", limit=2)
    assert first["processed"] == 2 and first["comparisons"] == 2
    rest = L.rank_run(spark, blocks, issues, path, ask, "m", spec={"mode": "list"})
    assert (rest["skipped"], rest["processed"], rest["failed"], rest["comparisons"]) == (2, 2, 1, 3)
    got = {r.instance_id: r for r in spark.read.json(path).collect()}
    assert got["a"].ranked_files == ["a2.py", "a0.py", "a1.py"] and got["c"].ranked_files == ["c0.py", "c1.py", "c2.py"] and got["c"].failed
    assert got["d"].ranked_files == ["one.py"] and got["d"].n_comparisons == 0
    assert L.rank_run(spark, blocks, issues, path, ask)["instances"] == 0


def test_repair_run_asks_twice_on_blanks(spark, tmp_path):
    prompts = df(spark, [("a", "p1"), ("b", "p2")], "instance string, prompt string")
    path = str(tmp_path / "pred")
    told = L.repair_run(spark, prompts, path, lambda prompt, thinking: "" if thinking and prompt == "p2" else f"answer {thinking}", "m")
    assert told == {"processed": 2, "retried": 1, "skipped": 0}
    got = {r.instance_id: (r.full_output, r.thinking_retry) for r in spark.read.json(path).collect()}
    assert got == {"a": ("answer True", False), "b": ("answer False", True)}
    assert L.repair_run(spark, prompts, path, lambda *x: "x")["processed"] == 0
    made = prompts.select(L.repair_prompt(F.lit("it fails"), F.lit("code"), "node").alias("p")).first().p
    assert "it fails" in made and "### name in path" in made


def test_blocks_and_signals(spark):
    touches = df(spark, [("i", 0, "Method-a-run", "a.py", {"meta_type": "Method", "name": "run", "docstring": "Runs.\nMore", "line_start": "3", "line_end": "9", "source_code": "def run():\n  pass"}), ("i", 1, "X-b", "b.txt", {}), ("i", 2, "Method-a-run", "a.py", {})], "instance string, seq int, id string, path string, props map<string,string>")
    row = L.file_signals(touches, df(spark, [("i", "Method-a-run", 0.5)], "instance string, id string, sim double")).select("path", "touch_freq", "sim_max", L.file_block(["freq", "sim_max", "parts"]).alias("b"), L.file_block([]).alias("bare")).first()
    assert row.b == '### a.py\ntouched: 2 | similarity: 0.5\n- Method run (lines 3-9): "Runs."\n  def run(): |   pass' and row.bare == "### a.py"
    nodes = df(spark, [("i", "Method-a-run", "a.py", "Method", 3, 9, " x\ny ")], "instance string, id string, path string, kind string, line_start int, line_end int, source_code string")
    block = L.node_signals(nodes, touches, touches.select("instance", "path")).select(L.node_block(["freq", "sim"]).alias("b")).first().b
    assert block == "### Method-a-run\nMethod | run | lines 3-9 | a.py\ntouched: 2\nx | y"
    assert L.parse_list('so ["a"] ["b"]') == ["a"] and L.parse_list("[1]") is None and L.parse_list(None) is None


def test_golden_values_of_reports(spark):
    usage = df(spark, [("s", "i", 100, 10, 1), ("s", "j", 300, 30, 2)], "stage string, instance string, prompt_tokens long, completion_tokens long, calls int")
    row = RE.usage_summary(usage).first()
    assert (row.n, row.avg_calls, row.prompt_mean, row.total_median, row.completion_p90) == (2, 1.5, 200.0, 220.0, 30.0)
    cost = RE.rerank_cost(df(spark, [("i", 100), ("i", 50)], "instance string, tokens long"), df(spark, [("i", 3), ("j", 0)], "instance string, n_calls long"), df(spark, [("i", 4)], "instance string, tokens long"))
    assert sorted(map(tuple, cost.collect())) == [("i", 2, 225, 20, 1.5), ("j", 0, 0, 0, None)]
    hunks = df(spark, [("i", 0, "a.py", 50, 60, 11, False), ("i", 1, "a.py", 40, 60, 21, False), ("i", 2, "a.py", 78, 78, 1, False), ("i", 3, "a.py", 78, 78, 0, False), ("i", 4, "n.py", 0, 0, 0, True), ("i", 5, "q.py", 1, 2, 2, False)], "instance string, hunk_id int, file string, h_start long, h_end long, count long, is_new_file boolean")
    nodes = df(spark, [("i", "n1", "a.py", 45, 78, 5), ("i", "n2", "a.py", 50, 60, 1), ("i", "n3", "a.py", 70, 78, 9)], "instance string, id string, file string, line_start long, line_end long, cost long")
    row = RE.pool_cover(hunks, nodes).first()
    # The insertion at a node's last line overlaps it and isn't inside; n2 (one hunk a token) is taken first, then n1.
    assert (row.n_hunks, row.contained, row.partial, row.outside, row.new_files, row.fallback_hunks, row.floor_tokens) == (6, 2, 2, 1, 1, 4, 6)
    assert row.line_share == pytest.approx(12 / 35)
    pools = df(spark, [("p", "i", "n2")], "pool string, instance string, id string")
    got = {r.pool: (r.pool_size, r.gt_nodes, r.gt_in_pool, r.pool_recall, r.contained) for r in RE.node_cover(hunks, nodes, pools).collect()}
    assert got == {"all": (3, 3, 3, 1.0, 2), "p": (1, 3, 1, pytest.approx(1 / 3), 1)}


def test_edits(spark):
    assert RP.apply_search_replace("a\r\nb\n", "a\n", "x") == "x\nb\n" and RP.apply_search_replace("a\n\nb", "\n", "c") == "a\nc\nb"
    assert RP.apply_search_replace("a\nb", "b", "") == "a\n" and RP.apply_search_replace("a", "", "b") is None and RP.apply_search_replace("a\na", "a", "b") is None
    files, index = {"p": "1\n2\n3\n4\n"}, {("f", "p"): (1, 1, "1"), ("g", "p"): (3, 3, "3")}
    patch, failed = RP.synthesise_nodes(files, [("f", "p", "one\nmore"), ("g", "p", "three")], index, [("p", "4", "four")])
    assert failed == 1 and "+one\n+more" in patch and "+four" in patch and "three" not in patch  # the first edit moves the second's lines
    binary = "diff --git a/i b/i\n--- a/i\n+++ b/i\nGIT binary patch\n@@ -1 +1 @@\ndiff --git a/t b/t\n--- a/t\n+++ b/t\n@@ -5 +5,2 @@\n"
    assert RP.hunks(binary) == [RP.Hunk("t", 5, 5, 1, False)]


def test_counter_of_a_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["plain words", "", None, "Zürich 日本"]
    got = [r.n for r in df(spark, [(t,) for t in texts], "t string").coalesce(1).select(T.token_counter(path)(F.col("t")).alias("n")).collect()]
    assert got == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]


def test_cardinality_rules_of_a_meta_graph(spark):
    meta = G.from_rows(spark, [("N", "Nation"), ("E", "HAS"), ("P", "name")], [("c", "LIMITS", "N", "E"), ("d", "LIMITS", "N", "E"), ("h", "HAS_PROPERTY", "N", "P")], {"N": {"meta_type": "NodeType"}, "E": {"meta_type": "EdgeType"}, "P": {"meta_type": "PropertyType"}, "c": {"minCount": 2}, "d": {"minCount": 5}})
    assert [tuple(r) for r in VA.cardinality_rules(meta).collect()] == [("Nation", "HAS", 2, None)]
    data = G.from_rows(spark, [("a", "A")], [], {"a": {"meta_type": "Nation"}})
    assert VA.first_error(VA.cardinality(data, VA.cardinality_rules(meta))) == "CARDINALITY_VIOLATION_MIN (data): a: HAS 0" and VA.first_error(VA.dangling(data)) == ""


def test_hints(spark):
    g = G.from_rows(spark, [(i, i) for i in "abc"], [("e", "R", "a", "b"), ("f", "S", "c", "b")])
    hint = lambda *p: [(r.depth, r.failing, r.message, r.edge_label, r.direction) for r in G.traverse_hint(g, df(spark, [("a",)], "start string"), list(p)).orderBy("depth").collect()]
    assert hint("Q") == [(1, True, "step 1 asks for Q, its hop has only R (out, 1)", "R", "out")]
    assert hint({"edge_label": "R", "direction": "in"}) == [(1, True, "step 1 asks for R going in, it only goes out", "R", "out")]
    two = hint("R", "S")
    assert [x[1] for x in two] == [False, False] and two[0][2] == "each step is met at its hop, but not one after another" and two[1][3:] == ("S", "in")


def test_loaded_graphs_are_kept_until_cleared(spark, tmp_path):
    (tmp_path / "graph_store").mkdir()
    (tmp_path / "graph_store" / "data.json").write_text('{"nodes": [{"id": "a"}], "edges": [], "allValues": {}}')
    first = FS.load_graph(spark, "data", str(tmp_path))
    assert first.nodes.count() == 1 and FS.load_graph(spark, "data", str(tmp_path)) is first
    FS.clear_graphs("data")
    assert FS.load_graph(spark, "data", str(tmp_path)) is not first
    FS.clear_graphs()
    with pytest.raises(G.GraphError, match="GRAPH_FILE_NOT_FOUND"):
        FS.load_graph(spark, "none", str(tmp_path))


def test_truncation_of_sections(spark):
    parts = [("a", "x" * 500), ("b", "y" * 40), ("c", "z" * 300), ("d", "w"), ("e", "")]
    own = RP.truncate_sections(parts, 4, 200, 400)
    assert own[0][1] == "x" * 100 + "\n[300 characters left out]\n" + "x" * 100 and own[1][1] == "y" * 40 and own[2][1].count("z") == 160 and own[3][1] == RP.STUB and len(own) == 4
    rows = df(spark, [(parts,)], "s array<struct<path:string,text:string>>").select(RP.truncated(F.col("s"), 4, 200, 400).alias("s")).first().s
    assert [tuple(r) for r in rows] == own


def test_bins_change_no_pair(spark):
    """Hunks and nodes of one file against all pairs, with bins far smaller than spans."""
    r = random.Random(7)
    nodes = [(k, "f", a, a + r.choice([0, 1, 5, 40, 300])) for k, a in enumerate(r.randrange(1, 400) for _ in range(60))]
    hunks = [(k, "f", a, a + max(c, 1) - 1, c, k % 9 == 0) for k, (a, c) in enumerate((r.randrange(0, 420), r.choice([0, 1, 2, 30])) for _ in range(80))]
    h = df(spark, hunks, "hunk_id int, file string, h_start long, h_end long, count long, is_new_file boolean")
    n = df(spark, nodes, "node_id int, file string, line_start long, line_end long")
    inside = lambda a, b, s, e, c: a <= s < b if c == 0 else a <= s and e <= b
    over = lambda a, b, s, e, c: a <= s <= b if c == 0 else s <= b and a <= e
    for how, test in (("contains", inside), ("overlaps", over)):
        want = {(k, m) for k, _, s, e, c, new in hunks for m, _, a, b in nodes if not new and test(a, b, s, e, c)}
        for lines in (3, 50, 10**6):
            got = [(x.hunk_id, x.node_id) for x in S.hunk_nodes(h, n, how, lines).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    kinds = {x.hunk_id: x["class"] for x in S.classify_hunks(h, n, 7).collect()}
    for k, _, s, e, c, new in hunks:
        own = "new" if new else "contained" if any(inside(a, b, s, e, c) for _, _, a, b in nodes) else "partial" if any(over(a, b, s, e, c) for _, _, a, b in nodes) else "outside"
        assert kinds[k] == own


def test_lines_searched_in_parts(spark):
    lines = df(spark, [("i", f"line number {k}") for k in range(40)] + [("j", "line number 3"), ("j", "")], "instance string, line string")
    texts = df(spark, [("x line number 3 y line number 31 line number 3",), ("line number 12",), (None,), ("",)], "text string")
    want = {("i", "line number 3"): 1, ("j", "line number 3"): 1, ("i", "line number 31"): 1, ("i", "line number 1"): 1, ("i", "line number 12"): 1}
    for size in (1 << 20, 100):
        assert {(x.instance, x.line): x.n_texts for x in E.leaks(lines, texts, size).collect()} == want
    assert E.leaks(lines.limit(0), texts).count() == 0


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("k"), "id").repartition(7)
    got = numbered(rows, "n", "k").orderBy("n").collect()
    assert [x.n for x in got] == list(range(1000)) and [x.k for x in got] == sorted(x.k for x in got)


def test_parts_of_prompts(spark):
    text = "head\n[start of a.py]\nx\n[end of a.py]\ntail"
    rows = df(spark, [(text,), ("no markers",), ("",)], "t string").coalesce(1).select(T.prompt_parts(F.col("t")).alias("p")).collect()
    assert tuple(rows[0].p) == ("head\n", "\ntail", "\n", {"a.py": "[start of a.py]\nx\n[end of a.py]"}, ["a.py"])
    assert tuple(rows[1].p) == ("no markers", "", "\n", {}, []) and tuple(rows[2].p) == ("", "", "\n", {}, [])


def test_broken_patterns_and_commits(spark):
    meta = G.from_rows(spark, [("p", "p"), ("q", "q"), ("r", "r")], [], {"p": {"meta_type": "PropertyType", "validationRegex": "[a"}, "q": {"meta_type": "PropertyType", "validationRegex": "a+"}, "r": {"meta_type": "NodeType"}})
    assert [(r.error_type, r.element_id) for r in VA.meta_checks(meta).collect()] == [("INVALID_REGEX", "p")]
    graph, told = WR.commit(spark, meta, WR.Batch(deleted_nodes=df(spark, [("zz",)], "id string")))
    assert graph is meta and told == {"status": "unsat", "committed": False, "message": "1 errors: ELEMENT_NOT_FOUND zz"}
    graph, told = WR.commit(spark, meta, WR.Batch(nodes=df(spark, [("n", None)], "id string, label string")))
    assert told["committed"] and told["nodes"] == 1 and graph.nodes.count() == 4
