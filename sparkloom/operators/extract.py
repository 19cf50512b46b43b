"""Python sources to graph rows: a parse of each file in the workers, name resolution as joins.

``extract`` reads (path, content) rows once and gives typed facts; ``build_graph`` turns them into
nodes and edges. Files that don't parse give an error fact and nothing else.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import requirement
from .graph import PropertyGraph
from .lineage import numbered

#: Folders whose files are never read (fixed values).
SKIPPED_FOLDERS = (".git", "__pycache__", ".venv", ".venv_alpine", "node_modules", ".mypy_cache", ".pytest_cache", "htmlcov", "build", "dist", ".eggs", ".tox")
FACTS = "path string, seq long, kind string, id string, label string, source string, target string, name string, owner string, line_start long, line_end long, props map<string,string>"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)


def element_id(kind: str, *parts: object) -> str:
    return "-".join([kind, *map(str, parts)])


def edge_id(source: str, rel: str, target: str) -> str:
    return f"{source}-{rel}-{target}"


def complexity(node: ast.AST) -> int:
    """Cyclomatic complexity: one, one for each branch, and one for each further operand of a boolean operator."""
    total = 1
    for x in ast.walk(node):
        total += isinstance(x, _BRANCHES)
        total += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
    return total


def class_complexity(node: ast.ClassDef) -> int:
    """The sum over all functions in it, nested ones again, at least one."""
    return max(1, sum(complexity(x) for x in ast.walk(node) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))))


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Name):
        return node.id
    return ast.unparse(node)


def _exception(node: ast.AST | None) -> str | None:
    """A raised or caught name: Name, Attribute's last part, or the callee of a call; tuples have none."""
    if isinstance(node, ast.Call):
        return _exception(node.func)
    if isinstance(node, ast.Name):
        return node.id
    return node.attr if isinstance(node, ast.Attribute) else None


class FileFacts:
    """The facts of one parsed file, in source order."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows = path, text, []
        self.lines = text.splitlines()
        self.file = element_id("File", path)
        self.variables: dict[tuple[str, str], str] = {}

    def add(self, kind: str, **values) -> None:
        props = {k: str(v) for k, v in (values.pop("props", None) or {}).items() if v is not None}
        self.rows.append({"path": self.path, "seq": len(self.rows), "kind": kind, "props": props} | values)

    def node(self, kind: str, ident: str, label: str, parent: str, rel: str = "CONTAINS", reverse: bool = False, **props) -> None:
        self.add("node", id=ident, label=label, props={"meta_type": kind} | props, line_start=props.get("line_start"), line_end=props.get("line_end"))
        s, t = (ident, parent) if reverse else (parent, ident)
        self.add("edge", id=edge_id(s, rel, t), label=rel, source=s, target=t)

    def code(self, n: ast.AST) -> dict:
        source = "\n".join(self.lines[n.lineno - 1 : n.end_lineno])
        return {"name": n.name, "line_start": n.lineno, "line_end": n.end_lineno, "source_code": source, "docstring": ast.get_docstring(n)}

    def decorators(self, n: ast.AST, target: str) -> None:
        for d in n.decorator_list:
            name = _dotted(d)
            self.node("Decorator", element_id("Decorator", target, name), name, target, "DECORATES", True, name=name, line_start=d.lineno)

    def function(self, n, parent: str, kind: str, owner: str | None) -> None:
        ident = element_id("Method", self.path, owner, n.name) if owner else element_id("Function", self.path, n.name)
        more = {"return_type": ast.unparse(n.returns) if n.returns else None, "is_async": isinstance(n, ast.AsyncFunctionDef), "complexity": complexity(n)}
        if owner:
            names = {_dotted(d) for d in n.decorator_list}
            more |= {"is_staticmethod": "staticmethod" in names, "is_classmethod": "classmethod" in names}
        self.node(kind, ident, n.name, parent, **self.code(n), **more)
        self.decorators(n, ident)
        self.uses(n, ident, owner)

    def uses(self, fn, ident: str, owner: str | None) -> None:
        """Raw calls, raises and handlers of a function; other files resolve the calls."""
        held: dict[str, str] = {}
        for x in ast.walk(fn):
            if isinstance(x, ast.Assign) and (name := _exception(x.value)) and name[:1].isupper():
                held |= {t.id: name for t in x.targets if isinstance(t, ast.Name)}
        for x in ast.walk(fn):
            if isinstance(x, ast.Call):
                if isinstance(x.func, ast.Name):
                    self.add("call", source=ident, name=x.func.id, owner=None)
                elif isinstance(x.func, ast.Attribute):
                    own = isinstance(x.func.value, ast.Name) and x.func.value.id in ("self", "cls")
                    self.add("call", source=ident, name=x.func.attr, owner=(owner or "") if own else None)
            elif isinstance(x, ast.Raise) and (name := _exception(x.exc)):
                name = held.get(name, name)
                if name[:1].isupper():
                    self.exception(ident, "RAISES", name)
            elif isinstance(x, ast.ExceptHandler):
                name = "Exception" if x.type is None else _exception(x.type)
                if name:
                    self.exception(ident, "CATCHES", name)

    def exception(self, ident: str, rel: str, name: str) -> None:
        self.node("Exception", element_id("Exception", name), name, ident, rel, name=name)

    def variable(self, n: ast.AST, parent: str) -> None:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target]
        for t in targets:
            if isinstance(t, ast.Name):
                ident = element_id("Variable", parent, t.id)
                self.variables[parent, t.id] = ident
                self.node("Variable", ident, t.id, parent, name=t.id, line_start=n.lineno, value=ast.unparse(n.value) if n.value is not None else None)

    def annotations(self, scope: ast.AST, parent: str) -> None:
        """Annotated names anywhere in a scope's tree type the scope's variable of that name."""
        for x in ast.walk(scope):
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and (ident := self.variables.get((parent, x.target.id))):
                name = ast.unparse(x.annotation)
                self.node("TypeAnnotation", element_id("TypeAnnotation", name), name, ident, "HAS_TYPE", name=name)

    def imports(self, tree: ast.Module) -> None:
        k = 0
        for n in tree.body:
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                module = ("." * n.level + (n.module or "")) if isinstance(n, ast.ImportFrom) else None
                for a in n.names:
                    self.node("Import", element_id("Import", self.file, k), a.name, self.file, module_path=module or a.name, imported_name=a.asname or a.name, line_number=n.lineno)
                    k += 1
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.add("import", name=a.asname or a.name.split(".")[0], line_start=n.lineno)
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    if a.name != "*":
                        self.add("import", name=a.name, line_start=n.lineno)

    def run(self) -> list[dict]:
        self.add("node", id=self.file, label=self.path.rsplit("/", 1)[-1], props={"meta_type": "File", "relative_path": self.path, "line_count": len(self.lines)})
        try:
            tree = ast.parse(self.text)
        except (SyntaxError, ValueError, RecursionError) as e:
            self.add("error", name=type(e).__name__, label=str(e)[:200])
            return self.rows
        self.imports(tree)
        for n in tree.body:
            if isinstance(n, ast.ClassDef):
                ident = element_id("Class", self.path, n.name)
                self.node("Class", ident, n.name, self.file, **self.code(n), complexity=class_complexity(n))
                self.decorators(n, ident)
                for b in n.bases:
                    if name := (b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None):
                        self.add("base", source=ident, name=name)
                for x in n.body:
                    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        self.function(x, ident, "Method", n.name)
                    elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                        self.variable(x, ident)
                self.annotations(n, ident)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(n, self.file, "Function", None)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                self.variable(n, self.file)
        self.annotations(tree, self.file)
        return self.rows


def extract(files: DataFrame) -> DataFrame:
    """FACTS of Python files (path, content): nodes, edges, and raw calls, imports, bases and errors."""
    names = [x.strip().split(" ")[0] for x in FACTS.split(", ")]
    kinds = {"seq": pa.int64(), "line_start": pa.int64(), "line_end": pa.int64(), "props": pa.map_(pa.string(), pa.string())}

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = FileFacts(path, text or "").run()
                columns = [pa.array([list(r["props"].items()) if n == "props" else r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("path", "content").mapInArrow(run, FACTS)


def folders(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the folders above the files: ids, and CONTAINS edges down to folders and files. The root is '.'."""
    parts = F.split("path", "/")
    ups = files.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("n"), parts.alias("p"))
    name = lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice("p", 1, n), "/"))
    rows = ups.select("path", name(F.col("n")).alias("folder"), F.when(F.col("n") == F.size("p") - 1, F.concat(F.lit("File-"), "path")).otherwise(F.concat(F.lit("Directory-"), name(F.col("n") + 1))).alias("child")).distinct()
    nodes = rows.select(F.concat(F.lit("Directory-"), "folder").alias("id"), F.element_at(F.split("folder", "/"), -1).alias("label"), "folder").distinct()
    edges = rows.select(F.concat(F.lit("Directory-"), "folder").alias("source"), F.col("child").alias("target")).distinct()
    return nodes, edges


def wanted(files: DataFrame) -> DataFrame:
    """Python files outside the skipped folders."""
    parts = F.split("path", "/")
    return files.where(F.col("path").endswith(".py") & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS))))


def resolve_calls(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target of calls whose target is clear.

    ``self.f`` goes to the Methods named f: the only one whose id holds the class's name, else the
    only one at all. A plain name goes to the only Function, else the only Class, else the only
    candidate. Calls of oneself are dropped.
    """
    calls = facts.where("kind = 'call'").select("source", "name", "owner").distinct()
    found = calls.join(nodes.where(F.col("meta_type").isin("Function", "Method", "Class")).select(F.col("id").alias("target"), F.col("label").alias("name"), "meta_type"), "name")
    only = lambda flag: F.when(F.count_if(flag) == 1, F.max(F.when(flag, F.col("target"))))
    kind = lambda k: F.col("meta_type") == k
    mine = kind("Method") & (F.col("owner") != "") & F.contains(F.col("target"), F.col("owner"))
    own = F.coalesce(only(mine), only(kind("Method")))
    plain = F.coalesce(only(kind("Function")), only(kind("Class")), F.when(F.count("*") == 1, F.max("target")))
    one = found.groupBy("source", "name", "owner").agg(F.when(F.max("owner").isNotNull(), own).otherwise(plain).alias("target"))
    return one.where("target is not null and target <> source").select("source", "target").distinct()


def resolve_imports(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target: the first Function, Class or Method of the imported name, else the only node of that name.

    The source is the function whose lines hold the import, the innermost if several do, else the file.
    """
    raw = facts.where("kind = 'import'").select("path", "seq", "name", "line_start")
    cands = nodes.where(F.col("meta_type") != "Import").select(F.col("id").alias("target"), F.col("label").alias("name"), "meta_type", "ord")
    code = F.col("meta_type").isin("Function", "Class", "Method")
    hits = raw.join(cands, "name").groupBy("path", "seq", "line_start").agg(F.coalesce(F.min_by(F.when(code, F.col("target")), F.when(code, F.col("ord"))), F.when(F.count("*") == 1, F.max("target"))).alias("target"))
    spans = facts.where("kind = 'node'").where(F.col("props")["meta_type"].isin("Function", "Method")).select("path", F.col("id").alias("fn"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    inside = hits.alias("h").join(spans.alias("s"), (F.col("h.path") == F.col("s.path")) & F.col("h.line_start").between(F.col("s.a"), F.col("s.b")), "left")
    out = inside.groupBy("h.path", "h.seq", "h.target").agg(F.max_by("s.fn", "s.a").alias("fn")).where("target is not null")
    return out.select(F.coalesce("fn", F.concat(F.lit("File-"), "path")).alias("source"), "target").where("source <> target").distinct()


def resolve_bases(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target: each base class by the first Class of that name."""
    raw = facts.where("kind = 'base'").select("source", "name")
    classes = nodes.where("meta_type = 'Class'").groupBy(F.col("label").alias("name")).agg(F.min_by("id", "ord").alias("target"))
    return raw.join(classes, "name").where("source <> target").select("source", "target").distinct()


def dependencies(requirements: DataFrame) -> DataFrame:
    """name, version of a requirements file's lines (column line)."""
    return requirements.select(requirement(F.col("line")).alias("r")).where("r is not null").select("r.*").dropDuplicates(["name"])


def build_graph(files: DataFrame, requirements: DataFrame | None = None) -> tuple[PropertyGraph, DataFrame]:
    """(graph, errors) of a source tree's files (path, content). requirements: lines of the root's requirements file."""
    files = wanted(files)
    facts = extract(files).cache()
    empty = F.create_map().cast("map<string,string>")
    dirs, contains = folders(files)
    order = F.struct("path", "seq")
    first = facts.where("kind = 'node'").groupBy("id").agg(F.max_by("label", order).alias("label"), F.max_by("props", order).alias("props"), F.min(order).alias("at"))
    code = first.select("id", "label", "props", F.concat(F.lit("1"), "at.path").alias("k1"), "at.seq")
    tree = dirs.select("id", "label", F.create_map(F.lit("meta_type"), F.lit("Directory"), F.lit("relative_path"), F.col("folder")).alias("props"), F.concat(F.lit("0"), "folder").alias("k1"), F.lit(0).cast("long").alias("seq"))
    nodes = tree.unionByName(code)
    edges = contains.withColumn("label", F.lit("CONTAINS")).unionByName(facts.where("kind = 'edge'").select("source", "target", "label"))
    if requirements is not None:
        deps = dependencies(requirements)
        nodes = nodes.unionByName(deps.select(F.concat(F.lit("Dependency-"), "name").alias("id"), F.col("name").alias("label"), F.map_filter(F.create_map(F.lit("meta_type"), F.lit("Dependency"), F.lit("name"), F.col("name"), F.lit("version"), F.col("version")), lambda k, v: v.isNotNull()).alias("props"), F.concat(F.lit("2"), "name").alias("k1"), F.lit(0).cast("long").alias("seq")))
        names = deps.agg(F.array_sort(F.collect_list("name")).alias("names"))  # one row: the lines of one file
        edges = edges.unionByName(files.join(F.broadcast(names)).select(F.concat(F.lit("File-"), "path").alias("source"), F.explode("names").alias("n")).select("source", F.concat(F.lit("Dependency-"), "n").alias("target"), F.lit("DEPENDS_ON").alias("label")))
    # Numbered by folder, file and place in the file.
    nodes = numbered(nodes.select("id", "label", F.col("props")["meta_type"].alias("meta_type"), "props", "k1", "seq"), "ord", "k1", "seq", "id").drop("k1", "seq")
    for rel, df in (("CALLS", resolve_calls(facts, nodes)), ("IMPORTS", resolve_imports(facts, nodes)), ("INHERITS", resolve_bases(facts, nodes))):
        edges = edges.unionByName(df.withColumn("label", F.lit(rel)))
    edges = edges.distinct().withColumn("id", F.concat_ws("-", "source", "label", "target"))
    edges = numbered(edges.select("id", "label", "source", "target", empty.alias("props")), "ord", "id")
    return PropertyGraph(nodes, edges), facts.where("kind = 'error'").select("path", F.col("name").alias("error"), F.col("label").alias("detail"))


def signatures_of(schema_json: str) -> list[tuple[str, str, str]]:
    """(label, source_type, target_type) of {"EDGE": [["Source", "Target"], ...]}."""
    return [(rel, s, t) for rel, pairs in json.loads(schema_json).items() for s, t in pairs]
