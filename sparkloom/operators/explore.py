"""Tool calls over a graph: registry, validation, and the state machine of an exploration with an injected model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.text import python_json
from . import graph as G


def registry(graph: G.PropertyGraph) -> dict[str, Callable]:
    """Tool name -> callable with keyword arguments; each returns a list of dicts, whole and in a fixed order unless the call itself sets a limit."""
    spark = graph.nodes.sparkSession
    one = lambda column, value: spark.createDataFrame([(value,)], f"{column} string")
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {
        "get_element": lambda id, include=(): rows(G.get_element(graph, id, tuple(include))),
        "search_elements": lambda **kw: rows(G.search_elements(graph, **kw)),
        "get_neighbors": lambda id, direction="both", edge_label=None: rows(G.get_neighbors(graph, one("center", id), direction, edge_label).orderBy("id")),
        "traverse": lambda start_id, max_depth=3, pattern=None, limit_paths=None: rows(G.traverse(graph, one("start", start_id), max_depth, pattern, limit_paths).orderBy("node_ids", "edge_ids")),
        "find_connected": lambda id, type, edge_label=None, direction="in", max_depth=20: rows(G.find_connected(graph, one("start", id), type, edge_label, direction, max_depth)),
    }


def validate_calls(text: str, names: set[str]) -> tuple[list[tuple[str, dict]], list[str]]:
    """(calls, issues): calls of known tools, and a line for each other entry. A call is {"function": {"name": ..., "arguments": {...}}}."""
    calls, issues = [], []
    for entry in python_json(text):
        f = entry.get("function", {}) if isinstance(entry, dict) else None
        if not isinstance(f, dict):
            issues.append("an entry whose function isn't an object")
        elif not f.get("name"):
            issues.append("an entry without a function name")
        elif f["name"] not in names:
            issues.append(f"unknown function {f['name']}")
        elif not isinstance(f.get("arguments", {}), dict):
            issues.append(f"{f['name']}: arguments must be an object")
        else:
            calls.append((f["name"], f.get("arguments", {})))
    return calls, issues


def result_ids(result) -> list[tuple[str, str | None]]:
    """(id, label) of the nodes in any result shape: a row, rows, paths, or neighbours; edges are left out."""
    if isinstance(result, list):
        return [x for r in result for x in result_ids(r)]
    if not isinstance(result, dict):
        return []
    if "node_ids" in result:
        return [(i, None) for i in result["node_ids"]]
    own = [(result["id"], result.get("label"))] if result.get("id") and result.get("kind", "node") == "node" else []
    return own + result_ids(result.get("neighbors") or [])


@dataclass
class Exploration:
    touched: dict = field(default_factory=dict)
    rounds: int = 0
    calls: int = 0
    rejections: int = 0
    log: list = field(default_factory=list)


FEEDBACK = ("Answer with JSON tool calls only.", "Each call is an object whose function has a name and arguments.", "Use only the functions listed above.")


def explore(ask: Callable[[list[str], float], str], tools: dict[str, Callable], question: str, max_rounds: int = 20, max_calls: int = 50, temperature: float = 0.0, done: str = "DONE") -> Exploration:
    """Asks for calls and runs them until the model says it's done or a limit is met.

    After a rejected answer the temperature rises by 0.15, to 0.9 at most, and feedback lines take
    turns; three rejections in a row start the talk anew once, with six more rounds.
    """
    state, talk, row, reset, limit = Exploration(), [question], 0, False, max_rounds
    while state.rounds < limit and state.calls < max_calls:
        state.rounds += 1
        text = ask(talk, min(temperature + 0.15 * state.rejections, 0.9))
        calls, issues = validate_calls(text, set(tools))
        if not calls:
            if done in text:
                break
            state.rejections += 1
            row += 1
            if row >= 3 and not reset:
                talk, row, reset, limit = [question], 0, True, limit + 6
            else:
                talk += [text, FEEDBACK[(state.rejections - 1) % len(FEEDBACK)]]
            continue
        row = 0
        for name, args in calls[: max_calls - state.calls]:
            state.calls += 1
            try:
                result = tools[name](**args)
            except (G.GraphError, TypeError) as e:
                result = {"error": str(e)}
            state.log.append((name, args, isinstance(result, dict) and "error" in result))
            for i, label in result_ids(result):
                state.touched[i] = label or state.touched.get(i)
            talk.append(f"{name}: {render(result)}")
        talk += issues
    return state


def render(result, items: int = 20, chars: int = 500) -> str:
    """A result as text: its first items, long values cut."""
    if isinstance(result, dict):
        return ", ".join(f"{k}={str(v)[:chars]}" for k, v in result.items() if v is not None)
    lines = [render(r) if isinstance(r, dict) else str(r)[:chars] for r in result[:items]]
    return "\n".join(lines + ([f"({len(result) - items} more)"] if len(result) > items else []))


def call_counts(log):
    """fn, n, failures of logged calls (columns fn, failed)."""
    return log.groupBy("fn").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"))
