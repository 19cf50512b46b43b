"""Scalar functions over text columns: token estimates, cuts, line handling, markers, patches, answers, cache keys."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends that Python's splitlines knows (fixed values).
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def tokens_third(text: Column) -> Column:
    """Length in characters over three, rounded down: the estimate for packing."""
    return (F.length(text) / 3).cast("long")


def tokens_third_up(text: Column) -> Column:
    """At least one, else length over three rounded up: the estimate for batching."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 2) / 3)).cast("long")


def tokens_quarter(text: Column) -> Column:
    """Length over four, rounded down: the estimate for cost reports. It can be 0."""
    return F.floor(F.length(text) / 4).cast("long")


def token_counter(path: str) -> Callable[[Column], Column]:
    """Counts a text's tokens by a tokenizer's file: a counter for reports where an estimate isn't enough. A null has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _tokenizer(path).encode
        return texts.map(lambda t: len(encode(t, add_special_tokens=False).ids) if t else 0)

    return count


@lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def shown(value: Column, kind: str = "int") -> Column:
    """A number for a report: int with thousands apart, float with one place, pct of 1 with one place; a dash for null."""
    text = {"int": F.format_number(F.bround(value, 0), 0), "float": F.format_string("%.1f", value.cast("double")), "pct": F.format_string("%.1f%%", value * 100)}[kind]
    return F.when(value.isNull(), "—").otherwise(text)


def truncate(text: Column, n: int) -> Column:
    """The first n characters; 0 means all."""
    return text if not n else F.left(text, F.lit(n))


def split_lines(text: Column) -> Column:
    """Lines without their ends, as Python's splitlines: a final line end opens no further line."""
    parts = F.split(text, _LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncate_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1 and both included, cut to what is there."""
    lines = split_lines(text)
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(end, F.size(lines)) - first + 1)), "\n")


def numbered(lines: Column, start: Column) -> Column:
    return F.transform(lines, lambda x, i: F.concat((start + i).cast("string"), F.lit(" "), x))


def unnumbered(text: Column) -> Column:
    """Without ``## `` lines and without the numbers that begin lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.startswith("## "))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\d+ ", "")), "\n")


def marked_files(text: Column, dialect: str = "anywhere") -> Column:
    """Paths of ``[start of path]`` markers. Dialects: anywhere; line (alone on a line, blanks may follow); strict."""
    pattern = {"anywhere": r"\[start of ([^\]]+)\]", "line": r"(?m)^\[start of ([^\]]+)\]\s*$", "strict": r"(?m)^\[start of ([^\]]+)\]$"}[dialect]
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def patched_files(patch: Column) -> Column:
    """Files that a unified diff writes, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.+)$"), 1))


def added_lines(patch: Column, least: int = 1) -> Column:
    """A diff's added lines, stripped, of ``least`` characters or more, once each; file headers are none."""
    lines = F.filter(F.split(patch, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return _stripped(F.transform(lines, lambda x: F.substring(x, 2, 1 << 30)), least)


def stripped_lines(text: Column, least: int = 1) -> Column:
    """A text's whole lines, stripped, of ``least`` characters or more, once each."""
    return _stripped(F.split(text, "\n"), least)


def _stripped(lines: Column, least: int) -> Column:
    cut = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(cut, lambda x: F.length(x) >= least))


def is_readme(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).startswith("readme")


def comparator_answer(text: Column) -> Column:
    """'a' or 'b' as a judge's answer names one of them, null if both or neither."""
    low = F.lower(F.trim(text))
    a, b = (low == "a") | low.contains("file_a") | low.contains("file a"), (low == "b") | low.contains("file_b") | low.contains("file b")
    return F.when(a & ~b, "a").when(b & ~a, "b")


def list_answer(text: Column) -> Column:
    """The first bracketed JSON array of strings, else null."""
    found = F.regexp_extract(text, r"(?s)\[.*?\]", 0)
    kind = F.schema_of_variant(F.try_parse_json(F.when(found != "", found)))
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(found, "array<string>"))


def fenced_blocks(text: Column) -> Column:
    """The contents of code fences, with or without a language tag."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:[A-Za-z]+)?\s*\n(.*?)```"), 1)


def json_objects(text: Column) -> Column:
    """JSON objects of a text: the whole of it if it parses to one (or to an array's objects), else its fenced blocks'.

    Blocks that don't parse are skipped, and so is whatever is no object. Elements are JSON strings.
    """

    def dicts(source: Column) -> Column:
        kind = F.schema_of_variant(F.try_parse_json(source))
        listed = F.from_json(source, "array<string>")
        return F.when(kind.startswith("OBJECT"), F.array(source)).when(kind.startswith("ARRAY"), F.filter(listed, lambda x: F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"))).otherwise(F.array().cast("array<string>"))

    whole = F.schema_of_variant(F.try_parse_json(text)).isNotNull()
    blocks = F.flatten(F.transform(F.filter(fenced_blocks(text), lambda x: F.try_parse_json(x).isNotNull()), dicts))
    return F.when(whole, dicts(text)).otherwise(blocks)


def function_calls(text: Column) -> Column:
    """Objects that have the key ``function``."""
    return F.filter(json_objects(text), lambda x: F.get_json_object(x, "$.function").isNotNull())


def section(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag> on lines of their own, null if nothing does."""
    return F.when(text.rlike(rf"(?s)<{tag}>\n.*?\n</{tag}>"), F.regexp_extract(text, rf"(?s)<{tag}>\n(.*?)\n</{tag}>", 1))


def files_with_content(text: Column) -> Column:
    """array<struct<path, content>> of files between start and end markers; content '' where the end is missing."""
    paths = marked_files(text, "line")

    def content(path: Column) -> Column:
        begin = F.concat(F.lit("[start of "), path, F.lit("]\n"))
        end = F.concat(F.lit("\n[end of "), path, F.lit("]"))
        tail = F.substr(text, F.instr(text, begin) + F.length(begin))
        return F.when((F.instr(text, begin) > 0) & (F.instr(tail, end) > 0), F.substr(tail, F.lit(1), F.instr(tail, end) - 1)).otherwise("")

    return F.transform(paths, lambda p: F.struct(p.alias("path"), content(p).alias("content")))


#: A file's section of a prompt, from its start marker to the end marker of the same path (fixed format).
_SECTION = r"(?s)\[start of (.+?)\]\n(.*?)\n\[end of \1\]"


def prompt_parts(text: Column) -> Column:
    """struct(header, footer, separator, blocks map<path, section>, order array<path>) of a prompt with file sections.

    separator is what stands between the first two, a line feed if there is one section or none; of a path's
    sections the first counts. Without any the whole text is the header.
    """
    between = F.split(text, _SECTION, -1)
    paths, whole = F.regexp_extract_all(text, F.lit(_SECTION), 1), F.regexp_extract_all(text, F.lit(_SECTION), 0)
    firsts = F.filter(F.arrays_zip(paths.alias("path"), whole.alias("section"), F.sequence(F.lit(1), F.greatest(F.size(paths), F.lit(1))).alias("k")), lambda x: x["path"].isNotNull() & (F.array_position(paths, x["path"]) == x["k"]))
    return F.struct(
        between[0].alias("header"),
        F.when(F.size(paths) > 0, F.element_at(between, -1)).otherwise("").alias("footer"),
        F.when(F.size(paths) > 1, F.get(between, F.lit(1))).otherwise("\n").alias("separator"),
        F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["path"], x["section"]))).alias("blocks"),
        F.array_distinct(paths).alias("order"),
    )


def requirement(line: Column) -> Column:
    """struct(name, version) of a requirements line, null for blanks, comments and options."""
    bare = F.trim(line)
    name = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    version = F.trim(F.regexp_extract(F.regexp_replace(bare, r"\s*#.*$", ""), r"((?:[<>=!~]=?|===).*)$", 1))
    return F.when((bare != "") & ~bare.startswith("#") & ~bare.startswith("-") & (name != ""), F.struct(name.alias("name"), F.when(version != "", version).alias("version")))


def graph_identity(key: Column) -> Column:
    """struct(repo, commit) of a key repo__commit with 40 hex digits, split at the last double underscore; else null."""
    pattern = r"^(.*)__([0-9a-f]{40})$"
    return F.when(key.rlike(pattern), F.struct(F.regexp_extract(key, pattern, 1).alias("repo"), F.regexp_extract(key, pattern, 2).alias("commit")))


def model_slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, NUL between them."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def last_segment(node_id: Column) -> Column:
    return F.substring_index(node_id, "-", -1)


def comparisons(n: Column) -> Column:
    """How many comparisons a merge sort of n needs, by estimate: 0 for one item or none."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.log2(n)) - n + 1)).cast("long")


def parse_signals(spec: str, known: tuple) -> list[str]:
    """A comma-separated list of signals in their fixed order; unknown ones are refused, "all" and "none" are short for them."""
    names = [x.strip() for x in spec.split(",") if x.strip()]
    if names == ["all"]:
        return list(known)
    if names in ([], ["none"]):
        return []
    if wrong := [x for x in names if x not in known]:
        raise ValueError(f"unknown signals: {', '.join(wrong)}")
    return [x for x in known if x in names]


def python_json(text: str) -> list[dict]:
    """json_objects on the driver."""
    try:
        found = json.loads(text)
    except ValueError:
        found = []
        for block in re.findall(r"```(?:[A-Za-z]+)?\s*\n(.*?)```", text, re.S):
            try:
                one = json.loads(block)
            except ValueError:
                continue
            found += one if isinstance(one, list) else [one]
    return [x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict)]
