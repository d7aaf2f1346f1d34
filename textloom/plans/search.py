"""The planner: a specification over a corpus becomes one narrow plan.

A corpus is any DataFrame with ``file_type`` and ``content``; its other columns
are kept as the match's keys.  Rows are texts, matches are lines.  There is no
exchange: lines are split, matched, inverted and limited inside the row, then
generated.  The eligibility test (some pattern occurs in the whole text) comes
before anything is lexed and reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexing as L
from textloom.functions.registry import Language
from textloom.operators import matching as M
from textloom.plans.spec import SearchSpec

CHUNKS = "array<struct<type:string,token:string,col:int>>"


def _by_type(files: DataFrame, spec: SearchSpec, make) -> Column:
    """make(language) for each language present; alike languages share a branch."""
    if spec.types:
        present = sorted(spec.types)
    else:
        present = sorted(r[0] for r in files.select("file_type").distinct().collect() if r[0] in spec.registry)  # at most one a language
    column = make(None)
    for name in reversed(present):
        column = F.when(F.col("file_type") == name, make(spec.registry[name])).otherwise(column)
    return column


def chosen(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """Files of the wanted types and kinds; unknown types go as soon as either is asked for."""
    if spec.force_type:
        known = {s: x for x in spec.registry.values() for s in (*x.extensions, *x.headers, *x.names)}
        if spec.force_type in known:
            files = files.withColumn("file_type", F.lit(known[spec.force_type].name))
    if spec.types:
        files = files.where(F.col("file_type").isin(*sorted(spec.types)))
    if spec.kinds:
        of_kind = [x.name for x in spec.registry.values() if x.kind in spec.kinds]
        files = files.where(F.col("file_type").isin(*sorted(of_kind)))
    return files


def _eligible(text: Column, spec: SearchSpec) -> Column | None:
    """A test of any text (a file's or a line's) that holds a match: some pattern, or a part of it, occurs; None where none is known."""
    if not all(spec.patterns) or spec.strategy in ("regex", "semantic"):
        return None
    patterns = [p.lower() if spec.ignore_case else p for p in spec.patterns]
    if spec.strategy == "fuzzy" or spec.anchor == "edit":
        parts = [L.pieces(p) for p in patterns]
        patterns = [x for own in parts for x in own] if all(parts) else []
    tests = [text.contains(p) for p in patterns]
    return reduce(Column.__or__, tests) if tests else None


def _semantic_needs(spec: SearchSpec, lang: Language) -> Column:
    """Some pattern's exact words all occur in the text."""
    base = F.lower("content") if spec.ignore_case else F.col("content")
    needs = [[base.contains(t.lower() if spec.ignore_case else t) for t in dict.fromkeys(texts)] for texts in M.required(spec, lang)]
    return reduce(Column.__or__, [reduce(Column.__and__, n) if n else F.lit(True) for n in needs])


def eligible_files(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """Without files that can't match; what is left to the scan as a filter."""
    if spec.invert:
        return files
    if spec.strategy == "semantic":
        if spec.types:
            files = files.where(reduce(Column.__or__, [(F.col("file_type") == t) & _semantic_needs(spec, spec.registry[t]) for t in sorted(spec.types)]))
        return files
    may = _eligible(F.lower("content") if spec.ignore_case else F.col("content"), spec)
    return files if may is None else files.where(may)


def _line_arrays(files: DataFrame, spec: SearchSpec) -> Column:
    """array<struct<line_no, line, chunks>> of every line."""
    text = F.lower("content") if spec.ignore_case and spec.strategy != "regex" else F.col("content")
    shown = _by_type(files, spec, lambda lang: L.visible(text, lang, spec.contexts)) if spec.contexts else text
    pairs = F.arrays_zip(F.split("content", "\n", -1).alias("line"), F.split(shown, "\n", -1).alias("shown"))
    worded = spec.strategy == "fuzzy" or spec.anchor != "infix"
    find = lambda line: _by_type(files, spec, lambda lang: M.line_chunks(line, spec, lang)) if worded else M.line_chunks(line, spec, None)

    def judged(line: Column) -> Column:
        may = _eligible(line, spec)
        return find(line).cast(CHUNKS) if may is None else F.when(may, find(line).cast(CHUNKS)).otherwise(F.array().cast(CHUNKS))

    return F.transform(pairs, lambda p, i: F.struct((i + 1).cast("int").alias("line_no"), p["line"].alias("line"), judged(p["shown"]).alias("chunks")))


def _token_arrays(files: DataFrame, spec: SearchSpec) -> Column:
    """array<struct<line_no, line, chunks>> of lines with token hits."""
    none = F.array().cast(f"array<struct<line_no:int,chunks:{CHUNKS}>>")

    def hits(lang: Language | None) -> Column:
        if lang is None:
            return none
        contexts = (spec.contexts or set(L.CONTEXTS)) - {L.COMMENT} or set(L.CONTEXTS)
        text = L.visible(F.col("content"), lang, contexts) if spec.contexts else F.col("content")
        picked = M.token_hits if spec.strategy == "token" else M.semantic_hits
        tokens = L.hit_lines(text, lang, spec.strict, lambda ts: picked(ts, spec, lang), alone=spec.strategy == "token")
        lines = F.transform(tokens, lambda t, i: F.struct((i + 1).cast("int").alias("line_no"), F.transform(t, M._token_chunk).alias("chunks")))
        lines = F.filter(lines, lambda x: F.size(x["chunks"]) > 0).cast(f"array<struct<line_no:int,chunks:{CHUNKS}>>")
        return lines if spec.strategy == "token" else F.when(_semantic_needs(spec, lang), lines).otherwise(none)

    found = _by_type(files, spec, hits)
    hit = F.array(F.struct(F.lit("").alias("type"), F.lit("").alias("token"), F.lit(0).alias("col")))

    def every(taken: Column) -> Column:
        row = lambda line, i: F.struct((i + 1).cast("int").alias("line_no"), line.alias("line"), F.when(F.array_contains(taken, (i + 1).cast("int")), hit).otherwise(F.array().cast(CHUNKS)).alias("chunks"))
        return F.transform(F.split("content", "\n", -1), row)

    def matched(lines: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["line_no"].alias("line_no"), F.element_at(lines, x["line_no"]).alias("line"), x["chunks"].alias("chunks")))

    return L.bound(F.transform(found, lambda x: x["line_no"]), every) if spec.invert else L.bound(F.split("content", "\n", -1), matched)


def search(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """The matching lines: keys of files, line_no, line and chunks, in line order within a file."""
    if "file_type" not in files.columns:
        files = files.withColumn("file_type", F.lit(None).cast("string"))
    files = chosen(files, spec)
    keys = [c for c in files.columns if c not in ("content", "file_type")]
    files = eligible_files(files, spec)
    if spec.tests:
        from textloom.operators.test_code import search_tests

        return search_tests(files, spec, keys)
    found = _token_arrays(files, spec) if spec.strategy in ("token", "semantic") else _line_arrays(files, spec)
    found = F.filter(found, (lambda x: F.size(x["chunks"]) == 0) if spec.invert else (lambda x: F.size(x["chunks"]) > 0))
    if spec.max_count is not None:
        found = F.slice(found, 1, spec.max_count) if spec.max_count else F.slice(found, 1, 0)
    return files.select(*keys, F.explode(found).alias("m")).select(*keys, "m.line_no", "m.line", "m.chunks")
