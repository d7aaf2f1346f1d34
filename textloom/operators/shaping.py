"""Results of a search: counts, names, text, JSON, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_per_file(matches: DataFrame, *keys: str) -> DataFrame:
    """Matching lines of each file that has any."""
    return matches.groupBy(*keys).agg(F.count("*").alias("n_lines"))


def file_names(matches: DataFrame, *keys: str) -> DataFrame:
    return matches.select(*keys).distinct()


def stats(matches: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """Matching lines, matching files and files searched, in one row."""
    found = count_per_file(matches, *keys).agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_matches"), F.count("*").alias("n_matching_files"))
    return found.crossJoin(files.agg(F.count("*").alias("n_files")))  # one row each


def text_rows(matches: DataFrame, name: str, columns: bool = True, numbers: bool = True, names: bool = True, tokens: bool = False) -> DataFrame:
    """``file:line:column:`` and the line, as a terminal shows it."""
    parts: list[Column] = []
    if names:
        parts.append(F.col(name).cast("string"))
    if numbers:
        parts.append(F.col("line_no").cast("string"))
        if columns:
            parts.append(F.when(F.size("chunks") > 0, F.element_at("chunks", 1)["col"].cast("string")))
    if tokens:
        parts.append(F.array_join(F.transform("chunks", lambda c: c["token"]), ""))
    return matches.select(F.concat_ws(":", *parts, F.col("line")).alias("row"))


def json_rows(matches: DataFrame, name: str) -> DataFrame:
    """One valid JSON object a file, matches in line order."""
    match = F.struct(F.col("line_no").alias("row"), F.transform("chunks", lambda c: F.struct(c["col"].alias("col"), c["token"].alias("token"))).alias("tokens"))
    grouped = matches.groupBy(name).agg(F.array_sort(F.collect_list(match)).alias("matches"))
    return grouped.select(F.to_json(F.struct(F.col(name).cast("string").alias("file"), "matches")).alias("json"))


def locations(matches: DataFrame, name: str) -> DataFrame:
    """Distinct ``file:line``, for an editor."""
    return matches.select(F.concat_ws(":", F.col(name).cast("string"), F.col("line_no").cast("string")).alias("location")).distinct()


def colored(line: Column, chunks: Column, on: str = "\x1b[1m", off: str = "\x1b[0m") -> Column:
    """The line with its chunks between two signs, overlapping chunks as one."""
    letters = F.split(line, "")
    inside = lambda i: F.exists(chunks, lambda c: (i >= c["col"] - 1) & (i < c["col"] - 1 + F.length(c["token"])))
    marked = F.transform(letters, lambda x, i: F.when(inside(i) & ~((i > 0) & inside(i - 1)), F.concat(F.lit(on), x)).otherwise(x))
    return F.array_join(F.transform(marked, lambda x, i: F.when(inside(i) & ~inside(i + 1), F.concat(x, F.lit(off))).otherwise(x)), "")
