"""Files as rows: discovery, classification, whole-file reads.

Listing runs on the driver and yields paths only; types, kinds and pruned
directories are settled from names before any content is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.registry import REGISTRY


def walk(root: str = ".", prune: Iterable[str] = (), follow_links: bool = False) -> Iterator[str]:
    """Paths below root, hidden ones too; a directory is pruned if its path ends with a name in ``prune``."""
    seen = set()
    for path, dirs, names in os.walk(root, followlinks=follow_links):
        real = os.path.realpath(path)
        if real in seen:
            dirs[:] = []
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if not any((os.path.join(path, d) + "/").endswith(p.rstrip("/") + "/") for p in prune))
        yield from (os.path.join(path, n) for n in sorted(names))


def _selectors(registry, header_only: bool, code_only: bool) -> dict[str, str]:
    if header_only and code_only:
        raise ValueError("code only and headers only exclude each other")
    found = {}
    for x in registry.values():
        found |= dict.fromkeys((f"name:{n}" for n in x.names), x.name)
        if not header_only:
            found |= dict.fromkeys((f"ext:{e}" for e in x.extensions), x.name)
        if not code_only:
            for e in x.headers:
                found.setdefault(f"ext:{e}", x.name)
    return found


def type_of(path: str, registry=REGISTRY, header_only: bool = False, code_only: bool = False) -> str | None:
    """Type by whole name, then extension, then header extension."""
    table, name = _selectors(registry, header_only, code_only), os.path.basename(path)
    return table.get(f"name:{name}") or table.get(f"ext:{os.path.splitext('x' + name)[1]}")


def _table(rows: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in rows.items() for x in pair))


def classified(files: DataFrame, path: str = "path", registry=REGISTRY, header_only: bool = False, code_only: bool = False) -> DataFrame:
    """Adds file_name, ext, file_type and file_kind by lookups in two literal maps."""
    table = _table(_selectors(registry, header_only, code_only))
    name = F.regexp_extract(path, r"[^/]*$", 0)
    ext = F.regexp_extract(name, r"\.[^.]*$", 0)
    kind = F.coalesce(table[F.concat(F.lit("name:"), name)], table[F.concat(F.lit("ext:"), ext)])
    files = files.withColumns({"file_name": name, "ext": ext, "file_type": kind})
    return files.withColumn("file_kind", _table({x.name: x.kind for x in registry.values()})[F.col("file_type")])


def type_list(spark: SparkSession, registry=REGISTRY) -> DataFrame:
    """Types with their kinds and selectors."""
    rows = [(x.name, x.kind, [*x.names, *x.extensions, *x.headers]) for x in registry.values()]
    return spark.createDataFrame(rows, "file_type string, file_kind string, selectors array<string>")


def read(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, content and error of each file; a file that isn't UTF-8 has an error and no content."""
    paths = [p if "://" in p else f"file://{os.path.abspath(p)}" for p in paths]
    if not paths:
        return spark.createDataFrame([], "path string, content string, error string")
    raw = spark.read.format("binaryFile").load([p.replace("[", r"\[").replace("{", r"\{").replace("*", r"\*").replace("?", r"\?") for p in paths])
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), text.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"))


def directory(spark: SparkSession, root: str = ".", prune=(), types=(), kinds=(), registry=REGISTRY, **options) -> DataFrame:
    """A directory's files of known, wanted types, read and classified; one that asks for no type takes all known ones."""
    found = []
    for path in walk(root, prune):
        kind = type_of(path, registry, **options)
        if kind and (not types or kind in types) and (not kinds or registry[kind].kind in kinds):
            found.append(path)
    return classified(read(spark, found), registry=registry, **options)


def text(spark: SparkSession, content: str, name: str = "<STDIN>") -> DataFrame:
    return spark.createDataFrame([(name, None, content)], "path string, file_type string, content string")


def patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a file, one a line, trimmed."""
    rows = spark.read.text(path).select(F.trim("value")).collect()  # a query's patterns
    return [r[0] for r in rows if r[0]]


def table(df: DataFrame, content: str, file_type: str, *keys: str) -> DataFrame:
    """Any table's text column as a corpus."""
    return df.select(*keys, F.lit(file_type).alias("file_type"), F.col(content).alias("content"))


#: Bytes of text that go to one task where they are lexed.
SHARE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly, to a task for each SHARE of their text and to all cores at least; lexing costs more than that exchange.

    A scan's own splits grow with the input, all of a row group falls to one of them, and repeated texts are stored in few
    bytes.  So the texts are measured first.
    """
    if df.isStreaming:
        return df
    size = df.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE)))
