"""Searches over streams: the same narrow plan, row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.search import search
from textloom.plans.spec import SearchSpec
from textloom.sources.files import classified


def search_stream(stream: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matches of a streaming corpus; types must be given, as a stream can't be asked which it holds."""
    if not spec.types and (spec.contexts or spec.strategy in ("token", "semantic", "fuzzy") or spec.anchor != "infix"):
        raise ValueError("name the types of a stream")
    return search(stream, spec)


def text_stream(spark: SparkSession, directory: str) -> DataFrame:
    """New files of a directory as a streaming corpus."""
    from pyspark.sql import functions as F

    lines = spark.readStream.format("text").option("wholetext", True).load(directory)
    return classified(lines.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path")))
