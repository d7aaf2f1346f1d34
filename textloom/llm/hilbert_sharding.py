"""Hilbert-curve sharding, with DataFrame functions only.

Size, language and source are quantised into 16 levels each by their own
quantiles (strings whole, by the ranks of their distinct values), the cell's
index on a three-dimensional Hilbert curve orders the rows, and equal runs of
the order are the shards.  Neighbours on the curve are near in all three
dimensions, so each shard has narrow ranges of them and readers skip shards by
their minima and maxima.

Law ``rows``: shards differ by at most one row.  One range exchange sorts the
rows; a row's place is its partition's offset plus its place there, so neither
a hot cell nor a hot source meets in one task.  Within a cell, rows go by a
hash of doc_id, then doc_id, checksum and size; rows equal in all of these may
swap places, which changes nothing.

Null text: size 1, checksum 0.  Null language or source counts as empty; null
doc_ids sort first.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import common as C

BITS, DIMS = 4, 3


def hilbert_index(cell: tuple[int, ...], bits: int = BITS) -> int:
    """Place of a cell on the curve: undo excess work, Gray-decode, interleave (Skilling 2004)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ t) >> bit & 1)
    return index


def _curve() -> bytes:
    """Two bytes for each cell, so one literal is the table."""
    side = 1 << BITS
    return b"".join(hilbert_index((a, b, c)).to_bytes(2, "big") for a in range(side) for b in range(side) for c in range(side))


def _ranked(df: DataFrame, weight: Column) -> DataFrame:
    """df, whose rows are sorted within and across partitions and written with their place ``at``, with the weights before each row and in all."""
    df = df.withColumn("part", F.shiftright("at", 33)).withColumn("weight", weight)
    sizes = df.groupBy("part").agg(F.sum("weight").alias("sum"))  # a row a partition
    before = Window.orderBy("part")
    offsets = sizes.select("part", (F.sum("sum").over(before) - F.col("sum")).alias("offset"), F.sum("sum").over(Window.partitionBy()).alias("total"))
    return df.join(F.broadcast(offsets), "part")


def string_cuts(rows: DataFrame, names: tuple[str, ...], side: int) -> dict[str, list[str]]:
    """The values at which the rows, sorted by each column's whole string, reach each ``side``-th part; exact, over all rows."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(n).alias("value")) for i, n in enumerate(names)))).alias("x")).select("x.*")
    counts = each.groupBy("dim", "value").agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange(C.buckets(rows), "dim", "value").sortWithinPartitions("dim", "value")
    ranked = _ranked(C.written(placed.withColumn("at", F.monotonically_increasing_id()), "values"), F.col("n"))
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows_in_all = F.col("total") / len(names)
    upto = F.col("offset") + F.sum("n").over(own) - F.col("dim") * rows_in_all
    reached = ranked.select("dim", "value", F.floor((upto - F.col("n")) * side / rows_in_all).alias("a"), F.floor(upto * side / rows_in_all).alias("b"))
    found = reached.where(f"a < b AND a < {side - 1}").select("dim", "value").collect()  # fewer than ``side`` for each column
    return {n: sorted(r["value"] for r in found if r["dim"] == i) for i, n in enumerate(names)}


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"x_{d}") for d in ("lang", "source")),
    )
    side = 1 << BITS
    sizes = rows.agg(F.percentile_approx("size", [i / side for i in range(1, side)], 10_000).alias("size")).first()["size"]
    cuts = {"size": sorted(set(sizes or []))} | string_cuts(rows, ("x_lang", "x_source"), side)

    def level(d):
        return F.size(F.filter(F.array(*(F.lit(c) for c in cuts[d])), lambda c: c < F.col(d))) if cuts[d] else F.lit(0)

    cell = (level("size") * side + level("x_lang")) * side + level("x_source")
    curve = F.conv(F.hex(F.substring(F.lit(_curve()), 2 * cell + 1, F.lit(2))), 16, 10).cast("int")
    order = ("curve", "mix", "doc_id", "text_crc32", "size")
    keyed = rows.select("doc_id", "size", "text_crc32", curve.alias("curve")).withColumn("mix", F.xxhash64("doc_id"))
    placed = keyed.repartitionByRange(C.buckets(docs), *order).sortWithinPartitions(*order)
    placed = C.written(placed.withColumn("at", F.monotonically_increasing_id()).drop("mix"), "placed")
    ranked = _ranked(placed, F.lit(1)).withColumn("rank", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1))
    shard = F.expr(f"rank * {shards} div total")
    start = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return ranked.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
