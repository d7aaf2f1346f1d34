"""Search for all patterns of a file at once.

The patterns, whole lines of any number, are compiled into Aho-Corasick
automata of ``SHARD`` patterns each, and every text streams through them once;
the work does not grow with the number of patterns.  Regular expressions have
no such form on the JVM, so this is an Arrow function.  It reads the texts
where they lie, without an exchange.
"""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = 200_000


def _automata(patterns: list[str]):
    for at in range(0, len(patterns), SHARD):
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p in patterns[at : at + SHARD]:
            machine.add_word(p, len(p))
        machine.make_automaton()
        yield machine


def search_patterns(files: DataFrame, patterns: list[str], *keys: str) -> DataFrame:
    """keys, line_no, line and n_hits (places, overlapping ones included) of lines with any of the patterns; empty ones match nothing.

    A pattern lies in one line.  Rows without content have no lines.
    """
    patterns = sorted({p for p in patterns if p})
    if any("\n" in p for p in patterns):
        raise ValueError("a pattern lies in one line")
    schema = T.StructType([*(files.schema[k] for k in keys), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("n_hits", T.IntegerType())])

    def run(batches):
        machines = list(_automata(patterns))
        for batch in batches:
            where, numbers, lines, hits = [], [], [], []
            for i, text in enumerate(batch.column("content").to_pylist()):
                found: dict[int, int] = {}
                if text:
                    ends = [j for j, c in enumerate(text) if c == "\n"]
                    for end in (end for machine in machines for end, _ in machine.iter(text)):
                        line = bisect.bisect_left(ends, end)
                        found[line] = found.get(line, 0) + 1
                for line in sorted(found):
                    where.append(i)
                    numbers.append(line + 1)
                    lines.append(text[ends[line - 1] + 1 if line else 0 : ends[line] if line < len(ends) else len(text)])
                    hits.append(found[line])
            arrays = [batch.column(k).take(pa.array(where, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), pa.array(hits, pa.int32())], names=[*keys, "line_no", "line", "n_hits"])

    return files.select(*keys, F.col("content")).mapInArrow(run, schema)
