"""Queries over the driver's tables, and the DuckDB SQL that says the same.

Each searches one table's whole text column: documents, conversations and
benchmark as Text, pages as Html, the events' properties as Json.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexing as L
from textloom.functions.registry import REGISTRY
from textloom.operators import shaping
from textloom.operators.examples import EXAMPLES
from textloom.operators.pattern_file import search_patterns
from textloom.plans.search import search
from textloom.plans.spec import SearchSpec
from textloom.sources import files

HTML, JSON = REGISTRY["Html"], REGISTRY["Json"]
CORPORA = {
    "documents": ("text", "Text", ("doc_id",)),
    "pages": ("html", "Html", ("page_id",)),
    "events": ("props", "Json", ("event_id",)),
    "conversations": ("text", "Text", ("conv_id", "turn", "role")),
}
INSULTS = ("idiot", "moron", "worthless")
PATHS = ("src/a.c", "inc/a.h", "Makefile", "go.mod", "x.tar.gz", "noext", ".c", "README", "CMakeLists.txt", "conf/app.yaml", "lib/mod.ml", "lib/mod.mli", "web/index.html", "data/x.ndjson", "t/basic.t", "Cargo.lock", "a.unknown", "dir.py/file", "notes.md", "q.sql")
FUZZY = "theation"


def corpus(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    text, kind, keys = CORPORA[table]
    return files.table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), text, kind, *keys)


def _found(spark, sf_dir, table, patterns, **options):
    spec = SearchSpec(patterns, types=CORPORA[table][1], **options)
    rows = corpus(spark, sf_dir, table)
    if spec.strategy in ("token", "semantic", "fuzzy") or spec.anchor != "infix":
        rows = files.spread(rows)
    return search(rows, spec)


def _rows(table):
    """Keys, line number, line, number of hits and first column."""
    keys = CORPORA[table][2]
    return lambda found: found.select(*keys, "line_no", "line", F.size("chunks").alias("n_hits"), F.element_at("chunks", 1)["col"].alias("col"))


def _bare(table):
    return lambda found: found.select(*CORPORA[table][2], "line_no", "line")


def _tokens(found: DataFrame) -> DataFrame:
    """How often each token was hit."""
    return found.select(F.explode("chunks").alias("c")).groupBy(F.col("c.token").alias("token")).agg(F.count("*").alias("n"))


def _per_file(table):
    key = CORPORA[table][2][0]
    return lambda found: found.groupBy(key).agg(F.sum(F.size("chunks")).alias("n_hits"))


def _search(table, patterns, shape, **options):
    return lambda spark, sf_dir: shape(_found(spark, sf_dir, table, patterns, **options))


def lit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = corpus(spark, sf_dir, "documents")
    return shaping.stats(search(documents, SearchSpec("the", types="Text")), documents, "doc_id")


def pattern_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with any whole line of any benchmark passage: the passages as a file of patterns."""
    lines = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", "\n", -1)).alias("p")).distinct()
    patterns = [r["p"] for r in lines.collect()]  # the query's own patterns
    return search_patterns(corpus(spark, sf_dir, "documents"), patterns, "doc_id").select("doc_id", "line_no", "line")


def ctx_segment_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = corpus(spark, sf_dir, "pages").select(F.explode(L.segments(F.col("content"), HTML)).alias("s"))
    return segments.groupBy(F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("n_chars"))


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    return files.classified(paths).select("path", "file_type", "file_kind")


def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_paths(spark, sf_dir).where("file_kind = 'Config'")


def type_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.type_list(spark).select("file_type", "file_kind", F.explode("selectors").alias("selector"))


def json_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.json_rows(_found(spark, sf_dir, "pages", "class", contexts="code", max_count=3), "page_id")


def _test_filter(tests: str):
    """Marker lines of the examples among tests only, or without them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(name, name, text) for name, text in EXAMPLES.items()]
        files_of = spark.createDataFrame(rows, "path string, file_type string, content string")
        return search(files_of, SearchSpec("mk_", strategy="semantic", tests=tests)).select("path", "line_no", "line", F.size("chunks").alias("n_hits"))

    return run


def _typed(table: str, file_type: str, patterns, **options):
    """How often tokens of a table's texts were hit, its texts taken for another type."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = corpus(spark, sf_dir, table).withColumn("file_type", F.lit(file_type))
        return _tokens(search(files.spread(rows), SearchSpec(patterns, types=file_type, **options)))

    return run


def queries() -> dict:
    rows, bare, per_doc = _rows("documents"), _bare("documents"), _per_file("documents")
    count = lambda found: shaping.count_per_file(found, "doc_id")
    return {
        "lit_lines": _search("documents", "the", rows),
        "lit_icase": _search("documents", "THE", rows, ignore_case=True),
        "lit_occurrence_count": _search("documents", "the", per_doc),
        "lit_multi_pattern": _search("documents", INSULTS, lambda found: found.select("doc_id", "line_no", "line", F.size("chunks").alias("n_hits"))),
        "lit_invert": _search("documents", "the", bare, invert=True),
        "lit_max_count": _search("documents", "the", bare, max_count=2),
        "lit_count_per_doc": _search("documents", "the", count),
        "lit_files_only": _search("documents", "idiot", lambda found: shaping.file_names(found, "doc_id")),
        "lit_stats": lit_stats,
        "lit_text_rows": _search("documents", "the", lambda found: shaping.text_rows(found, "doc_id")),
        "lit_locations": _search("documents", "idiot", lambda found: shaping.locations(found, "doc_id")),
        "word_match": _search("documents", "and", rows, anchor="word"),
        "prefix_match": _search("documents", "ther", rows, anchor="prefix"),
        "suffix_match": _search("documents", "tion,", rows, anchor="suffix"),
        "fuzzy_words": _search("documents", FUZZY, _tokens, strategy="fuzzy"),
        "regex_lines": _search("documents", "th(?:er|en)[a-z]+ou", rows, strategy="regex"),
        "regex_all_matches": _search("documents", "[A-Z][a-z]+tion", _tokens, strategy="regex"),
        "pattern_file": pattern_file,
        "conversation_search": _search("conversations", "the", _rows("conversations")),
        "ctx_code_only": _search("pages", "class", _rows("pages"), contexts="code"),
        "ctx_comment_only": _search("pages", "a", _rows("pages"), contexts="comment"),
        "ctx_literal_only": _search("pages", "a", _rows("pages"), contexts="literal"),
        "ctx_segment_histogram": ctx_segment_histogram,
        "tok_numbers": _search("pages", "2", _tokens, strategy="token", token_types="number"),
        "tok_strings_json": _search("events", "k", _tokens, strategy="token", token_types="string"),
        "tok_operators": _search("pages", "/", _tokens, strategy="token", token_types="operator"),
        "tok_identifiers": _search("pages", "div", _tokens, strategy="token", token_types="identifier", anchor="word"),
        "sem_window_any": _search("pages", "_ = STR", _per_file("pages"), strategy="semantic"),
        "sem_placeholder_equal": _search("pages", "_1 ANY _1", _per_file("pages"), strategy="semantic"),
        "classify_paths": classify_paths,
        "kind_filter": kind_filter,
        "type_list": type_list,
        "json_render": json_render,
        "tok_keyword": _typed("documents", "Sql", "o", strategy="token", token_types="keyword"),
        "test_filter_only": _test_filter("only"),
        "test_filter_exclude": _test_filter("exclude"),
    }


def _lines(table: str, text: str | None = None) -> str:
    column, _, keys = CORPORA[table]
    shown = text or column
    return f"""
lines AS (
  SELECT {", ".join(keys)}, line_no, line, shown FROM (
    SELECT {", ".join(keys)}, unnest(string_split({column}, chr(10))) AS line, unnest(string_split({shown}, chr(10))) AS shown,
      generate_subscripts(string_split({column}, chr(10)), 1)::INTEGER AS line_no
    FROM {table}
  )
)"""


def _hits(table: str, pattern: str, shown: str | None = None) -> str:
    keys, n = ", ".join(CORPORA[table][2]), len(pattern)
    return f"""WITH {_lines(table, shown)}
SELECT {keys}, line_no, line, ((length(shown) - length(replace(shown, '{pattern}', ''))) // {n})::INTEGER AS n_hits, strpos(shown, '{pattern}')::INTEGER AS col
FROM lines WHERE contains(shown, '{pattern}')"""


def _worded(test: str, place: str = "0") -> str:
    """Lines with a word that passes; words and blanks in turn give columns."""
    cover = L.spaced(None)
    return f"""WITH {_lines("documents")},
parts AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '{cover}') AS p FROM lines),
words AS (SELECT doc_id, line_no, line, unnest(p) AS w, unnest(list_transform(p, lambda x, i: 1 + coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y))), 0))) AS col FROM parts)
SELECT doc_id, line_no, line, count(*)::INTEGER AS n_hits, min(col + {place})::INTEGER AS col FROM words WHERE {test} GROUP BY doc_id, line_no, line"""


def _blank(x: str) -> str:
    return f"regexp_replace({x}, '[^{L.SPACE}]', ' ', 'g')"


def _html(*contexts: str) -> str:
    """The html of which only these contexts are shown."""
    comment = "s" if "comment" in contexts else _blank("s")
    edge, inner = ("{}" if k in contexts else _blank("{}") for k in ("code", "literal"))
    body = "CASE WHEN length(s) >= 2 AND ends_with(s, '\"') THEN {} || {} || {} ELSE {} || {} END".format(
        edge.format("s[1:1]"), inner.format("s[2:length(s) - 1]"), edge.format("s[length(s):]"), edge.format("s[1:1]"), inner.format("s[2:]")
    )
    return f"""array_to_string(list_transform(regexp_extract_all(html, '{L.segment_regex(HTML, "re2")}'), lambda s:
  CASE WHEN starts_with(s, '<!--') THEN {comment} WHEN starts_with(s, '"') AND length(s) > 1 THEN {body} ELSE {edge.format("s")} END), '')"""


def _lexed(table: str, lang) -> str:
    """tokens(key, i, t): all but comments and white space, in order."""
    column, _, keys = CORPORA[table]
    pattern = L.token_regex(lang, dialect="re2").replace("'", "''")
    return f"""
parts AS (SELECT {keys[0]} AS k, unnest(regexp_extract_all({column}, '{pattern}')) AS t, generate_subscripts(regexp_extract_all({column}, '{pattern}'), 1) AS i FROM {table}),
tokens AS (
  SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY i) AS i,
    CASE WHEN starts_with(t, '"') AND length(t) > 1 THEN 's' WHEN regexp_matches(t, '^\\.?[0-9]') THEN 'd' WHEN regexp_matches(t, '^[{L.BRACKETS}]') THEN 'b' WHEN regexp_matches(t, '^[A-Za-z]') AND '{lang.name}' = 'Html' THEN 'i' ELSE 'o' END AS y
  FROM parts WHERE NOT starts_with(t, '<!--') AND NOT regexp_matches(t, '^[{L.SPACE}]+$')
)"""


def _token_sql(table: str, lang, test: str) -> str:
    return f"WITH {_lexed(table, lang)} SELECT t AS token, count(*) AS n FROM tokens WHERE {test} GROUP BY t"


def _window_sql(test: str) -> str:
    return f"""WITH {_lexed("pages", HTML)},
w AS (SELECT k, i, t, y, lead(t) OVER o AS t1, lead(y) OVER o AS y1, lead(t, 2) OVER o AS t2, lead(y, 2) OVER o AS y2 FROM tokens WINDOW o AS (PARTITION BY k ORDER BY i)),
hit AS (SELECT DISTINCT k, i + j AS i FROM w, (VALUES (0), (1), (2)) AS steps(j) WHERE {test})
SELECT k AS page_id, count(*)::BIGINT AS n_hits FROM hit GROUP BY k"""


def _classified() -> str:
    def among(names):
        return ", ".join(f"'{n}'" for n in names)

    name, ext = "regexp_extract(path, '[^/]*$')", "regexp_extract(path, '[.][^./]*$')"
    whole = " ".join(f"WHEN {name} IN ({among(x.names)}) THEN '{x.name}'" for x in REGISTRY.values() if x.names)
    plain = " ".join(f"WHEN {ext} IN ({among(x.extensions)}) THEN '{x.name}'" for x in REGISTRY.values() if x.extensions)
    header = " ".join(f"WHEN {ext} IN ({among(x.headers)}) THEN '{x.name}'" for x in REGISTRY.values() if x.headers)
    kinds = " ".join(f"WHEN '{x.name}' THEN '{x.kind}'" for x in REGISTRY.values())
    paths = ", ".join(f"('{p}')" for p in PATHS)
    return f"""SELECT path, file_type, CASE file_type {kinds} END AS file_kind FROM (
SELECT path, coalesce(CASE {whole} END, CASE {plain} END, CASE {header} END) AS file_type FROM (VALUES {paths}) AS p(path))"""


def _json_sql() -> str:
    """One object a page: its first three lines with "class" in code, each occurrence with its column."""
    places = "1 + list_sum(list_transform(p[1:i], lambda x: length(x))) + 5 * (i - 1)"
    token = f"""'{{"col":' || ({places})::INTEGER || ',"token":"class"}}'"""
    return f"""WITH {_lines("pages", _html("code"))},
hit AS (SELECT page_id, line_no, string_split(shown, 'class') AS p FROM lines WHERE contains(shown, 'class') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY line_no) <= 3),
said AS (SELECT page_id, line_no, '{{"row":' || line_no || ',"tokens":[' || array_to_string(list_transform(range(1, len(p)), lambda i: {token}), ',') || ']}}' AS j FROM hit)
SELECT '{{"file":"' || page_id || '","matches":[' || string_agg(j, ',' ORDER BY line_no) || ']}}' AS json FROM said GROUP BY page_id"""


#: SQL's tokens, written apart from the engine's lexer: comments, strings, numbers, words, single signs.
SQL_TOKENS = r"(?s)--[^\n]*\n?|'(?:[^'\\]|\\.)*'?|\.?[0-9][0-9A-Fa-f.xX]*|[A-Za-z_][A-Za-z0-9_]*|."


def _keyword_sql() -> str:
    words = ", ".join(f"'{w}'" for w in sorted(REGISTRY["Sql"].keywords))
    tokens = SQL_TOKENS.replace("'", "''")
    return f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{tokens}')) AS t FROM documents) WHERE t IN ({words}) AND contains(t, 'o') GROUP BY t"


def _test_filter_sql(kind: str) -> str:
    """The examples' marker lines; a type without rules is production code as a whole."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in EXAMPLES.items())
    kinds = "(CASE WHEN path = 'Bash' THEN 'prod' ELSE '{}' END)".format(kind)
    return f"""WITH f(path, content) AS (VALUES {rows}),
lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM f),
hits AS (SELECT path, line_no, line, len(regexp_extract_all(line, 'mk_prod_[0-9]+')) AS prod, len(regexp_extract_all(line, 'mk_test_[0-9]+')) AS test FROM lines)
SELECT path, line_no, line, (CASE WHEN {kinds} = 'prod' THEN prod ELSE test END)::INTEGER AS n_hits FROM hits WHERE CASE WHEN {kinds} = 'prod' THEN prod ELSE test END > 0"""


def oracle_sql() -> dict[str, str]:
    lines = f"WITH {_lines('documents')}"
    the = "contains(line, 'the')"
    insults = " + ".join(f"(length(line) - length(replace(line, '{w}', ''))) // {len(w)}" for w in INSULTS)
    selectors = ", ".join(f"('{x.name}', '{x.kind}', '{s}')" for x in REGISTRY.values() for s in (*x.names, *x.extensions, *x.headers))
    fuzzy = f"""{lines}, words AS (SELECT unnest(regexp_extract_all(line, '{L.chunk_regex(None)}')) AS token FROM lines),
near AS (SELECT token, levenshtein(regexp_replace(token, '[^\\x00-\\x7F]', chr(1), 'g'), '{FUZZY}') AS d, least(length(token), {len(FUZZY)}) AS m FROM words)
SELECT token, count(*) AS n FROM near WHERE CASE WHEN m < 5 THEN d < 3 ELSE d < m * 40 // 100 END GROUP BY token"""
    return {
        "lit_lines": _hits("documents", "the"),
        "lit_icase": _hits("documents", "the", "lower(text)"),
        "lit_occurrence_count": f"{lines} SELECT doc_id, sum((length(line) - length(replace(line, 'the', ''))) // 3)::BIGINT AS n_hits FROM lines WHERE {the} GROUP BY doc_id",
        "lit_multi_pattern": f"{lines} SELECT doc_id, line_no, line, ({insults})::INTEGER AS n_hits FROM lines WHERE {insults} > 0",
        "lit_invert": f"{lines} SELECT doc_id, line_no, line FROM lines WHERE NOT {the}",
        "lit_max_count": f"{lines} SELECT doc_id, line_no, line FROM lines WHERE {the} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2",
        "lit_count_per_doc": f"{lines} SELECT doc_id, count(*) AS n_lines FROM lines WHERE {the} GROUP BY doc_id",
        "lit_files_only": "SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'idiot')",
        "lit_stats": f"{lines} SELECT count(*) AS n_matches, count(DISTINCT doc_id) AS n_matching_files, (SELECT count(*) FROM documents) AS n_files FROM lines WHERE {the}",
        "lit_text_rows": f"{lines} SELECT doc_id || ':' || line_no || ':' || strpos(line, 'the') || ':' || line AS row FROM lines WHERE {the}",
        "lit_locations": f"{lines} SELECT DISTINCT doc_id || ':' || line_no AS location FROM lines WHERE contains(line, 'idiot')",
        "word_match": _worded("w = 'and'"),
        "prefix_match": _worded("starts_with(w, 'ther')"),
        "suffix_match": _worded("ends_with(w, 'tion,')", "length(w) - 5"),
        "fuzzy_words": fuzzy,
        "regex_lines": f"{lines} SELECT doc_id, line_no, line, len(regexp_extract_all(line, 'th(?:er|en)[a-z]+ou'))::INTEGER AS n_hits, strpos(line, regexp_extract(line, 'th(?:er|en)[a-z]+ou'))::INTEGER AS col FROM lines WHERE regexp_matches(line, 'th(?:er|en)[a-z]+ou')",
        "regex_all_matches": f"{lines} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[A-Z][a-z]+tion')) AS token FROM lines) GROUP BY token",
        "pattern_file": f"{lines}, p AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS p FROM benchmark) SELECT DISTINCT doc_id, line_no, line FROM lines JOIN p ON contains(line, p) WHERE p <> ''",
        "conversation_search": _hits("conversations", "the"),
        "ctx_code_only": _hits("pages", "class", _html("code")),
        "ctx_comment_only": _hits("pages", "a", _html("comment")),
        "ctx_literal_only": _hits("pages", "a", _html("literal")),
        "ctx_segment_histogram": f"SELECT kind, count(*) AS n, sum(length(s))::BIGINT AS n_chars FROM (SELECT s, CASE WHEN starts_with(s, '<!--') THEN 'comment' WHEN starts_with(s, '\"') AND length(s) > 1 THEN 'literal' ELSE 'code' END AS kind FROM (SELECT unnest(regexp_extract_all(html, '{L.segment_regex(HTML, 're2')}')) AS s FROM pages)) GROUP BY kind",
        "tok_numbers": _token_sql("pages", HTML, "y = 'd' AND contains(t, '2')"),
        "tok_strings_json": _token_sql("events", JSON, "y = 's' AND contains(t[2:length(t) - 1], 'k')"),
        "tok_operators": _token_sql("pages", HTML, "y = 'o' AND contains(t, '/')"),
        "tok_identifiers": _token_sql("pages", HTML, "y = 'i' AND t = 'div'"),
        "sem_window_any": _window_sql("y = 'i' AND y1 = 'o' AND t1 = '=' AND y2 = 's'"),
        "sem_placeholder_equal": _window_sql("y = 'i' AND y2 = 'i' AND t = t2"),
        "classify_paths": _classified(),
        "kind_filter": f"WITH c AS MATERIALIZED ({_classified()}) SELECT * FROM c WHERE file_kind = 'Config'",
        "json_render": _json_sql(),
        "tok_keyword": _keyword_sql(),
        "test_filter_only": _test_filter_sql("test"),
        "test_filter_exclude": _test_filter_sql("prod"),
        "type_list": f"SELECT * FROM (VALUES {selectors}) AS t(file_type, file_kind, selector)",
    }
