"""Strategies, context filter, shaping, sources; an independent state machine checks the compiled lexers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom import SearchSpec, search
from textloom.functions import lexing as L
from textloom.functions.registry import REGISTRY
from textloom.operators import shaping
from textloom.plans.spec import chosen_types
from textloom.sources import files

SOURCE = """// foo in comment
int foo(int x) { /* foo */ return foo2 + 0x1F; }
const char *s = "foo \\"bar";
char c = '"'; foo = foo + 1;
a = b + 2; x_foo = 'z';
"""


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([("a.c", "C", SOURCE), ("b.txt", "Text", "foo, food foo\nbar fop\n"), ("e.txt", "Text", ""), ("n.txt", None, "foo")], "path string, file_type string, content string")


def lines(corpus, **options):
    return sorted((r.path, r.line_no) for r in search(corpus, SearchSpec(**options)).collect())


def hits(corpus, path, **options):
    return [(c.token, c.col) for r in search(corpus, SearchSpec(**options)).where(F.col("path") == path).orderBy("line_no").collect() for c in r.chunks]


def test_contexts(corpus):
    of_c = lambda **o: [n for p, n in lines(corpus, patterns="foo", **o) if p == "a.c"]
    assert of_c() == [1, 2, 3, 4, 5]
    assert of_c(contexts="comment") == [1, 2]
    assert of_c(contexts="literal") == [3]
    assert of_c(contexts="code") == [2, 4, 5]
    assert of_c(contexts={"code", "literal"}) == [2, 3, 4, 5]


def test_anchors(corpus):
    assert hits(corpus, "a.c", patterns="foo", anchor="word") == [("foo", 4), ("foo", 5), ("foo", 21), ("foo", 18), ("foo", 15), ("foo", 21)]
    assert hits(corpus, "b.txt", patterns="foo", anchor="prefix") == [("foo", 1), ("foo", 6), ("foo", 11)]
    assert hits(corpus, "a.c", patterns="oo", anchor="suffix")[-1] == ("oo", 15)
    assert ("fop", 5) in hits(corpus, "b.txt", patterns="foo", strategy="fuzzy")


def test_invert_and_limit(corpus):
    every = {(r.path, i + 1) for r in corpus.collect() for i in range(r.content.count("\n") + 1)}
    found = set(lines(corpus, patterns="foo"))
    assert set(lines(corpus, patterns="foo", invert=True)) == every - found
    assert lines(corpus, patterns="foo", max_count=1) == [("a.c", 1), ("b.txt", 1), ("n.txt", 1)]
    assert lines(corpus, patterns="foo", max_count=0) == []
    assert lines(corpus, patterns="") == []


def test_tokens_and_semantics(corpus):
    assert hits(corpus, "a.c", patterns="1", strategy="token", token_types="number") == [("0x1F", 42), ("1", 27)]
    assert hits(corpus, "a.c", patterns="int", strategy="token", token_types="native") == [("int", 1), ("int", 9)]
    assert hits(corpus, "a.c", patterns="_1 = _1 + NUM", strategy="semantic") == [("foo", 15), ("=", 19), ("foo", 21), ("+", 25), ("1", 27)]
    assert [t for t, _ in hits(corpus, "a.c", patterns="_ = STR", strategy="semantic")][::3] == ["s", "c", "x_foo"]
    assert hits(corpus, "a.c", patterns="HEX", strategy="semantic") == [("0x1F", 42)]


def test_ignore_case_and_regex(corpus):
    assert lines(corpus, patterns="FOO", ignore_case=True) == lines(corpus, patterns="foo")
    assert hits(corpus, "b.txt", patterns="fo+|bar", strategy="regex") == [("foo", 1), ("foo", 6), ("foo", 11), ("bar", 1), ("fo", 5)]
    assert L.posix_longest("a|ab") == "ab|a"


def _machine(text, lang):
    """Kinds of characters by a state machine that knows nothing of regular expressions."""
    out, i = [], 0
    regions = [("comment", a, b, False) for a, b in lang.comments] + [("literal", a, b, True) for a, b in lang.strings] + [("literal", a, b, False) for a, b in lang.raws] + [("char", a, b, True) for a, b in lang.chars]
    while i < len(text):
        for kind, a, b, escapes in regions:
            if not text.startswith(a, i):
                continue
            if kind == "char":
                j = i + len(a)
                size = 2 if text[j : j + 1] == "\\" and text.startswith(b, j + 2) else 1
                if j + size > len(text) or (size == 1 and text[j : j + 1] == "\\") or not text.startswith(b, j + size):
                    continue
            j = i + len(a)
            while j < len(text) and not text.startswith(b, j):
                j += 2 if escapes and text[j] == "\\" else 1
            j = min(len(text), j + len(b))
            out += ["comment" if kind == "comment" else "literal"] * (j - i)
            i = j
            break
        else:
            out.append("code")
            i += 1
    return out


@pytest.mark.parametrize("name", ["C", "Html", "Json", "Haskell", "Lua", "Rust", "Go", "Toml", "Sql"])
def test_segments_agree_with_a_state_machine(spark, name):
    lang, r = REGISTRY[name], random.Random(name)
    signs = [a for a, _ in (*lang.comments, *lang.strings, *lang.raws, *lang.chars)] + [b for _, b in (*lang.comments, *lang.strings, *lang.raws)] + ["\\", "a", " ", "\n", "é", "漢", "😀", "x1"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.segments(F.col("t"), lang).alias("s")).collect()
    for row in rows:
        assert "".join(s.text for s in row.s) == row.t
        got = [s.kind for s in row.s for _ in s.text]
        want = _machine(row.t, lang)
        if got != want:  # a lone quote at the text's end is an empty, unterminated literal: its delimiter is code either way
            assert got[:-1] == want[:-1] and got[-1] == "code" and want[-1] == "literal"


def test_long_literal_with_escapes(spark):
    text = '"' + "\\x" * 200_000 + '" /* c */'
    got = spark.createDataFrame([(text,)], "t string").select(L.segments(F.col("t"), REGISTRY["C"]).alias("s")).first().s
    assert [s.kind for s in got] == ["literal", "code", "comment"]


def test_masks_keep_places(spark):
    text = 'int é = "漢字"; // 😀 c\n'
    for contexts in (["code"], ["comment"], ["literal"], ["code", "comment"]):
        got = spark.createDataFrame([(text,)], "t string").select(L.visible(F.col("t"), REGISTRY["C"], contexts)).first()[0]
        assert len(got) == len(text) and got.count("\n") == 1
        assert all(a == b or a == " " for a, b in zip(got, text, strict=True))


def test_numbers(spark):
    got = {t: [c.token for c in spark.createDataFrame([(t,)], "t string").select(L.chunks(F.col("t"), REGISTRY["C"])).first()[0]] for t in (".5", "..5", "1e5", "10L", "12th")}
    assert got == {".5": [".5"], "..5": ["..", "5"], "1e5": ["1e5"], "10L": ["10", "L"], "12th": ["12", "th"]}


def test_shaping(corpus):
    found = search(corpus, SearchSpec("foo"))
    assert {r.path: r.n_lines for r in shaping.count_per_file(found, "path").collect()} == {"a.c": 5, "b.txt": 1, "n.txt": 1}
    assert shaping.stats(found, corpus, "path").first().asDict() == {"n_matches": 7, "n_matching_files": 3, "n_files": 4}
    assert "b.txt:1:1:foo, food foo" in {r.row for r in shaping.text_rows(found, "path").collect()}
    parsed = [json.loads(r.json) for r in shaping.json_rows(found, "path").collect()]
    assert next(p for p in parsed if p["file"] == "a.c")["matches"][2] == {"row": 3, "tokens": [{"col": 18, "token": "foo"}]}
    coloured = found.where("path = 'b.txt'").select(shaping.colored(F.col("line"), F.col("chunks"), "<", ">")).first()[0]
    assert coloured == "<foo>, <foo>d <foo>"


def test_classification(spark, tmp_path):
    assert [files.type_of(p) for p in ("a.c", "a.h", "Makefile", "go.mod", "x.tar.gz", "noext", ".c", "README", "CMakeLists.txt")] == ["C", "Cpp", "Make", "GoMod", None, None, "C", "Text", "CMake"]
    assert files.type_of("a.h", code_only=True) is None and files.type_of("a.c", header_only=True) is None
    with pytest.raises(ValueError):
        files.type_of("a.h", code_only=True, header_only=True)
    for name in (".hidden/x.c", "git/y.c", "foogit/z.c", "src/a.py", "src/bad.py"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"\xff\xfe" if "bad" in name else b"foo = 1\n")
    found = files.directory(spark, str(tmp_path), prune=["git"])
    assert sorted(r.file_name for r in found.collect()) == ["a.py", "bad.py", "x.c"]
    assert [r.file_name for r in found.where("error IS NOT NULL").collect()] == ["bad.py"]
    assert search(found, SearchSpec("foo", types={"Python"})).count() == 1


def test_options():
    assert chosen_types(["C"], ["Go"]) == {"C"} and chosen_types(["+C"], ["Go"]) == {"Go"} and chosen_types(["C", "+Go", "-C"]) == {"Go"}
    for bad in ({"strategy": "x"}, {"tests": "only"}, {"contexts": "x"}, {"strategy": "semantic", "contexts": "literal"}, {"token_types": "bracket", "strategy": "token"}):
        with pytest.raises(ValueError):
            SearchSpec("a", **bad)


def test_no_exchange_and_pushed_filter(spark, tmp_path):
    spark.createDataFrame([("a", "Text", "foo")], "path string, file_type string, content string").write.parquet(str(tmp_path / "t"))
    plan = search(spark.read.parquet(str(tmp_path / "t")), SearchSpec("foo", types={"Text"}, max_count=1))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "StringContains(content,foo)" in plan


def test_stream(spark, tmp_path):
    from textloom.streaming import search_stream, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\nfoo\n")
    query = search_stream(text_stream(spark, str(tmp_path / "in")), SearchSpec("foo", types={"Text"})).writeStream.format("memory").queryName("found").start()
    query.processAllAvailable()
    query.stop()
    assert [r.line_no for r in spark.table("found").collect()] == [2]


def test_fuzzy_words_with_accents(spark, tmp_path):
    """Edits are counted in letters, and a hit with an accented letter stays."""
    from textloom import catalog

    words = ["treation", "treétion", "treètïon", "tréâtïön", "creation", "nothing", "été"]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(w):
        m, d = min(len(w), len(catalog.FUZZY)), distance(w, catalog.FUZZY)
        return d < 3 if m < 5 else d < m * 40 // 100

    got = {r.token for r in catalog.queries()["fuzzy_words"](spark, str(tmp_path)).collect()}
    assert got == {w for w in words if near(w)} and "treétion" in got


def test_spread_follows_the_input(spark, tmp_path, monkeypatch):
    """A row group is one split's, however many splits there are; what is lexed goes to even shares of the text."""
    path = str(tmp_path / "pages.parquet")
    spark.range(2000).selectExpr("id AS page_id", "concat('<a href=\"', sha2(string(id), 512), '\">') AS html").coalesce(1).write.parquet(path)
    rows = lambda df: [n for n in df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        table = files.table(spark.read.parquet(path), "html", "Html", "page_id")
        assert table.rdd.getNumPartitions() > 8 and len(rows(table)) == 1
        dealt = rows(files.spread(table))
        assert sum(dealt) == 2000 and len(dealt) == 4 and max(dealt) < 600
        monkeypatch.setattr(files, "SHARE", 10_000)
        dealt = rows(files.spread(table))
        assert sum(dealt) == 2000 and len(dealt) == 28 and max(dealt) < 90
        grouped = search(files.spread(table), SearchSpec("_ = STR", types="Html", strategy="semantic"))
        assert grouped.selectExpr("size(chunks) AS n").groupBy("n").count().collect() == [(3, 2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hits_among_comments_and_lines(spark):
    """Comments and literals over several lines stand between tokens or are hits; each hit has its type, line and column."""
    text = 'a /* = "x"\n */ = // y\n\n  "s\n\n t" ; b = "u"\nc = 1 /* "'
    df = spark.createDataFrame([(text,), ("",), ("/* = */\n",), (None,)], "content string").selectExpr("'C' AS file_type", "content")
    found = lambda **o: [(r.line_no, [tuple(c) for c in r.chunks]) for r in search(df, SearchSpec(types="C", **o)).orderBy("line_no").collect()]
    assign = [(1, [("identifier", "a", 1)]), (2, [("operator", "=", 2)]), (4, [("string", '"s\n\n t"', 3)]), (6, [("identifier", "b", 4), ("operator", "=", 6), ("string", '"u"', 8)])]
    assert found(patterns="_ = STR", strategy="semantic") == assign
    assert found(patterns=("_ = STR", "= NUM"), strategy="semantic") == [*assign, (7, [("operator", "=", 3), ("number", "1", 5)])]
    assert found(patterns="=", strategy="token") == [(2, [("operator", "=", 2)]), (6, [("operator", "=", 6)]), (7, [("operator", "=", 3)])]
    assert found(patterns="ANY ANY ANY ANY ANY ANY ANY ANY ANY ANY ANY", strategy="semantic") == []  # there are ten tokens
    assert len(found(patterns="ANY ANY ANY ANY ANY ANY ANY ANY ANY ANY", strategy="semantic")) == 5
