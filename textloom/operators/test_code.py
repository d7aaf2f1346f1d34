"""Test code: which tokens of a file belong to tests, and semantic search among them or without them.

Regions are balanced or end at a terminator, so they are beyond a regular
expression: eligible files go through one Arrow function, row by row.  A rule
looks at the tokens from a place on and returns the region's end, or None; a
trigger without a body is no region.  Types without rules are left whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import lexing as L
from textloom.functions.registry import Language
from textloom.operators import matching as M
from textloom.plans.spec import SearchSpec

PAIRS = {"{": "}", "(": ")", "[": "]"}


class Token(tuple):
    """(type letter, text, line number, column)."""

    __slots__ = ()
    type, text, line, col = (property(lambda self, i=i: self[i]) for i in range(4))


def lex(text: str, lang: Language, strict: bool = False) -> list[Token]:
    """Typed tokens as lexing.tokens has them."""
    pattern = regex.compile(L.token_regex(lang, strict).replace(r"\z", r"\Z"), regex.V1)
    comments, literals = tuple(a for a, _ in lang.comments), tuple(a for a, *_ in L.literal_patterns(lang))
    space, out, line, begin = re.compile(f"[{L.SPACE}]+"), [], 1, 0
    for m in pattern.finditer(text):
        t = m.group()
        if not space.fullmatch(t) and not (comments and t.startswith(comments) and len(t) > 1):
            if literals and t.startswith(literals) and len(t) > 1:
                kind = "s"
            elif re.match(r"\.?[0-9]", t):
                kind = "d"
            elif t in "[]{}()":
                kind = "b"
            elif lang.charset and regex.match(rf"[{'_' if lang.charset in ('clojure', 'agda') else ''}\p{{L}}_$]", t):
                kind = "n" if t in lang.natives else "k" if t in lang.keywords else "i"
            else:
                kind = "o"
            out.append(Token((kind, t, line, m.start() - begin + 1)))
        if "\n" in t:
            line += t.count("\n")
            begin = m.start() + t.rindex("\n") + 1
    return out


def balanced(t: list[Token], i: int) -> int:
    """End of the bracket region that opens at i; the end of the file if it never closes."""
    opening, depth = t[i].text, 0
    for j in range(i, len(t)):
        depth += (t[j].text == opening) - (t[j].text == PAIRS[opening])
        if not depth:
            return j + 1
    return len(t)


def body(t: list[Token], i: int, reach: int, opening: str = "{", stop=()) -> int | None:
    """End of the region of the first such bracket within reach."""
    for j in range(i, min(len(t), i + reach + 1)):
        if t[j].text == opening and t[j].type != "s":
            return balanced(t, j)
        if t[j].text in stop:
            return None
    return None


def text_at(t: list[Token], i: int) -> str:
    return t[i].text if 0 <= i < len(t) and t[i].type != "s" else ""


def calls(names: str, reach: int, opening: str = "(", stop=()):
    """``name (`` and the body that follows."""
    among = set(names.split())

    def rule(t, i):
        if t[i].text in among and t[i].type in "ik" and text_at(t, i + 1) == "(":
            return balanced(t, i + 1) if opening == "(" else body(t, i + 1, reach, opening, stop)
        return None

    return rule


def named(before: str, name: str, reach: int, stop=()):
    """A keyword, a name that fits, and a body in braces."""
    fits = re.compile(name)

    def rule(t, i):
        if t[i].text != before:
            return None
        j = i + 1
        if text_at(t, j) == "(":  # a receiver
            j = balanced(t, j)
        return body(t, j + 1, reach, stop=stop) if fits.fullmatch(text_at(t, j)) else None

    return rule


def word(names: str, reach: int):
    among = set(names.split())
    return lambda t, i: body(t, i + 1, reach) if t[i].text in among and t[i].type in "ik" else None


def attributes(opening: tuple[str, ...], marks, reach: int, stop=()):
    """A run of bracketed attributes, one of which holds a mark, and a body in braces."""

    def rule(t, i):
        j, test = i, False
        while all(text_at(t, j + k) == x for k, x in enumerate(opening)):
            end = balanced(t, j + len(opening) - 1)
            test |= any(x.type in "ik" and marks(x.text) for x in t[j:end])
            j = end
        return body(t, j, reach, stop=stop) if test else None

    return rule


def annotations(marks, reach: int, stop=(), region=None):
    """A run of ``@A.b(...)``, one of which is a mark, and a body in braces."""

    def rule(t, i):
        j, test = i, False
        while text_at(t, j) == "@" or text_at(t, j).startswith("@") and len(text_at(t, j)) > 1:
            j += 1 if text_at(t, j) == "@" else 0
            while True:
                test |= marks(text_at(t, j).lstrip("@"))
                j += 1
                if text_at(t, j) != ".":
                    break
                j += 1
            if text_at(t, j) == "(":
                j = balanced(t, j)
        if not test:
            return None
        return region(t, j, reach) if region else body(t, j, reach, stop=stop)

    return rule


def until(starts, ends):
    """From a start to the next end, which is not part of it."""

    def rule(t, i):
        if not starts(t, i):
            return None
        return next((j for j in range(i + 1, len(t)) if ends(t, j)), len(t))

    return rule


def to_end(starts, opens: str, closes: str = "end"):
    """From a start to the ``end`` that closes it."""
    among = set(opens.split())

    def rule(t, i):
        if not starts(t, i):
            return None
        depth = 0
        for j in range(i, len(t)):
            if t[j].type == "s":
                continue
            depth += (t[j].text in among) - (t[j].text == closes)
            if t[j].text == closes and depth <= 0:
                return j + 1
        return len(t)

    return rule


def one_declaration(t, i, reach=100):
    """A body in braces that no second declaration comes before: a method without body does not take the next one's."""
    declared = 0
    for j in range(i, min(len(t), i + reach + 1)):
        if t[j].text == "{" and t[j].type == "b":
            return balanced(t, j)
        declared += t[j].type == "k" and t[j].text in ("fun", "class", "interface", "val", "var")
        if declared > 1:
            return None
    return None


def _fsharp_attribute(t, i):
    """End of ``[< ... >]`` at i, however its signs are lexed; None if there is none."""
    if text_at(t, i) != "[<" and not (text_at(t, i) == "[" and text_at(t, i + 1) == "<"):
        return None
    j = i + 1
    while j < len(t):
        if text_at(t, j) == "(":
            j = balanced(t, j)
        elif text_at(t, j) == ">]":
            return j + 1
        elif text_at(t, j) == ">" and text_at(t, j + 1) == "]":
            return j + 2
        else:
            j += 1
    return None


def _fsharp_binding(t, i):
    """From a binding's first token to the next attribute, declaration or combinator."""
    for j in range(i + 1, len(t)):
        if _fsharp_attribute(t, j) or t[j].type == "k" and t[j].text in _FSHARP_STOPS or t[j].type == "i" and t[j].text in _EXPECTO:
            return j
    return len(t)


def _fsharp(t, i):
    """Runs of attributes, one of them a test's, with their binding; Expecto's combinators with their block, list or binding."""
    if t[i].type == "i" and t[i].text in _EXPECTO:
        j = i + 1 + (i + 1 < len(t) and t[i + 1].type == "s")
        return balanced(t, j) if text_at(t, j) in ("{", "[") else _fsharp_binding(t, j)
    j, test = i, False
    while (end := _fsharp_attribute(t, j)) is not None:
        test |= any(x.type == "i" and x.text in _FSHARP_MARKS for x in t[j:end])
        j = end
    return _fsharp_binding(t, j) if test else None


def _julia(t, i):
    """``@test...`` and what it holds: a block, an argument list, or the tokens up to the next macro or definition."""
    if not (text_at(t, i) == "@" and text_at(t, i + 1).startswith("test")):
        return None
    for j in range(i + 2, len(t)):
        now = text_at(t, j)
        if now in ("begin", "for"):
            depth = 0
            for k in range(j, len(t)):
                depth += (text_at(t, k) in _JULIA_OPENS) - (text_at(t, k) == "end")
                if not depth:
                    return k + 1
            return len(t)
        if now == "(":
            return balanced(t, j)
        if now in ("@", "function", "struct", "mutable", "macro", "module", "end"):
            return j
    return len(t)


def _haskell_starts(t, i):
    return t[i].type == "i" and (t[i].text in _HASKELL_SPECS or t[i].text.startswith("prop_"))


def _haskell_ends(t, j):
    typed = t[j].type == "o" and (t[j].text == "::" or t[j].text == ":" and text_at(t, j + 1) == ":")
    return typed or _haskell_starts(t, j) or t[j].type in "ik" and t[j].text in ("main", "data", "type", "class", "instance", "newtype", "module")


def _objective_c(t, i):
    """``- (void) testX``, ``setUp`` and ``tearDown`` with their bodies."""
    name = text_at(t, i + 4)
    sign = text_at(t, i) in ("-", "+") and text_at(t, i + 1) == "(" and text_at(t, i + 3) == ")"
    return body(t, i + 5, 100) if sign and (name.startswith("test") or name in ("setUp", "tearDown")) else None


def _split_r(t, i):
    """``test _ that (``: the name as three tokens."""
    if text_at(t, i) == "test" and text_at(t, i + 1) == "_" and text_at(t, i + 2) in ("that", "dir", "file"):
        return body(t, i + 3, 20, "(")
    return None


def _java(name: str) -> bool:
    return "Test" in name or name.startswith(("Before", "After"))


def _def(t, i):
    return t[i].text in ("def", "class") and t[i].type == "k"


def _python(t, i):
    """Decorators, ``def test_…``, ``class Test…`` or ``(unittest.TestCase)``, to the next definition no deeper."""
    j = i
    if text_at(t, i) == "@":
        if text_at(t, i + 1) not in ("pytest", "unittest", "patch", "mock"):
            return None
        while j < len(t) and not _def(t, j):
            j += 1
    elif text_at(t, i) == "async" and text_at(t, i + 1) == "def":
        j = i + 1
    if j >= len(t) or not _def(t, j):
        return None
    name, header = text_at(t, j + 1), [x.text for x in t[j : j + 12]]
    base = header[: header.index(":")] if ":" in header else header
    test = name.startswith("test_") if t[j].text == "def" else name.startswith("Test") or "TestCase" in base
    if not (test or text_at(t, i) == "@"):
        return None
    column = t[i].col
    last = t[j].line
    return next((k for k in range(j + 1, len(t)) if t[k].line > last and t[k].col <= column and t[k - 1].line < t[k].line), len(t))


def _starts(names: str):
    among = set(names.split())
    return lambda t, i: t[i].type in "ik" and t[i].text in among


_HASKELL_SPECS = {"describe", "it", "context", "testCase", "testGroup", "testProperty"}
_JULIA_OPENS = {"begin", "for", "if", "function", "let", "while", "try", "do", "struct", "macro", "quote"}
_FSHARP_STOPS = {"module", "namespace", "type", "member", "static", "abstract", "override", "interface"}
_FSHARP_MARKS = {"Test", "TestFixture", "TestCase", "TestCaseSource", "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown", "Category", "Fact", "Theory", "InlineData", "MemberData", "ClassData", "Property"}
_EXPECTO = {"test", "testList", "testCase", "testCaseAsync", "testAsync", "testSequenced", "testProperty", "testPropertyWithConfig", "ftest", "ptest", "ftestCase", "ptestCase"}
_XUNIT = {"Fact", "Theory", "Test", "TestCase", "TestMethod", "TestFixture", "TestClass", "SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown", "TestInitialize", "TestCleanup", "ClassInitialize", "ClassCleanup", "InlineData", "DataTestMethod"}
_SPECS = "describe context it xdescribe xcontext xit test xtest"
_C = [calls("TEST TEST_F TEST_CASE TYPED_TEST SECTION SUITE", 100, "{", (";",)), lambda t, i: body(t, i + 1, 50, stop=(";",)) if t[i].type == "i" and re.match("test_|Test", t[i].text) and text_at(t, i + 1) == "(" and text_at(t, i - 1) not in ("=", "(", ",", ".", "return") else None]
_RUBY_OPENS = "do def class module if unless while until case begin for"
RULES = {
    "Rust": [attributes(("#", "["), lambda w: w in ("test", "rstest", "test_case"), 50)],
    "Go": [named("func", "(?:Test|Benchmark|Example|Fuzz).*", 50)],
    "Java": [annotations(_java, 100, (";",))],
    "Kotlin": [annotations(_java, 100, region=one_declaration), calls(_SPECS, 100, "{")],
    "C": _C,
    "Cpp": _C,
    "Python": [_python],
    "Zig": [word("test", 20)],
    "Javascript": [calls("describe it test context", 0)],
    "Scala": [calls("test it describe scenario feature", 20, "{")],
    "Haskell": [until(_haskell_starts, _haskell_ends)],
    "Csharp": [attributes(("[",), lambda w: w in _XUNIT, 200)],
    "Fsharp": [_fsharp],
    "Dart": [calls("test group testWidgets setUp tearDown setUpAll tearDownAll", 0)],
    "Elixir": [to_end(_starts("test describe setup setup_all"), "do fn"), to_end(lambda t, i: text_at(t, i) == "defmodule" and any(text_at(t, j).endswith("Test") for j in range(i + 1, i + 6)), "do fn")],
    "Ruby": [to_end(_starts("describe context it"), _RUBY_OPENS), to_end(lambda t, i: text_at(t, i) == "def" and re.match("test_|setup$|teardown$", text_at(t, i + 1)) or text_at(t, i) == "class" and text_at(t, i + 1).startswith("Test"), _RUBY_OPENS)],
    "PHP": [calls("test it describe", 0), attributes(("#", "["), lambda w: w.startswith("Test"), 100), named("function", "test.*|setUp.*|tearDown.*", 100), named("class", ".*Test.*", 200)],
    "Swift": [annotations(lambda w: w in ("Test", "Suite"), 200), named("func", "test.*|setUp.*|tearDown.*", 100), named("class", ".*Test.*", 200), named("struct", ".*Test.*", 200), named("extension", ".*Test.*", 200)],
    "ObjectiveC": [_objective_c, named("class", ".*Test.*", 200)],
    "R": [calls("test_that describe context it test_dir test_file", 20), _split_r],
    "Julia": [_julia],
    "Perl": [word("subtest test", 20)],
    "OCaml": [to_end(lambda t, i: text_at(t, i) == "module" and text_at(t, i + 1).startswith("Test") and text_at(t, i + 3) == "struct", "struct sig begin object"), until(lambda t, i: text_at(t, i) == "let" and text_at(t, i + 1) == "%" and text_at(t, i + 2).startswith(("test", "expect_test")), lambda t, j: text_at(t, j) == "let" and t[j].col == 1)],
    "Erlang": [lambda t, i: next((j + 1 for j in range(i, len(t)) if text_at(t, j) == "." and (j + 1 == len(t) or t[j + 1].line > t[j].line)), len(t)) if t[i].type == "i" and re.search("_test_?$", t[i].text) and t[i].col == 1 else None],
    "Nim": [until(_starts("suite test"), lambda t, j: t[j].text in ("proc", "func", "iterator", "macro", "template", "method", "suite") and t[j].type in "ik")],
    "Clojure": [lambda t, i: balanced(t, i) if text_at(t, i) == "(" and text_at(t, i + 1) in ("deftest", "testing") else None],
    "D": [word("unittest", 20)],
}


def test_tokens(tokens: list[Token], file_type: str) -> list[bool] | None:
    """Which tokens lie in tests; None for a type without rules."""
    if file_type not in RULES:
        return None
    flags, i = [False] * len(tokens), 0
    while i < len(tokens):
        end = next((e for rule in RULES[file_type] if (e := rule(tokens, i)) is not None), None) if tokens[i].type != "s" else None
        if end is None or end <= i:
            i += 1
            continue
        flags[i:end] = [True] * (end - i)
        i = end
    return flags


def kept(tokens: list[Token], file_type: str, tests: str) -> list[Token]:
    flags = test_tokens(tokens, file_type)
    return tokens if flags is None else [t for t, x in zip(tokens, flags, strict=True) if x == (tests == "only")]


def _fits(t: Token, atom, spec: SearchSpec) -> bool:
    kind, letter, want = atom
    value = t.text.lower() if spec.ignore_case else t.text
    want = want.lower() if spec.ignore_case and kind == "exact" else want
    if kind == "placeholder":
        return t.type == "i"
    if kind == "wildcard":
        return {"ANY": True, "KEY": t.type == "k", "NUM": t.type == "d", "OCT": t.type == "d" and t.text[:2] == "0d", "HEX": t.type == "d" and t.text[:2] == "0x"}.get(want, t.type == "s")
    if t.type != letter:
        return False
    if letter == "s":
        value = (value[1:-1] if value[:1] == value[-1:] else value).strip()
    if letter not in "is":
        return value == want
    return {"infix": want in value, "word": value == want, "prefix": value.startswith(want), "suffix": value.endswith(want), "edit": abs(len(value) - len(want)) < 3 and _near(value, want)}[spec.anchor]


def _near(a: str, b: str) -> bool:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    m = min(len(a), len(b))
    return row[-1] < (3 if m < 5 else m * 40 // 100)


def windows(tokens: list[Token], spec: SearchSpec, lang: Language) -> list[Token]:
    """Tokens of all windows that some pattern fits."""
    hit = set()
    for pattern in spec.patterns:
        wanted = M.atoms(pattern, lang, spec.strict)
        for i in range(len(tokens) - len(wanted) + 1 if wanted else 0):
            own = tokens[i : i + len(wanted)]
            if all(_fits(t, a, spec) for t, a in zip(own, wanted, strict=True)):
                bound: dict[str, str] = {}
                same = all(bound.setdefault(a[2], t.text) == t.text for t, a in zip(own, wanted, strict=True) if a[0] == "placeholder" and re.fullmatch("_[0-9]", a[2]))
                hit |= set(range(i, i + len(wanted))) if same else set()
    return [tokens[i] for i in sorted(hit)]


def search_tests(files: DataFrame, spec: SearchSpec, keys: list[str]) -> DataFrame:
    """Semantic matches among test code only, or without it; ``error`` rows are left out, other files go on."""
    names = {letter: name for name, letter in L.TYPES.items()}
    chunk = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("token", T.StringType()), T.StructField("col", T.IntegerType())]))
    schema = T.StructType([*(files.schema[k] for k in keys), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("chunks", chunk)])

    def matches(content, file_type):
        lang = spec.registry.get(file_type)
        if content is None or lang is None:
            return
        by: dict[int, list] = {}
        for t in windows(kept(lex(content, lang, spec.strict), file_type, spec.tests), spec, lang):
            by.setdefault(t.line, []).append({"type": names[t.type], "token": t.text, "col": t.col})
        rows = [(i, line, by.get(i, [])) for i, line in enumerate(content.split("\n"), 1) if (i in by) != spec.invert]
        yield from rows[: spec.max_count]

    def run(batches):
        for batch in batches:
            where, out = [], []
            for i, (content, file_type) in enumerate(zip(batch.column("content").to_pylist(), batch.column("file_type").to_pylist(), strict=True)):
                for row in matches(content, file_type):
                    where.append(i)
                    out.append(row)
            columns = zip(*out, strict=True) if out else ([], [], [])
            kinds = (pa.int32(), pa.string(), pa.list_(pa.struct([("type", pa.string()), ("token", pa.string()), ("col", pa.int32())])))
            arrays = [batch.column(k).take(pa.array(where, pa.int64())) for k in keys] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "line_no", "line", "chunks"])

    return files.select(*keys, F.col("content"), F.col("file_type")).mapInArrow(run, schema)
