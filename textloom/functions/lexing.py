"""Lexers and the context filter as Spark expressions.

The context filter is "leftmost position, first alternative": per language it
compiles to one regular expression whose matches cover the text, so one
``regexp_extract_all`` segments it on the JVM.  Lexers are alternations too.
Java's possessive quantifiers keep a literal with many escapes off the stack;
``dialect="re2"`` gives DuckDB's flavour of the same expressions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.registry import CHARSETS, Language

#: White space of the lexers: code points 0-13 but 2 and 3, blank, no-break space.
SPACE = r"\x00\x01\x04-\x0D\x20\xA0"
BRACKETS = r"\[\]{}()"
NUMBER = r"\.?[0-9][0-9A-Fa-f.xX]*"
CODE, COMMENT, LITERAL = "code", "comment", "literal"
CONTEXTS = (CODE, COMMENT, LITERAL)
#: Token types, each with the letter that stands for it inside expressions.
TYPES = {"identifier": "i", "keyword": "k", "native": "n", "number": "d", "bracket": "b", "operator": "o", "string": "s"}


def quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else f"\\x{ord(c):02X}" if ord(c) < 256 else c for c in text)


def _until(end: str) -> str:
    return rf".*?(?:{quote(end)}|\z)"


def _escaped(begin: str, end: str, possessive: str) -> str:
    """A literal whose backslash escapes the next character."""
    stop = quote(end[0])
    plain = rf"[^{stop}\\]*{possessive}"
    if len(end) == 1:
        return rf"{quote(begin)}{plain}(?:\\.{plain})*{possessive}(?:{stop}|\\?\z)"
    return rf"{quote(begin)}(?:\\.|[^\\])*?(?:{quote(end)}|\\?\z)"


def literal_patterns(lang: Language, dialect: str = "java") -> list[tuple[str, str, str]]:
    """(begin, end, pattern) of strings, raw strings and characters, in the order in which they are tried."""
    plus = "+" if dialect == "java" else ""
    found = [(a, b, _escaped(a, b, plus)) for a, b in lang.strings]
    found += [(a, b, quote(a) + _until(b)) for a, b in lang.raws]
    for a, b in lang.chars:
        if b:
            ahead = rf"(?=(?:\\.|[^\\]){quote(b)})" if dialect == "java" else ""
            found.append((a, b, quote(a) + ahead + _escaped(a, b, plus)[len(quote(a)) :]))
    return found


def segment_regex(lang: Language, dialect: str = "java") -> str:
    """Comments, literals and stretches of code; its matches cover any text."""
    comments = [quote(a) + _until(b) for a, b in lang.comments]
    literals = literal_patterns(lang, dialect)
    first = "".join(sorted({quote(a[0]) for a, *_ in (*lang.comments, *literals)}))
    code = [rf"[^{first}]+", "."] if first else [".+"]
    return "(?s)" + "|".join([*comments, *(p for *_, p in literals), *code])


def _begins(segment: Column, delimiters) -> Column:
    """The segment is one of these regions: it opens with a delimiter and is more than a lone sign of code."""
    tests = [segment.startswith(F.lit(a)) & (F.length(segment) > (len(a) if len(a) == 1 and b != "\n" else len(a) - 1)) for a, b, *_ in delimiters]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def segments(text: Column, lang: Language) -> Column:
    """array<struct<kind, text>>: every part of the text with its context, in order."""

    def kind(s: Column) -> Column:
        return F.when(_begins(s, lang.comments), COMMENT).when(_begins(s, literal_patterns(lang)), LITERAL).otherwise(CODE)

    parts = F.regexp_extract_all(text, F.lit(segment_regex(lang)), F.lit(0))
    return F.transform(parts, lambda s: F.struct(kind(s).alias("kind"), s.alias("text")))


def blanked(text: Column) -> Column:
    """Blanks for all but white space; characters keep their places."""
    return F.regexp_replace(text, f"[^{SPACE}]", " ")


def _literal_ends(s: Column, lang: Language) -> tuple[Column, Column]:
    """Lengths of the delimiters at the literal's ends; an unterminated one has none at its end."""
    begin, end = F.lit(1), F.lit(0)
    for a, b, _ in reversed(literal_patterns(lang)):
        here = s.startswith(F.lit(a))
        begin = F.when(here, F.lit(len(a))).otherwise(begin)
        closed = s.endswith(F.lit(b)) & (F.length(s) >= len(a) + len(b))
        end = F.when(here, F.when(closed, F.lit(len(b))).otherwise(F.lit(0))).otherwise(end)
    return begin, end


def visible(text: Column, lang: Language | None, contexts=CONTEXTS) -> Column:
    """The text with all other contexts blanked.

    A comment's delimiters belong to the comment, a literal's to the code.  All
    contexts, none or an unknown language leave the text as it is.
    """
    shown = set(contexts)
    if lang is None or not shown or shown == set(CONTEXTS) or not (lang.comments or lang.strings or lang.raws or lang.chars):
        return text if lang is None or not shown or CODE in shown else blanked(text)

    def show(seg: Column) -> Column:
        s = seg["text"]
        begin, end = _literal_ends(s, lang)
        edge, inner = (s if k in shown else blanked(s) for k in (CODE, LITERAL))
        middle = F.greatest(F.length(s) - begin - end, F.lit(0))
        literal = F.concat(F.substring(edge, F.lit(1), begin), F.substring(inner, begin + 1, middle), F.substring(edge, begin + middle + 1, end))
        return F.when(seg["kind"] == COMMENT, s if COMMENT in shown else blanked(s)).when(seg["kind"] == LITERAL, literal).otherwise(edge)

    return F.array_join(F.transform(segments(text, lang), show), "")


def chunk_regex(lang: Language | None) -> str:
    """Words of a text: identifiers, numbers, single brackets, other runs."""
    start, cont = CHARSETS.get(lang.charset, ("", "")) if lang and lang.charset else ("", "")
    other = f"[^{SPACE}{BRACKETS}0-9{start}]+" if not start.startswith("^") else f"[^{SPACE}{BRACKETS}0-9&&[{_outside(start)}]]+"
    return "|".join([*([f"[{start}][{cont}]*"] if start else []), NUMBER, f"[{BRACKETS}]", other])


def _outside(negated: str) -> str:
    return negated[1:]


def spaced(lang: Language | None) -> str:
    """chunk_regex with runs of white space and a last resort, so that matches cover a line."""
    return f"(?s){chunk_regex(lang)}|[{SPACE}]+|."


def token_regex(lang: Language, strict: bool = False, dialect: str = "java") -> str:
    """Typed tokens: comments, literals, white space, identifiers, numbers, brackets, operators; covers any text."""
    start, cont = CHARSETS.get(lang.charset, ("", "")) if lang.charset else ("", "")
    strict = strict or not start
    sign = f"[^{SPACE}{BRACKETS}0-9{start}]" if not start.startswith("^") else f"[^{SPACE}{BRACKETS}0-9&&[{_outside(start)}]]"
    opening = "".join(sorted({quote(a[0]) for a, *_ in (*lang.comments, *literal_patterns(lang, dialect))}))
    run = f"[^{SPACE}{BRACKETS}0-9{start if not start.startswith('^') else ''};,.{opening}]"
    operator = f"{sign}{run}*" if strict else sign
    parts = [quote(a) + _until(b) for a, b in lang.comments] + [p for *_, p in literal_patterns(lang, dialect)]
    parts += [f"[{SPACE}]+", *([f"[{start}][{cont}]*"] if start else []), NUMBER, f"[{BRACKETS}]", operator, "."]
    return "(?s)" + "|".join(parts)


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Parts whose places are added up in one go; more go block by block, so the cost stays in proportion to a line's length.
BLOCK = 2048


def places(parts: Column) -> Column:
    """1-based columns at which parts of a line start, and the column after the last.

    The sums are gathered in a string: growing an array copies it value by value.
    """

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + F.length(x)
        return F.struct(F.concat(a["said"], F.lit(","), at.cast("string")).alias("said"), at.alias("at"))

    def start(at: Column) -> Column:
        return F.struct(F.lit("").alias("said"), at.alias("at"))

    def summed(ps: Column) -> Column:
        def block(a: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(ps, i * BLOCK + 1, F.lit(BLOCK)), start(a["at"]), step)
            return bound(own, lambda o: F.struct(F.concat(a["said"], o["said"]).alias("said"), o["at"].alias("at")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / BLOCK).cast("int"))
        long = F.aggregate(blocks, start(F.lit(1)), block)
        return F.when(F.size(ps) <= BLOCK, F.aggregate(ps, start(F.lit(1)), step)).otherwise(long)["said"]

    said = F.concat(F.lit("1"), bound(parts, summed))
    return F.transform(F.split(said, ","), lambda x: x.cast("int"))


def placed(parts: Column) -> Column:
    """array<struct<token, col>> of the parts of a line, with 1-based character columns."""
    return bound(parts, lambda ps: F.zip_with(ps, F.slice(places(ps), F.lit(1), F.size(ps)), lambda p, c: F.struct(p.alias("token"), c.alias("col"))))


def words(line: Column, lang: Language | None) -> Column:
    """Words and runs of white space of a line, in turn."""
    return F.regexp_extract_all(line, F.lit(spaced(lang)), F.lit(0))


def is_space(token: Column) -> Column:
    return token.rlike(rf"^[{SPACE}]+$")


def chunks(line: Column, lang: Language | None) -> Column:
    """Words of a line with their columns."""
    return F.filter(placed(words(line, lang)), lambda c: ~is_space(c["token"]))


MARK = "\x02"
TOKENS = "array<struct<type:string,text:string,line_no:int,col:int>>"


def led_regex(lang: Language, strict: bool = False) -> str:
    """Tokens, each with the comments and white space before it; group 1 is the token, an empty one at the text's end."""
    # a lone sign at the end is no comment, as in _begins
    comments = [quote(a) + (r"(?!\z)" if len(a) == 1 and b != "\n" else "") + _until(b) for a, b in lang.comments]
    return rf"(?s)(?:{'|'.join([*comments, f'[{SPACE}]+'])})*+({token_regex(lang, strict).removeprefix('(?s)')}|\z)"


def type_of(token: Column, lang: Language) -> Column:
    """The letter of a token's type."""
    start, _ = CHARSETS.get(lang.charset, ("", "")) if lang.charset else ("", "")
    kind = F.when(_begins(token, literal_patterns(lang)), "s").when(token.rlike(r"^\.?[0-9]"), "d").when(token.rlike(f"^[{BRACKETS}]"), "b")
    if start:
        word = token.rlike(f"^[{start}]")
        kind = kind.when(word & token.isin(*sorted(lang.natives)), "n") if lang.natives else kind
        kind = kind.when(word & token.isin(*sorted(lang.keywords)), "k") if lang.keywords else kind
        kind = kind.when(word, "i")
    return kind.otherwise("o")


def hit_lines(text: Column, lang: Language, strict: bool, hits, alone: bool = False) -> Column:
    """Each line's array<struct<type, text, line_no, col>> of hits; no lines at all where there is none.

    ``hits`` makes flags of the array of all tokens.  Only hits are typed and
    placed: they are marked in the text, which is then split at newlines; a token
    that spans lines stays on its first, its newlines kept as marks.  What stands
    between hits follows a mark of its own.  ``alone``: no flag depends on other
    tokens, so comments and white space may stand among them.
    """
    hide = MARK + "-"

    def on_first(s: Column) -> Column:
        lines = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("\n"), F.lit(0)), lambda x: F.concat(x, F.lit(hide))), "")
        return F.concat(F.replace(s, F.lit("\n"), F.lit("\x03")), lines)

    def blank(s: Column) -> Column:
        return F.replace(s, F.lit("\n"), F.lit("\n" + hide))

    def shown(lead: Column) -> Column:
        if not lang.comments:
            return blank(lead)
        parts = F.regexp_extract_all(lead, F.lit(token_regex(lang, strict)), F.lit(0))
        each = F.array_join(F.transform(parts, lambda s: F.when(is_space(s), blank(s)).otherwise(on_first(s))), "")
        return F.when(lead.contains("\n"), each).otherwise(lead)

    def marked(s: Column) -> Column:
        once = F.replace(s, F.lit("\n"), F.lit("\x03"))
        lines = F.substring(on_first(s), F.length(s) + 1, F.length(on_first(s)))
        return F.concat(F.lit(MARK), type_of(s, lang), once, F.lit(hide), lines)

    def text_of(led: Column, tokens: Column, flags: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            token = F.coalesce(F.get(tokens, i), F.lit(""))
            lead = shown(F.substring(s, F.lit(1), F.length(s) - F.length(token)))
            return F.when(F.get(flags, i), F.concat(lead, marked(token))).when(s.contains("\n"), F.concat(lead, on_first(token))).otherwise(s)

        return F.concat(F.lit(hide), F.array_join(F.transform(led, part), ""))

    def line(row: Column, number: Column) -> Column:
        def lexed(parts: Column) -> Column:
            cols = F.slice(places(F.transform(parts, lambda p: F.substring(p, F.lit(2), F.length(p)))), F.lit(1), F.size(parts))
            found = F.zip_with(parts, cols, lambda p, c: F.struct(p.alias("p"), c.alias("col")))
            return F.transform(
                F.filter(found, lambda t: ~t["p"].startswith("-")),
                lambda t: F.struct(
                    F.substring(t["p"], 1, 1).alias("type"),
                    F.replace(F.substring(t["p"], F.lit(2), F.length(t["p"])), F.lit("\x03"), F.lit("\n")).alias("text"),
                    (number + 1).cast("int").alias("line_no"),
                    t["col"].alias("col"),
                ),
            )

        some = F.filter(F.split(row, MARK, -1), lambda x: F.length(x) > 0)
        return bound(some, lambda parts: F.when(F.exists(parts, lambda p: ~p.startswith("-")), lexed(parts)).otherwise(F.array().cast(TOKENS)))

    clean, regex = F.translate(text, "\x02\x03", "  "), F.lit(led_regex(lang, strict))

    def text_of_each(parts: Column, flags: Column) -> Column:
        part = lambda s, i: F.when(F.get(flags, i), marked(s)).when(s.contains("\n"), F.when(is_space(s), blank(s)).otherwise(on_first(s))).otherwise(s)
        return F.concat(F.lit(hide), F.array_join(F.transform(parts, part), ""))

    def found(tokens: Column, flags: Column) -> Column:
        marks = text_of_each(tokens, flags) if alone else text_of(F.regexp_extract_all(clean, regex, F.lit(0)), tokens, flags)
        lines = F.transform(F.split(marks, "\n", -1), line)
        return F.when(F.exists(flags, lambda f: f), lines).otherwise(F.array().cast(f"array<{TOKENS}>"))

    if alone:
        parts = F.regexp_extract_all(clean, F.lit(token_regex(lang, strict)), F.lit(0))
        picked = lambda ps: F.zip_with(hits(ps), ps, lambda f, p: f & ~is_space(p) & ~_begins(p, lang.comments))
        return bound(parts, lambda ps: bound(picked(ps), lambda flags: found(ps, flags)))
    every = F.filter(F.regexp_extract_all(clean, regex, F.lit(1)), lambda t: t != "")
    return bound(every, lambda tokens: bound(hits(tokens), lambda flags: found(tokens, flags)))


def most_edits(size: int) -> int:
    """The largest distance from a word of that length that any word may have."""
    return max(2, size * 40 // 100 - 1)


def fuzzy_equal(a: Column, b: str) -> Column:
    """Edit distance below 3 for words under five letters, else below 40 % of the shorter; far ones are given up early."""
    m, most = F.least(F.length(a), F.lit(len(b))), most_edits(len(b))
    d = F.levenshtein(a, F.lit(b), most)
    near = (d >= 0) & F.when(m < 5, d < 3).otherwise(d < F.floor(m * 40 / 100))
    return (F.abs(F.length(a) - len(b)) <= most) & near


def pieces(pattern: str) -> list[str]:
    """Parts of a pattern of which a word within its edit distance holds one unchanged; none if it is too short for that."""
    n = most_edits(len(pattern)) + 1
    cuts = [i * len(pattern) // n for i in range(n + 1)]
    return [pattern[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(pattern) >= n else []


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def unquoted(s: Column) -> Column:
    return F.regexp_replace(s, r"^(?s)([\"'])(.*)\1$", "$2")


def posix_longest(pattern: str) -> str:
    """Alternatives of plain letters, also inside groups, longest first: leftmost-longest as POSIX has it, for such patterns."""

    def ordered(body: str) -> str:
        return "|".join(sorted(body.split("|"), key=len, reverse=True))

    plain = r"[^\\.\[\](){}*+?^$]*"
    if re.fullmatch(plain, pattern):
        return ordered(pattern)
    return re.sub(rf"(\((?:\?:)?)({plain}\|{plain})\)", lambda m: f"{m[1]}{ordered(m[2])})", pattern)
