"""Match strategies: arrays of chunks found in a line or in a text's tokens."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexing as L
from textloom.functions.registry import Language
from textloom.plans.spec import WILDCARDS, SearchSpec


CHUNKS = "array<struct<type:string,token:string,col:int>>"


def _chunk(kind: Column, token: Column, col: Column) -> Column:
    return F.struct(kind.alias("type"), token.alias("token"), col.cast("int").alias("col"))


def _any(tests) -> Column:
    tests = list(tests)
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def occurrences(line: Column, pattern: str) -> Column:
    """Non-overlapping places of a substring; none of an empty one."""
    if not pattern:
        return F.array().cast(CHUNKS)
    size = len(pattern)

    def found(parts: Column) -> Column:
        ends = F.slice(L.places(parts), F.lit(2), F.size(parts) - 1)
        return F.transform(ends, lambda end, i: _chunk(F.lit("text"), F.lit(pattern), end + i * size))

    return L.bound(F.split(line, L.quote(pattern), -1), found)


def anchored(line: Column, pattern: str, anchor: str, lang: Language | None) -> Column:
    """Places where a word of the line is, starts or ends with the pattern, or is within its edit distance."""
    p, size = F.lit(pattern), len(pattern)
    test = lambda w: _anchor_test(w, pattern, anchor)
    place = (lambda c: c["col"] + F.length(c["token"]) - size) if anchor == "suffix" else (lambda c: c["col"])
    token = (lambda c: c["token"]) if anchor == "edit" else (lambda c: p)

    def found(words: Column) -> Column:
        fits = F.filter(L.placed(words), lambda c: test(c["token"]) & ~L.is_space(c["token"]))
        return F.when(F.exists(words, test), F.transform(fits, lambda c: _chunk(F.lit("text"), token(c), place(c)))).otherwise(F.array().cast(CHUNKS))

    return L.bound(L.words(line, lang), found)


def regex_matches(line: Column, pattern: str) -> Column:
    """All matches in a line, leftmost-longest for plain alternatives; columns are null where a match may be empty.

    Where the pattern has groups, each group that took part is a chunk too, behind the match; its column is not known.
    """
    groups = regex.compile(regex.sub(r"\(\?i\)", "", pattern), regex.V1).groups
    pattern = f"(?m){L.posix_longest(pattern)}"
    parts = F.split(line, pattern, -1)

    def placed(found: Column) -> Column:
        gaps = F.slice(L.places(parts), F.lit(2), F.size(found))
        widths = F.slice(L.places(found), F.lit(1), F.size(found))
        cols = F.when(F.size(parts) == F.size(found) + 1, F.zip_with(gaps, widths, lambda g, w: g + w - 1))
        cols = F.coalesce(cols, F.transform(found, lambda t: F.lit(None).cast("int")))
        whole = F.zip_with(found, cols, lambda t, c: _chunk(F.lit("text"), t, c))
        if not groups:
            return whole
        each = [F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(g)), lambda t: _chunk(F.lit("group"), t, F.lit(None).cast("int"))) for g in range(1, groups + 1)]
        inner = lambda i: F.filter(F.array(*(F.element_at(e, i) for e in each)), lambda c: c["token"] != "")
        rows = lambda w: F.transform(w, lambda c, i: F.concat(F.array(c).cast(CHUNKS), inner(i + 1).cast(CHUNKS)))
        return L.bound(whole, lambda w: F.flatten(rows(w)))

    return L.bound(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), placed)


def line_chunks(line: Column, spec: SearchSpec, lang: Language | None) -> Column:
    """Chunks of all patterns in a visible line, by the literal, fuzzy or regex strategy."""
    patterns = [p.lower() if spec.ignore_case and spec.strategy != "regex" else p for p in spec.patterns]
    if spec.strategy == "regex":
        found = [regex_matches(line, f"(?i){p}" if spec.ignore_case else p) for p in patterns]
    elif spec.strategy == "fuzzy" or spec.anchor != "infix":
        found = [anchored(line, p, "edit" if spec.strategy == "fuzzy" else spec.anchor, lang) for p in patterns]
    else:
        found = [occurrences(line, p) for p in patterns]
    return found[0] if len(found) == 1 else F.concat(*found)


def _anchor_test(text: Column, pattern: str, anchor: str) -> Column:
    p = F.lit(pattern)
    return {"infix": text.contains(p), "word": text == p, "prefix": text.startswith(p), "suffix": text.endswith(p), "edit": L.fuzzy_equal(text, pattern)}[anchor]


def _folded(text: Column, spec: SearchSpec) -> Column:
    return F.lower(text) if spec.ignore_case else text


def _token_chunk(t: Column) -> Column:
    names = F.create_map(*(x for name, letter in L.TYPES.items() for x in (F.lit(letter), F.lit(name))))
    return _chunk(names[t["type"]], t["text"], t["col"])


def token_hits(tokens: Column, spec: SearchSpec, lang: Language) -> Column:
    """Flags of the tokens of the chosen types (all but brackets if none) that a pattern fits."""
    letters = [L.TYPES[t] for t in spec.token_types or set(L.TYPES) - {"bracket"}]
    patterns = [p.lower() if spec.ignore_case else p for p in spec.patterns]

    def fits(t: Column) -> Column:
        kind = L.type_of(t, lang)
        bare = F.when(kind == "s", L.unquoted(t)).otherwise(t)
        test = kind.isin(*sorted(letters)) & _any(_anchor_test(_folded(bare, spec), p, spec.anchor) for p in patterns)
        if spec.anchor == "edit":
            return test
        return _any(_folded(t, spec).contains(F.lit(p)) for p in patterns) & test  # few tokens get as far as their type

    return F.transform(tokens, fits)


def atoms(pattern: str, lang: Language, strict: bool = False) -> list[tuple[str, str, str]]:
    """A semantic pattern as (atom, type letter, text); wildcards and placeholders are words of any language."""
    words = rf"(?<![\w$])(?:{'|'.join(WILDCARDS)})(?![\w$])|(?<![\w$])[_$][0-9]*(?![\w$])"
    lexed = regex.compile(f"(?P<any>{words})|(?P<token>{L.token_regex(lang, strict).removeprefix('(?s)').replace(chr(92) + 'z', chr(92) + 'Z')})", regex.S | regex.V1)
    comments, literals = [a for a, _ in lang.comments], [a for a, *_ in L.literal_patterns(lang)]
    found = []
    for m in lexed.finditer(pattern):
        text = m.group()
        if m["any"]:
            kind = "wildcard" if text in WILDCARDS and text not in lang.keywords else "placeholder" if text not in WILDCARDS else "exact"
            found.append((kind, "k" if kind == "exact" else "", text))
        elif regex.fullmatch(rf"[{L.SPACE}]+", text) or any(text.startswith(c) for c in comments):
            continue
        elif any(text.startswith(a) and len(text) > 1 for a in literals):
            found.append(("exact", "s", text[1:-1].strip() if text[0] == text[-1] else text))
        elif regex.match(r"\.?[0-9]", text):
            found.append(("exact", "d", text))
        elif regex.fullmatch(rf"[{L.BRACKETS}]", text):
            found.append(("exact", "b", text))
        elif regex.match(r"[\p{L}_$]", text):
            letter = "n" if text in lang.natives else "k" if text in lang.keywords else "i"
            found.append(("exact", letter, text.lstrip("_$") if letter == "i" else text))
        else:
            found.append(("exact", "o", text))
    return found


def _atom_test(t: Column, atom: tuple[str, str, str], spec: SearchSpec, lang: Language) -> Column:
    kind, letter, text = atom
    value, typed = _folded(t, spec), L.type_of(t, lang)
    text = text.lower() if spec.ignore_case and kind == "exact" else text
    if kind == "placeholder":
        return typed == "i"
    if kind == "wildcard":
        number = typed == "d"
        return {
            "ANY": F.lit(True),
            "KEY": typed == "k",
            "NUM": number,
            "OCT": t.startswith("0d") & number,
            "HEX": t.startswith("0x") & number,
            "STR": typed == "s",
            "LIT": typed == "s",
        }[text]
    if letter == "i":
        return _anchor_test(value, text, spec.anchor) & (typed == "i")
    if letter == "s":
        return (typed == "s") & _anchor_test(L.trimmed(L.unquoted(value)), text, spec.anchor)
    return (value == F.lit(text)) & (typed == letter)


def _windows(tokens: Column, wanted: list[tuple[str, str, str]], spec: SearchSpec, lang: Language) -> Column:
    """Flags of the tokens of the windows that the atoms fit; equal placeholders _0 to _9 stand for equal words."""
    k, places = len(wanted), {}
    for j, (kind, _, text) in enumerate(wanted):
        if kind == "placeholder" and len(text) == 2 and text[0] == "_":
            places.setdefault(text, []).append(j)
    # what few tokens pass is tested first, equal words before types
    order = [j for j in range(k) if wanted[j][2] != "ANY" or wanted[j][0] != "wildcard"]

    def fits(i: Column) -> Column:
        of_kind = lambda kind: [_atom_test(F.element_at(tokens, i + j), wanted[j], spec, lang) for j in order if wanted[j][0] == kind]
        equal = [F.element_at(tokens, i + js[0]) == F.element_at(tokens, i + j) for js in places.values() for j in js[1:]]
        tests = of_kind("exact") + equal + of_kind("wildcard") + of_kind("placeholder")
        return reduce(Column.__and__, tests) if tests else F.lit(True)

    starts = F.transform(tokens, lambda t, i: F.when(i + k <= F.size(tokens), fits(i + 1)).otherwise(F.lit(False)))
    return L.bound(starts, lambda s: F.transform(s, lambda here, i: reduce(Column.__or__, [here, *(F.coalesce(F.get(s, i - j), F.lit(False)) for j in range(1, k))])))


def semantic_hits(tokens: Column, spec: SearchSpec, lang: Language) -> Column:
    """Flags of the tokens of all windows that a pattern's atoms fit, overlapping windows included."""
    flags = [_windows(tokens, a, spec, lang) for p in spec.patterns if (a := atoms(p, lang, spec.strict))]
    return reduce(lambda a, b: F.zip_with(a, b, Column.__or__), flags) if flags else F.array().cast("array<boolean>")


def required(spec: SearchSpec, lang: Language) -> list[list[str]]:
    """For each semantic pattern, texts that a file must contain; none with edit distance, which needs no exact word."""
    if spec.anchor == "edit":
        return [[] for _ in spec.patterns]
    return [[text for kind, _, text in atoms(p, lang, spec.strict) if kind == "exact" and text] for p in spec.patterns]
