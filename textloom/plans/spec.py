"""What to search for, where and how."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from textloom.functions.lexing import CONTEXTS, TYPES
from textloom.functions.registry import KINDS, REGISTRY

STRATEGIES = ("literal", "token", "semantic", "fuzzy", "regex")
ANCHORS = ("infix", "word", "prefix", "suffix", "edit")
WILDCARDS = ("ANY", "KEY", "NUM", "OCT", "HEX", "STR", "LIT")


@dataclass(frozen=True)
class SearchSpec:
    """One search.  ``patterns`` are alternatives; no context means all; ``types`` chooses languages."""

    patterns: tuple[str, ...]
    strategy: str = "literal"
    anchor: str = "infix"
    ignore_case: bool = False
    contexts: frozenset[str] = frozenset()
    token_types: frozenset[str] = frozenset()
    strict: bool = False
    tests: str | None = None
    types: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()
    force_type: str | None = None
    invert: bool = False
    max_count: int | None = None
    registry: dict = field(default_factory=lambda: REGISTRY, compare=False)

    def __post_init__(self):
        if isinstance(self.patterns, str):
            object.__setattr__(self, "patterns", (self.patterns,))
        for name in ("contexts", "token_types", "types", "kinds"):
            value = getattr(self, name)
            object.__setattr__(self, name, frozenset([value] if isinstance(value, str) else value))
        object.__setattr__(self, "patterns", tuple(self.patterns))
        for value, among, what in (
            (self.strategy, STRATEGIES, "strategy"),
            (self.anchor, ANCHORS, "anchor"),
            (self.tests, (None, "only", "exclude"), "tests"),
        ):
            if value not in among:
                raise ValueError(f"{what}: {value!r} is none of {among}")
        for values, among, what in ((self.contexts, CONTEXTS, "context"), (self.token_types, TYPES, "token type"), (self.types, self.registry, "file type"), (self.kinds, KINDS, "kind")):
            if extra := set(values) - set(among):
                raise ValueError(f"{what}: {sorted(extra)} is none of {sorted(among)}")
        if self.tests and self.strategy != "semantic":
            raise ValueError("tests asks for the semantic strategy")
        if "bracket" in self.token_types:
            raise ValueError("brackets can't be selected")
        if self.strategy == "semantic" and self.contexts and "code" not in self.contexts:
            raise ValueError("a semantic pattern is code: its context must be shown")
        if self.max_count is not None and self.max_count < 0:
            raise ValueError("max_count is not negative")
        if self.strategy == "regex":
            for p in self.patterns:
                re.compile(re.sub(r"\\[pP]\{\w+\}", "x", p).replace("*+", "*"))
        if self.strategy != "semantic" and any("\n" in p for p in self.patterns):
            raise ValueError("a pattern lies in one line")


def chosen_types(options: list[str], default=()) -> frozenset[str]:
    """``T`` replaces the default types, ``+T`` adds to them if a plain one is given, ``-T`` takes away."""
    plain = {t for t in options if t[0] not in "+-"}
    more, less = ({t[1:] for t in options if t[0] == sign} for sign in "+-")
    if not plain and not default and less:
        return frozenset(REGISTRY) - less
    return frozenset(((plain | more) if plain else set(default)) - less)
