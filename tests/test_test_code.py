"""The examples' markers: full counts are checked, in both lexings."""

import re

import pytest

from textloom import SearchSpec, search
from textloom.operators.examples import EXAMPLES
from textloom.operators.test_code import RULES

@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tests", ["only", "exclude"])
def test_markers(spark, tests, strict):
    files = spark.createDataFrame(list(EXAMPLES.items()), "path string, content string").selectExpr("path", "path AS file_type", "content")
    found = {}
    for r in search(files, SearchSpec("mk_", strategy="semantic", tests=tests, strict=strict)).collect():
        found.setdefault(r.path, []).extend(c.token for c in r.chunks)
    for name, text in EXAMPLES.items():
        kind = "prod" if tests == "exclude" or name == "Bash" else "test"
        want = re.findall(rf"mk_{kind}_\d+", text)
        assert sorted(found.get(name, [])) == sorted(want), name


def test_every_rule_has_an_example():
    assert set(RULES) <= set(EXAMPLES)
