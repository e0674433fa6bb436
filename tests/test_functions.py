from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestack.functions import languages, paths, text


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_line_definitions(spark):
    cases = [("",), ("a",), ("a\n",), ("a\n\n b\r\nc\rd",), ("\n",), (None,)]
    got = one(spark, cases, "c string", text.line_count(F.col("c")), text.empty_line_count(F.col("c")))
    assert [g[0] for g in got] == [0, 1, 1, 5, 1, None] or [g[0] for g in got][:5] == [0, 1, 1, 5, 1]
    assert [g[1] for g in got][:5] == [0, 0, 0, 1, 1]


def test_tokens_and_heads(spark):
    got = one(spark, [("abcde",), ("",), ("a\nb\nc",), ("a\nb\n",)], "c string", text.tokens_up(F.col("c")), text.tokens_down(F.col("c")), text.head_lines(F.col("c"), 2), text.omitted_lines(F.col("c"), 2))
    assert got == [(2, 1, "abcde", 0), (0, 0, "", 0), (2, 1, "a\nb\n", 1), (1, 1, "a\nb\n", 0)]


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5, 6, 9, 50])
def test_byte_prefix_never_breaks_a_character(spark, most):
    value = "aé€😀zé"
    want = value
    while len(want.encode()) > most:
        want = want[:-1]
    assert one(spark, [(value,)], "c string", text.byte_prefix(F.col("c"), most)) == [(want,)]


def test_limited_keeps_the_limit(spark):
    [(a,), (b,)] = one(spark, [("x" * 100,), ("short",)], "c string", text.limited(F.col("c"), 30, "\n[cut]\n"))
    assert len(a.encode()) <= 30 and a.endswith("\n[cut]\n") and b == "short"
    assert one(spark, [("x" * 100,)], "c string", text.limited(F.col("c"), 3, "notice")) == [("not",)]


def test_fences_and_escapes(spark):
    assert one(spark, [("no",), ("``` and ````",)], "c string", text.fence(F.col("c"))) == [("```",), ("`````",)]
    assert one(spark, [("a<b & 'c'",)], "c string", text.xml_escaped(F.col("c"))) == [("a&lt;b &amp; &apos;c&apos;",)]


def test_languages(spark):
    rows = [("a.PY", "x"), ("run", "#!/usr/bin/env -S python3 -u\n"), ("README", "x"), ("x.unknown", "def f(a):\n    pass\nimport os\n"), (".env", "A"), ("s.txt", "#!/bin/sh\n"), ("e", "")]
    got = [g[0] for g in one(spark, rows, "p string, c string", languages.detected(F.col("p"), F.col("c")))]
    assert got == ["python", "python", "markdown", "python", None, "bash", None]
    assert one(spark, [(None,), ("json",), ("python",)], "l string", languages.display_name(F.col("l"))) == [("Unknown",), ("JSON",), ("Python",)]


def test_path_rules(spark):
    rows = [("src/a.py",), ("./src/a.py",), ("src",), ("srcs/a.py",), ("docs/x/y.md",), ("src/api/z.py",)]
    rule = paths.selected(F.col("p"), ["src"], ["*.md"], ["src/api"])
    assert [g[0] for g in one(spark, rows, "p string", rule)] == [True, True, True, False, True, False]
    assert paths.glob_expression("[!a]?*.p") == "(?s)^[^a]..*\\.p$"
    assert one(spark, [("src/pkg/__init__.py",), ("a-b/c.py",), ("x.py",)], "p string", paths.module_name(F.col("p"))) == [("pkg",), (None,), ("x",)]
    assert one(spark, [("a/b/c",), ("x",)], "p string", paths.ancestors(F.col("p"))) == [(["a", "a/b"],), ([],)]


def test_documentation(spark):
    rows = [("README.md",), ("docs/notes.txt",), ("a/architecture.rst",), ("CHANGELOG",), ("x.py",), ("license",), ("planning/m1.md",)]
    got = one(spark, rows, "p string", paths.is_documentation(F.col("p")), paths.documentation_category(F.col("p")))
    assert [g[0] for g in got] == [True, True, True, True, False, True, True]
    assert got[0][1] == "Primary documentation" and got[2][1] == "Architecture" and got[6][1] == "Tasks and roadmap"
