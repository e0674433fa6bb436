from __future__ import annotations

import time

import pytest

from lodestack.llm import functions

LANGUAGES = [("py", "python"), ("js", "javascript"), ("ts", "typescript"), ("java", "java"), ("sh", "bash")]
SOURCES = {
    "a.py": ('"""Module text of several words here."""\n\n\n@deco(1)\ndef one(a, b=(1, 2)) -> int:\n    """Gives back the first of both."""\n    return a\n\n\nclass K:\n    async def two(self):\n        r\'\'\'\n        Walks over all the keys.\n        :param x: none\n        \'\'\'\n        def three(): "Inner text with four words."\n        return 1\n\n    def four(self):\n        # a remark of many words here\n        "TODO: fill four later."\n\n    def five(self):\n        x = "not the docstring of this one"\n',
        {(5, "one", 7), (11, "two", 17), (16, "three", 16)}),
    "a.js": ("/** Opens the file and reads all of it. */\nexport async function one(a) {\n  if (a) { return /[({]/g }\n}\n\n// Counts the rows of the\n// whole table at once.\nconst two = (x) => {\n  return `}${x}`;\n};\n\n/** Gone is the link to it. */\n\nfunction three() {}\n\nclass K {\n  /**\n   * @param a the first of four words\n   */\n  four(a) { return a }\n\n  // Makes the fifth thing really work.\n  static get five() { return { a: 1 } }\n}\nconst six = 1;\n",
        {(2, "one", 4), (8, "two", 10), (23, "five", 23)}),
    "a.ts": ("/* Holds what the others\n   do not hold. */\n@Component({ a: 1 })\nclass K {\n  /** Reads the whole list again. */\n  @Input()\n  private read<T>(a: Map<string, T[]>): T | null {\n    return null;\n  }\n}\n/** Turns one thing into another. */\nexport const f = async (a: { b: string }): Promise<void> => {\n};\n",
        {(7, "read", 9), (12, "f", 13)}),
    "A.java": ("package a;\n/** The class has no function text. */\npublic class A {\n    // ---- one ----\n    int one() { return 1; }\n\n    /** Sums up all of the rows. */\n    @Override\n    @Deprecated\n    public static <T> List<T> two(final T a)\n        throws X {\n        char c = '{';\n        return null;\n    }\n}\n",
        {(10, "two", 14)}),
    "a.sh": ("#!/bin/bash\n# Prints all arguments one by one.\nfunction show {\n    cat <<'E'\nhere's { it\nE\n    echo \"}\"\n}\n\n#\nnone () {\n    :\n}\n# Stops the service after some time.\nstop() { :; }\n",
        {(3, "show", 8), (15, "stop", 15)}),
}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, p, None, s) for i, (p, (s, _)) in enumerate(SOURCES.items())] + [(99, "bad.py", None, 'def f(:\n    """Text of more than four words."""\n')]
    return spark.createDataFrame(rows + rows, "entry_id long, path string, language string, content string"), spark.createDataFrame(LANGUAGES, "alias string, language string")


def test_found(entries):
    got = {tuple(r) for r in functions.documented_functions(*entries).collect()}
    assert got == {(i, line, name) for i, (_, found) in enumerate(SOURCES.values()) for line, name, _ in found}


def test_pairs_hold_the_code(entries):
    for r in functions.function_pairs(*entries).collect():
        source, found = list(SOURCES.values())[r.entry_id]
        assert (r.line_start, r.name, r.line_end) in found
        assert r.code == "\n".join(source.split("\n")[r.line_start - 1 : r.line_end]) and r.doc


def test_trivial_documentation(spark):
    docs = [("Compute total amount", "compute", 2), ("TODO fixme xxx tbd", "f", 0), ("Read file name read_file again here", "readFile", 3), ("one two three four", "f", 4), ("@a b c d e\n:x y z\nreal words are four", "f", 4)]
    from pyspark.sql import functions as F

    got = [r.n for r in spark.createDataFrame([d[:2] for d in docs], "doc string, name string").select(functions.real_words(F.col("doc"), F.col("name")).alias("n")).collect()]
    assert got == [n for *_, n in docs]


@pytest.mark.parametrize("depth", [1, 4, 20])
def test_argument_lists_may_be_nested(depth):
    value = "f(" * depth + "1" + ")" * depth
    for language, text in (("javascript", f"function one(a = {value}) {{\n}}\nconst two = (b = {value}) => {{\n}}\nclass K {{\n  three(c = {value}) {{ }}\n}}\n"), ("java", f"class A {{\n    @P({value})\n    int one(int a) {{ return 1; }}\n}}\n")):
        names = [t[4] for t in functions.tokens(language, text) if t[1] == functions.FUNCTION]
        assert names == (["one", "two", "three"] if language == "javascript" else ["one"])


def test_comments_without_an_end_take_no_time():
    from lodestack.llm import handwritten

    text = "/* " * 60_000
    began = time.perf_counter()
    assert not any(functions.tokens(language, text) for language in ("javascript", "typescript", "java"))
    assert len(handwritten.tokenized("a.js", text, handwritten.both_masks())[0]) == 120_000
    assert time.perf_counter() - began < 20
