"""Every operator over odd tables: nulls in any column, empty and very long texts, repeated rows, ties, no rows, clashing columns."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest

from lodestack.llm import contamination, functions, handwritten, packing, secrets, split, subjects, syntax, tokens

ENTRY = "entry_id long, export_id long, repo_id long, path string, language string, content string, loaded_at timestamp"
EXPORT = "export_id long, source string, domain_label string, split_max_chars int, max_export_bytes long, split_overlap_chars int"
DOCUMENT = "doc_id long, text string, source string"
T = dt.datetime(2026, 1, 1)
BASE = (1, 1, 1, "a.py", "python", 'password = "Hunter2-Hunter2"\n\n\ndef f(x):\n    """Return one of many things here."""\n    return x\n', T)
LONG = "x = 1  # " + "word " * 120_000
TEXTS = ["", "\n", "a", "\r\n\r\n", LONG, "y" * 300_000, "é😀" * 5000, "\0", "(" * 3000, "[" * 50_000 + "]" * 50_000]


def odd_entries(spark):
    nulls = [tuple(None if i == k else v for i, v in enumerate(BASE)) for k in range(len(BASE))]
    texts = [(100 + i, 1, 1, f"t{i}.{s}", None, t, T) for i, (t, s) in enumerate(itertools.product(TEXTS, ("py", "js", "ts", "java", "sh", "json", "yaml", "toml", "css", "md", "")))]
    rows = [BASE, BASE, (*BASE[:6], T + dt.timedelta(days=1)), *nulls, *texts, (None,) * len(BASE)]
    clash = "*, 'c' as lang, 'd' as tokens, 1 as n, 'e' as copy, 2 as chars, 3 as bytes, 4 as kind, 5 as mark, 6 as line_number, 7 as __key, 8 as shape"
    return spark.createDataFrame(rows, ENTRY).selectExpr(*clash.split(", "))


def languages(spark):
    return spark.createDataFrame([("python", "python"), ("py", "python"), ("PY", "python"), ("js", "javascript"), ("ts", "typescript"), ("java", "java"), ("sh", "bash"), ("json", "json"), ("yaml", "yaml"), ("toml", "toml"), ("css", "css"), ("md", "markdown"), (None, "x"), ("z", None)], "alias string, language string")


def exports(spark):
    rows = [(1, "s", None, 50, 400, 10), (1, "s", None, 50, 400, 10), (2, None, "d", None, None, None), (None, "s", "d", 1, 1, 1), (3, "s", "d", None, 100, None)]
    return spark.createDataFrame(rows, EXPORT).selectExpr("*", "1 as content", "2 as chars", "3 as estimated_tokens")


ENTRY_OPERATORS = {
    "find_secrets": lambda e, x, s: secrets.find_secrets(e),
    "secret_lines": lambda e, x, s: secrets.secret_lines(e),
    "mask_secrets": lambda e, x, s: secrets.mask_secrets(e),
    "not_handwritten": lambda e, x, s: handwritten.not_handwritten(e),
    "token_budget": lambda e, x, s: tokens.token_budget(e, languages(s)),
    "bpe_budget": lambda e, x, s: tokens.token_budget(e, languages(s), tokens.bpe_tokens),
    "by_slice": lambda e, x, s: tokens.budget_by_slice(tokens.token_budget(e, languages(s)), x),
    "invalid_entries": lambda e, x, s: syntax.invalid_entries(e, languages(s)),
    "invalid_rates": lambda e, x, s: syntax.invalid_rates(e, languages(s)),
    "split_oversized": lambda e, x, s: split.split_oversized(e, x),
    "documented_functions": lambda e, x, s: functions.documented_functions(e, languages(s)),
    "function_pairs": lambda e, x, s: functions.function_pairs(e, languages(s)),
}


@pytest.mark.parametrize("name", ENTRY_OPERATORS)
def test_entries(spark, name):
    operator = ENTRY_OPERATORS[name]
    rows = [tuple(r) for r in operator(odd_entries(spark), exports(spark), spark).collect()]
    assert rows and len(rows) == len(set(rows))
    plain = spark.createDataFrame([BASE], ENTRY)
    assert {tuple(r) for r in operator(plain, exports(spark), spark).collect()} == {tuple(r) for r in operator(plain.unionByName(plain), exports(spark), spark).collect()}
    nothing = operator(spark.createDataFrame([], ENTRY), spark.createDataFrame([], EXPORT), spark)
    assert nothing.count() == 0 and nothing.columns == operator(plain, exports(spark), spark).columns


def odd_documents(spark):
    words = "the wheat and barley fields were watered before the harvest of the farm " * 3
    rows = [(1, words, "a"), (1, words, "a"), (2, words, None), (None, words, "b"), (3, None, "a"), *[(10 + i, t, "s") for i, t in enumerate(TEXTS)], (None, None, None)]
    return spark.createDataFrame(rows, DOCUMENT).selectExpr("*", "1 as n", "2 as subject", "3 as item_id", "4 as ids", "5 as language", "6 as length")


def items(spark):
    passage = "The wheat -- and BARLEY fields; were watered before the harvest of the farm"
    rows = [(1, passage), (1, passage), (2, passage.upper()), (3, None), (None, passage), (4, ""), (5, "too few words")]
    return spark.createDataFrame(rows, "item_id long, passage string").selectExpr("*", "1 as doc_id", "'x' as text")


def containers(spark):
    rows = [("a", 64, 1), ("a", 64, 1), ("b", 7, None), (None, 5, 1), ("c", None, 1), ("d", 0, 0), ("e", 1, 0)]
    return spark.createDataFrame(rows, "container_kind string, capacity_tokens int, separator_tokens int").selectExpr("*", "1 as n", "2 as container")


def labels(spark):
    return spark.createDataFrame([(1, "FARMING "), (1, "farming"), (2, "none"), (None, "law"), (3, None), (99, "law")], "doc_id long, subject string").selectExpr("*", "1 as ids")


def areas(spark):
    return spark.createDataFrame([("farming", "Wheat, barley and fields of the farm."), ("law", None), (None, "x"), ("sport", "Games and matches.")], "subject string, description string")


DOCUMENT_OPERATORS = {
    "leaked": lambda d, s: contamination.leaked(d, items(s)),
    "pack": lambda d, s: packing.pack(d, containers(s)),
    "fill": lambda d, s: packing.fill(packing.pack(d, containers(s)), containers(s)),
    "assign_subjects": lambda d, s: subjects.assign_subjects(d, labels(s), areas(s)),
    "composition": lambda d, s: subjects.composition(subjects.assign_subjects(d, labels(s), areas(s)), d),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_documents(spark, name):
    operator = DOCUMENT_OPERATORS[name]
    rows = [tuple(r) for r in operator(odd_documents(spark), spark).collect()]
    assert len(rows) == len(set(rows))
    if name not in ("assign_subjects",):
        assert rows
    assert operator(spark.createDataFrame([], DOCUMENT), spark).count() == 0


def test_empty_side_tables(spark):
    d = odd_documents(spark)
    assert contamination.leaked(d, items(spark).where("false")).count() == 0
    assert packing.pack(d, containers(spark).where("false")).count() == 0
    assert subjects.assign_subjects(d, labels(spark).where("false"), areas(spark).where("false")).count() == 0
    subjects.assign_subjects(d, labels(spark).where("false"), areas(spark)).count()
