"""Source files that can't be read as their language (problem 5).

Every file is parsed by the grammar of its language and ranked by the tokens typical of each language. One that fails, or whose
tokens speak for another language, is parsed by the other grammars in the order of the ranking: a success tells a wrong
extension, failure everywhere a damaged file.
"""

from __future__ import annotations

import _symtable
import io
import json
import re
import sys
import tokenize
import tomllib
import warnings
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.common import with_language
from lodestack.llm.grammar import css, java, script, shell
from lodestack.llm.grammar.brackets import Invalid


_SCOPE_WORDS = ("def", "async def", "class", "return", "for", "while", "else", "break", "continue")
_SCOPE = re.compile(r"(def|async def|class|return|for|while|else|break|continue)\b")
#: Words at which the compiler may find what parser and symbol table let pass.
_COMPILER_ONLY = ("await", "async for", "async with", "yield", "nonlocal", "__future__", "__debug__", "except:", "except :", ", *")


def _jumps_inside(text: str) -> bool:
    """Whether every line that begins with ``return``, ``break`` or ``continue`` surely lies within a function or a loop."""
    stack: list[tuple[int, str]] = []
    for line in text.split("\n"):
        bare = line.lstrip(" \t")
        if not bare.startswith(_SCOPE_WORDS) or not (m := _SCOPE.match(bare)):
            continue
        width, word = len(line[: len(line) - len(bare)].expandtabs(8)), m[1]
        while stack and stack[-1][0] >= width:
            stack.pop()
        if word == "return":
            if next((w for _, w in reversed(stack) if w in ("def", "async def", "class")), "class") == "class":
                return False
        elif word in ("break", "continue"):
            if next((w for _, w in reversed(stack) if w != "else"), "class") not in ("for", "while"):
                return False
        else:
            stack.append((width, word))
    return True


def _python(text: str) -> None:
    """The parser and the symbol table reject most; the compiler is asked only about what it alone would reject."""
    if any(word in text for word in _COMPILER_ONLY) or not _jumps_inside(text):
        compile(text, "entry", "exec", dont_inherit=True)
    else:
        _symtable.symtable(text, "entry", "exec")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _json(text: str) -> None:
    json.loads(text, parse_constant=_no_constant)


def _yaml(text: str) -> None:
    import yaml

    anchors: set[str] = set()
    for event in yaml.parse(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)):  # events, not nodes, so that no nesting is too deep
        if isinstance(event, yaml.DocumentStartEvent):
            anchors.clear()
        elif isinstance(event, yaml.AliasEvent):
            if event.anchor not in anchors:
                raise Invalid(f"unknown alias {event.anchor}")
        elif (anchor := getattr(event, "anchor", None)) is not None:
            anchors.add(anchor)


def _html(text: str) -> None:
    if not re.match(r"\s*(?:<!doctype html|<html|<\?xml)", text, re.IGNORECASE) or not re.search(r"</\w+>\s*\Z", text):
        raise Invalid("no page")


def _ini(text: str) -> None:
    if not re.search(r"(?m)^\[[^\]\n]+\]\s*$", text) or re.search(r"(?m)^(?!\s*[;#\[])(?!\s)[^=:\n]+$", text):
        raise Invalid("no sections")


GRAMMARS: dict[str, Callable[[str], None]] = {
    "python": _python, "json": _json, "toml": tomllib.loads, "yaml": _yaml, "javascript": script.javascript, "typescript": script.typescript,
    "java": java.java, "bash": shell.bash, "css": css.css,
}
#: Languages whose files never count, though a file of another language may be one of them.
FOREIGN = {**GRAMMARS, "html": _html, "ini": _ini}

#: Tokens that speak for a language: (weight, expression).
TOKENS: dict[str, list[tuple[int, re.Pattern]]] = {
    name: [(weight, re.compile(pattern, re.MULTILINE)) for weight, pattern in rules]
    for name, rules in {
        "python": [(4, r"^\s*(?:async )?(?:def|class) \w+.*:\s*(?:#.*)?$"), (2, r"^(?:import|from) \w[\w.]*(?: import .*)?$"), (1, r"\b(?:self|None|elif|True|False)\b"), (2, r'^\s*"""')],
        "javascript": [(3, r"\bfunction\b|=>"), (3, r"^\s*(?:export |const |let |var )"), (3, r"[!=]=="), (4, r"^import .* from [\"']")],
        "typescript": [(3, r"^\s*(?:export )?(?:interface|type|enum) \w+"), (4, r"\w\??: (?:any|string|number|boolean|unknown|void)\b"), (3, r"=>"), (2, r"^\s*(?:export |const |let |var )")],
        "java": [(6, r"^package [\w.]+;"), (4, r"^import [\w.]+(?:\.\*)?;"), (3, r"\b(?:public|private|protected) (?:static |final )*\w+")],
        "bash": [(8, r"^#!.*\b(?:ba|z|k|da)?sh\b"), (3, r"^\s*(?:fi|done|esac|then|do)\s*$|;\s*(?:then|do)\s*$"), (2, r'"?\$\{?[\w@#?*]'), (4, r"^set -\w"), (3, r"^(?:function )?\w+ ?\(\) ?\{")],
        "json": [(6, r'\A\s*[\[{]'), (2, r'^\s*"[^"\n]*"\s*:'), (2, r'^\s*[\]}],?\s*$')],
        "yaml": [(2, r"^\s*[\w-]+:(?:\s|$)"), (2, r"^\s*- \S")],
        "toml": [(5, r"^\[+[\w.\"-]+\]+\s*$"), (2, r"^[\w.-]+ = (?:[\"\[\d]|true|false)")],
        "ini": [(5, r"^\[[^\]\n]+\]\s*$"), (2, r"^[\w.-]+ ?= ?[^\"\[]")],
        "css": [(4, r"^[^\n{}=();]+\{\s*$"), (2, r"^\s*[\w-]+:\s*[^;{}()\n]+;\s*$")],
        "html": [(20, r"\A\s*<(?:!doctype|html)"), (2, r"</\w+>")],
    }.items()
}
#: Words (runs without white space) and parts of text that speak for a language, for the first ranking: weight -> tokens.
WORDS: dict[str, dict[int, str]] = {
    "python": {4: "def elif except try: else: finally:", 1: "None True False class import from not lambda pass raise with return"},
    "javascript": {3: "function const let var => === !== export", 1: "import class async return new null; }); { } this. if"},
    "typescript": {3: "function const let var => === !== export interface type enum", 1: "import class async return new null; }); { } this. if"},
    "java": {6: "package", 3: "public private protected final @Override throws", 1: "static void int String import class return new { }"},
    "bash": {4: "fi done esac then ;;", 2: "echo [ [[ local set", 1: "if do export"},
    "json": {2: "], ["},
    "yaml": {2: "-"},
    "toml": {1: "="},
    "ini": {1: "="},
}
PARTS: dict[str, dict[int, tuple[str, ...]]] = {
    "bash": {8: ("#!/bin/", "#!/usr/bin/env bash"), 1: ("$",)},
    "json": {2: ('":',)},
    "yaml": {1: (": ", ":\n")},
    "toml": {4: ("\n[",)},
    "ini": {4: ("\n[",), 1: ("\n;",)},
    "css": {1: (";\n", "px;")},
    "html": {2: ("</",), 20: ("<!doctype html", "<!DOCTYPE html", "<html")},
}
_BY_WORD: dict[str, list[tuple[str, int]]] = {}
for _language, _weights in WORDS.items():
    for _weight, _tokens in _weights.items():
        for _token in _tokens.split():
            _BY_WORD.setdefault(_token, []).append((_language, _weight))
#: A language comes into question for a readable text from this part of the weight of the text's own language on.
RIVAL = 1
_SAME = {frozenset(("javascript", "typescript")), frozenset(("json", "yaml")), frozenset(("toml", "ini"))}


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b))')


def deep_json(text: str) -> None:
    """Standard JSON of any depth, without recursion."""
    stack, state, at = [], "value", 0  # states: value, first (a value or the end of a list), key, first key, colon, end
    text = text.rstrip(" \t\n\r")
    while at < len(text):
        m = _JSON_TOKEN.match(text, at)
        if not m:
            raise Invalid(f"unexpected text at {at}")
        at = m.end()
        sign = m[1]
        if sign in ("{", "[") and state in ("value", "first"):
            stack.append(sign)
            state = "first key" if sign == "{" else "first"
        elif sign is None and state in ("value", "first"):
            state = "end"
        elif m[2] and state in ("key", "first key"):
            state = "colon"
        elif sign == ":" and state == "colon":
            state = "value"
        elif sign == "," and state == "end" and stack:
            state = "key" if stack[-1] == "{" else "value"
        elif (sign == "}" and state in ("end", "first key") and stack and stack[-1] == "{") or (sign == "]" and state in ("end", "first") and stack and stack[-1] == "["):
            stack.pop()
            state = "end"
        else:
            raise Invalid(f"unexpected {m.group().strip()} at {at}")
    if stack or state != "end":
        raise Invalid("unexpected end")


def deep_python(text: str) -> None:
    """Where the depth of the compiler's own stack ends, tokens, indents and brackets decide."""
    pairs, stack = {")": "(", "]": "[", "}": "{"}, []
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        if token.type == tokenize.OP and token.string in "([{":
            stack.append(token.string)
        elif token.type == tokenize.OP and token.string in pairs and (not stack or stack.pop() != pairs[token.string]):
            raise Invalid(f"unmatched {token.string} in line {token.start[0]}")
    if stack:
        raise Invalid(f"{stack[-1]} was never closed")


def parses_deep(language: str, text: str) -> None:
    """Reads a text that is nested deeper than the parser goes. Parsers in Python may go as deep as the text is long."""
    if language in ("json", "python"):
        return deep_json(text) if language == "json" else deep_python(text)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(before + 40 * len(text))
    try:
        return FOREIGN[language](text)
    finally:
        sys.setrecursionlimit(before)


def parses(language: str, text: str) -> str | None:
    """Null if ``text`` is valid in ``language``, else what is wrong. No depth of nesting is too deep."""
    try:
        try:
            FOREIGN[language](text)
        except (RecursionError, MemoryError):
            parses_deep(language, text)
    except (RecursionError, MemoryError):
        raise  # this machine's limit, not a fault of the text
    except Exception as error:
        return str(error) or type(error).__name__
    return None


def weighed(text: str) -> dict[str, int]:
    """The first ranking, of every text: the weight of each language's words and parts."""
    counts = Counter(text.split())
    out: dict[str, int] = dict.fromkeys(FOREIGN, 0)
    for word, weights in _BY_WORD.items():
        if n := counts.get(word):
            for language, weight in weights:
                out[language] += weight * n
    for language, weights in PARTS.items():
        for weight, parts in weights.items():
            for part in parts:
                out[language] += weight * text.count(part)
    return out


def ranked(text: str) -> list[tuple[float, str]]:
    """The languages by the weight of their tokens, the likeliest first; ties by name."""
    scores = [(sum(weight * sum(1 for _ in pattern.finditer(text)) for weight, pattern in rules), name) for name, rules in TOKENS.items()]
    return sorted(((s, n) for s, n in scores if s), key=lambda x: (-x[0], x[1]))


def judge(language: str, text: str) -> tuple[str, str, str | None] | None:
    """``(kind, message, language that it is)`` of a text that isn't valid in ``language``; null for a valid one.

    Every text is ranked by its words. If another language comes into question, or its own grammar rejects it, the finer
    ranking gives the order in which the other grammars are tried; a text that its own grammar accepts is only another
    language's if that one leads in the finer ranking, too.
    """
    message = parses(language, text)
    if message is None:
        weight = weighed(text)
        own = max(weight[language], 1)
        if not any(w > RIVAL * own for other, w in weight.items() if other != language and frozenset((language, other)) not in _SAME):
            return None
    order = ranked(text)
    mine = next((s for s, n in order if n == language), 0)
    for score, other in order:
        if other == language or (message is None and (score < 4 or frozenset((language, other)) in _SAME or score <= mine)):
            continue
        if parses(other, text) is None:
            return "other language", message or f"reads as {other}", other
    return None if message is None else ("damaged", message, None)


FOUND = "entry_id long, repo_id string, lang string, kind string, message string, parsed_as string"


def _judge(batches: Iterator[pd.DataFrame], every: bool) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore")  # those of parsed files
    for batch in batches:
        out = []
        for entry, repo, language, text in zip(batch["entry_id"], batch["repo_id"], batch["lang"], batch["content"], strict=True):
            if (verdict := judge(language, text)) or every:
                out.append((entry, repo, language, *(verdict or (None, None, None))))
        yield pd.DataFrame(out, columns=["entry_id", "repo_id", "lang", "kind", "message", "parsed_as"])


def judged_entries(entries: DataFrame, languages: DataFrame, every: bool = True) -> DataFrame:
    """``entry_id, repo_id, lang, kind, message, parsed_as`` of the entries that can be parsed, or of the invalid ones among them; ``kind`` is null for valid ones.

    Entries without id or content, of unknown languages or of languages without a grammar (Markdown, HTML, INI, text) never
    count; an empty text is invalid only as JSON. Repeated rows of one entry_id are one entry.
    """
    texts = with_language(entries.where("entry_id is not null and content is not null").select("entry_id", F.col("repo_id").cast("string").alias("repo_id"), "path", "language", "content"), languages)
    known = texts.where(F.col("lang").isin(*GRAMMARS)).select("entry_id", "repo_id", "lang", "content")
    # as text, the ids of repositories survive a null among them
    return known.mapInPandas(lambda batches: _judge(batches, every), FOUND).withColumn("repo_id", F.col("repo_id").cast("long")).dropDuplicates(["entry_id"])


def invalid_entries(entries: DataFrame, languages: DataFrame) -> DataFrame:
    """The rows of ``judged_entries`` whose content isn't valid in their language."""
    return judged_entries(entries, languages, every=False)


def invalid_rates(entries: DataFrame, languages: DataFrame) -> DataFrame:
    """``repo_id, language, n_entries, n_invalid, rate`` over the entries that could be parsed; the texts are read once."""
    totals = judged_entries(entries, languages).groupBy("repo_id", F.col("lang").alias("language")).agg(F.count("*").alias("n_entries"), F.count("kind").alias("n_invalid"))
    return totals.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_entries"), 6))
