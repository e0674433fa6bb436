"""Functions and methods with their documentation (problem 7).

A lexer per language turns a file into structural tokens: comments, annotations, function names, opening and closing
brackets of their bodies (in Python the indents), docstrings. They become rows; windows over them do the rest: runs of
comment lines are islands, lags attach the comment that ends directly above a function and lies as deep, and the cumulative
depth delimits its body. Brackets of other blocks come in pairs, so that depths and ends are the same without them.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import with_language
from lodestack.llm.syntax import judge

LANGUAGES = ("python", "javascript", "typescript", "java", "bash")
COMMENT, LINE_COMMENT, ANNOTATION, FUNCTION, OPEN, CLOSE, DOCSTRING = "c", "l", "a", "f", "{", "}", "s"

#: Brackets within an argument list may be nested so deep, which no source written or made comes near to.
NESTED = 24
_ARGS = reduce(lambda inner, _: rf"\((?:[^()]++|{inner})*+\)", range(NESTED), r"\([^()]*+\)")
_RX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_SCRIPT_SKIP = re.compile(
    rf"(?P<c>//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*))|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`|(?P<k>(?:[=(,:\[!&|?{{}};+\-*%~^<>]|\b(?:return|typeof|case))\s*){_RX}"
)
_JAVA_SKIP = re.compile(r"(?P<c>//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*))|\"{3}[\s\S]*?\"{3}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'")
_BASH_SKIP = re.compile(r"(?P<c>(?<![^\s;|&()])#[^\n]*)|(?<!<)<<-?[ \t]*([\"']?)(\w+)\2[^\n]*\n(?:[\s\S]*?\n)?[ \t]*\3(?=\r?\n|\Z)|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\$\{[^}]*\}|\\.")
_PYTHON_SKIP = re.compile(r"[#\"'](?:(?<=#)[^\n]*|(?<=\")(?:\"\"(?:[^\\]|\\[\s\S])*?\"{3}|(?:[^\"\\\n]|\\[\s\S])*\")|(?<=')(?:''(?:[^\\]|\\[\s\S])*?'{3}|(?:[^'\\\n]|\\[\s\S])*'))")  # begins with a set of characters, for which it is searched fast
_NOT_NAMES = "if|for|while|switch|catch|function|return|new|else|do|try|throw|await|typeof|with|super|synchronized|case|assert|yield|class|instanceof"
_SCRIPT_HEAD = re.compile(
    rf"^[ \t]*(?=[\w$#*])(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function\b\s*\*?\s*(?P<f>[\w$]+)\s*(?:<[^\n(]*>\s*)?\("
    rf"|(?:export[ \t]+)?const[ \t]+(?P<a>[\w$]+)\s*(?::[^=\n]+(?:=>[^=\n]+)?)?=\s*(?:async\b\s*)?(?:function\b\s*\*?\s*[\w$]*\s*{_ARGS}[^{{;=]*\{{|(?:<[^\n(]*>\s*)?(?:{_ARGS}|[\w$]+)\s*(?::[^={{;]+)?=>\s*\{{)"
    rf"|(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract)[ \t]+)*(?:\*[ \t]*)?(?=\#?[\w$]+[ \t]*[<(])(?!(?:{_NOT_NAMES})\b)(?P<m>\#?[\w$]+)[ \t]*(?:<[^\n(]*>[ \t]*)?{_ARGS}\s*(?::[^={{;]+)?\{{)",
    re.MULTILINE,
)
_AFTER_NAME = re.compile(_ARGS + r"\s*(?::\s*(?:\{[^{}]*\}|[^{};])*)?\{")
_JAVA_HEAD = re.compile(
    rf"^[ \t]*(?=[\w$@<])(?:@[\w.]+(?:{_ARGS})?[ \t]+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^\n(]*>\s*)?(?!(?:{_NOT_NAMES})\b)[\w$.]+(?:<[^;(){{}}=]*>)?(?:\[\])*\s+(?!(?:{_NOT_NAMES})\b)(?P<m>[\w$]+)\s*{_ARGS}\s*(?:throws\s+[\w$.,\s]+)?[{{;]",
    re.MULTILINE,
)
_BASH_HEAD = re.compile(r"^[ \t]*(?:function[ \t]+(?P<f>[^\s(){};|&<>]+)(?:[ \t]*\([ \t]*\))?|(?P<m>[^\s(){};|&<>=]+)[ \t]*\([ \t]*\))\s*(?=[{(])", re.MULTILINE)
_PYTHON_HEAD = re.compile(r"def[ \t]+(?P<f>\w+)")
_PYTHON_BEFORE = re.compile(r"[ \t]*(?:async[ \t]+)?\Z")
_PYTHON_DEFINES = re.compile(r"(?:async[ \t]+)?def[ \t]+\w")
_PYTHON_HEADER = re.compile(r"\s*\((?:[^()\[\]{}:]|\[[^()\[\]{}]*\]|:)*\)\s*(?:->[^:\n()\[\]{}]*(?:\[[^()\[\]{}]*\])?[^:\n()\[\]{}]*)?:")
_NOTE = re.compile(rf"^[ \t]*@[A-Za-z_][\w.]*(?:{_ARGS})?[ \t]*\r?$", re.MULTILINE)
_HEADS = {"javascript": _SCRIPT_HEAD, "typescript": _SCRIPT_HEAD, "java": _JAVA_HEAD, "bash": _BASH_HEAD}
_SKIPS = {"javascript": _SCRIPT_SKIP, "typescript": _SCRIPT_SKIP, "java": _JAVA_SKIP, "bash": _BASH_SKIP, "python": _PYTHON_SKIP}
_BRACE = re.compile(r"[{}]")
_WORDS = re.compile(r"[^\W_]+")
_DOC = re.compile(r"(?:\s|#[^\n]*\n|\\\n)*((?:[rRuU]?(?:\"{3}(?:[^\\]|\\[\s\S])*?\"{3}|'{3}(?:[^\\]|\\[\s\S])*?'{3}|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')[ \t]*)+)(?=\r?\n|;|#|\Z)")


def _blank(piece: str) -> str:
    return " " * len(piece) if "\n" not in piece else re.sub(r"[^\n]", " ", piece)


def _python_blank(m: re.Match) -> str:
    """Comments as blanks, strings as quotes, and strings of several lines as brackets, which hold their lines together."""
    piece = m.group()
    if piece[0] == "#":
        return " " * len(piece)
    return '"' * len(piece) if "\n" not in piece else f"({_blank(piece[1:-1])})"


class _Lines:
    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def starts(self) -> list[int]:
        return [0, *(end + 1 for end in self.ends)]

    def of(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1


def _at_lines(pattern: re.Pattern, text: str, lines: _Lines) -> Iterator[re.Match]:
    """The matches of ``pattern`` that begin where a line does; a search would try every character."""
    match, past = pattern.match, 0
    for start in lines.starts():
        if start >= past and (m := match(text, start)):
            past = m.end()
            yield m


def tokens(language: str, text: str, ends: bool = True) -> list[tuple[int, str, int, int, str | None]]:
    """``(position, kind, first line, last line, text)`` of the structural tokens, in order; nothing without a function.

    A docstring lies within its function by itself, so that Python's indents are only given for the ``ends`` of functions.
    """
    lines = _Lines(text)
    if language == "python":
        return _python_tokens(text, _PYTHON_SKIP.sub(_python_blank, text), lines, ends) if "def " in text or "def\t" in text else []
    out: list[tuple[int, str, int, int, str | None]] = []

    def skip(m: re.Match) -> str:
        piece = m.group()
        if m["c"] is not None:
            start = m.start()
            if not text[text.rfind("\n", 0, start) + 1 : start].strip() and not (language == "bash" and start == 0 and piece.startswith("#!")):
                out.append((start, COMMENT if piece.startswith("/*") else LINE_COMMENT, lines.of(start), lines.of(m.end() - 1), piece))
        elif "k" in m.re.groupindex and m["k"] is not None:
            return m["k"] + _blank(piece[len(m["k"]) :])
        return _blank(piece) if m["c"] is not None else '"' * len(piece) if "\n" not in piece else re.sub(r"[^\n]", '"', piece)

    blank = _SKIPS[language].sub(skip, text)
    heads, bodies = [], set()
    for m in _at_lines(_HEADS[language], blank, lines):
        name = m.lastgroup
        at = m.start(name)
        first = m.start() + len(m.group()) - len(m.group().lstrip())
        heads.append((first, FUNCTION, lines.of(first), lines.of(at), m[name].lstrip("#")))
        end = m.end()
        if blank[end - 1] == "(" and (body := _AFTER_NAME.match(blank, end - 1)):
            end = body.end()
        bodies.add(end - 1 if language != "bash" and blank[end - 1] == "{" else end)
    if not heads:
        return []
    out += heads
    if language in ("java", "typescript", "javascript"):
        out += [(m.start(), ANNOTATION, lines.of(m.start() + len(m.group()) - len(m.group().lstrip())), lines.of(m.end() - 1 if m.end() > m.start() else m.start()), None) for m in _at_lines(_NOTE, blank, lines)]
    stack: list[bool] = []
    for m in _BRACE.finditer(blank):
        at = m.start()
        if blank[at] == "{":
            stack.append(at in bodies)
            if stack[-1]:
                out.append((at, OPEN, line := lines.of(at), line, None))
        elif stack and stack.pop():
            out.append((at, CLOSE, line := lines.of(at), line, None))
    out.sort(key=lambda t: t[0])
    return out


def _python_tokens(text: str, blank: str, lines: _Lines, ends: bool) -> list[tuple[int, str, int, int, str | None]]:
    out: list[tuple[int, str, int, int, str | None]] = []
    for m in _PYTHON_HEAD.finditer(blank):
        if not _PYTHON_BEFORE.fullmatch(blank, blank.rfind("\n", 0, m.start()) + 1, m.start()):
            continue
        at = m.start("f")
        line = lines.of(at)
        depth, p = 0, m.end()
        if plain := _PYTHON_HEADER.match(blank, p):
            p = plain.end() - 1
        while p < len(blank):
            c = blank[p]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and not depth:
                break
            p += 1
        out.append((at, FUNCTION, line, line, m["f"]))
        if doc := _DOC.match(text, p + 1):
            out.append((doc.start(1), DOCSTRING, lines.of(doc.start(1)), lines.of(doc.end(1) - 1), doc.group(1)))
    if not any(t[1] == DOCSTRING for t in out):
        return []
    if not ends:
        return out
    indents, depth, at, number, previous, joined = [(0, False)], 0, 0, 0, 0, False
    defines = False  # whether the logical line before is the header of a function
    for line in blank.split("\n"):
        number += 1
        bare = line.lstrip()
        if bare:
            if not depth and not joined:
                width = len(line) - len(bare)
                if "\t" in line[:width]:
                    width = len(line[:width].expandtabs(8))
                if width > indents[-1][0]:
                    indents.append((width, defines))
                    if defines:
                        out.append((at - 1, OPEN, number, number, None))
                while width < indents[-1][0]:
                    if indents.pop()[1]:
                        out.append((at - 1, CLOSE, previous, previous, None))
                defines = bare.startswith(("def ", "def\t", "async ", "async\t")) and _PYTHON_DEFINES.match(bare) is not None
            depth += bare.count("(") + bare.count("[") + bare.count("{") - bare.count(")") - bare.count("]") - bare.count("}")
            joined = bare.rstrip().endswith("\\")
            previous = number
        at += len(line) + 1
    out += [(at, CLOSE, previous, previous, None) for _, body in indents if body]
    out.sort(key=lambda t: t[0])
    return out


TOKEN = "copy long, entry_id long, ord int, kind string, first_line int, last_line int, text string"


def _near(found: list[tuple[int, str, int, int, str | None]]) -> bool:
    """Whether a comment of some words ends directly above a function or an annotation, or there is a docstring."""
    starts = {t[2] for t in found if t[1] in (FUNCTION, ANNOTATION)}
    return any(t[1] == DOCSTRING or (t[1] in (COMMENT, LINE_COMMENT) and t[3] + 1 in starts) for t in found)


def _spoken(found: list[tuple[int, str, int, int, str | None]], least: int) -> bool:
    """Whether any comment or docstring has words enough, were they all real; else no function of the file can count."""
    words = 0
    for _, kind, _, _, text in found:
        if kind in (COMMENT, DOCSTRING):
            words = 0  # of its own
        elif kind != LINE_COMMENT:
            continue
        words += len(_WORDS.findall(text))
        if words >= least:
            return True
    return least <= 0


def _lex(batches: Iterator[pa.RecordBatch], least: int, ends: bool) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")
    names = [part.split()[0] for part in TOKEN.split(", ")]
    for batch in batches:
        copies: list[int] = []
        ids: list[int] = []
        sizes: list[int] = []
        rows: list[tuple[int, str, int, int, str | None]] = []
        for copy, entry, language, text in zip(*(batch.column(n).to_pylist() for n in ("copy", "entry_id", "lang", "content")), strict=True):
            found = tokens(language, text, ends)
            if not _near(found) or not _spoken(found, least) or judge(language, text) is not None:
                continue
            copies.append(copy)
            ids.append(entry)
            sizes.append(len(found))
            rows += found
        n = np.array(sizes, np.int64)
        order = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        _, kinds, first, last, texts = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [(np.repeat(np.array(copies, np.int64), n), pa.int64()), (np.repeat(np.array(ids, np.int64), n), pa.int64()), (order.astype(np.int32), pa.int32()), (kinds, pa.string()), (first, pa.int32()), (last, pa.int32()), (texts, pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], names=names)


def function_tokens(entries: DataFrame, languages: DataFrame, least_words: int = 0, ends: bool = True) -> DataFrame:
    """One row per structural token of the valid entries that have a commented function and a comment of ``least_words`` words.

    ``copy``, a digest of the text, tells different rows of one entry apart; equal rows give equal tokens twice.
    """
    texts = with_language(entries.where("entry_id is not null and content is not null").select("entry_id", "path", "language", "content"), languages)
    known = texts.where(F.col("lang").isin(*LANGUAGES)).select(F.xxhash64("lang", "content").alias("copy"), "entry_id", "lang", "content")
    return known.mapInArrow(lambda batches: _lex(batches, least_words, ends), TOKEN)


def real_words(doc: Column, name: Column) -> Column:
    """How many words of ``doc`` are left without comment and string marks, lines that start with ``@`` or ``:``, remarks of work
    to do, and the words of ``name``."""
    body = F.regexp_replace(doc, "^[rRuU]?(?:\"{3}|'{3}|\"|')", "")
    lines = F.transform(F.split(body, r"\r?\n"), lambda line: F.regexp_replace(line, r"^[\s/*#]+", ""))
    kept = F.filter(lines, lambda line: ~line.rlike("^[@:]"))
    words = F.regexp_extract_all(F.lower(F.array_join(kept, "\n")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = F.regexp_extract_all(F.regexp_replace(F.array_join(own, " "), "_", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    # bound to a variable, the words of the name are made once a row and not once a word
    both = F.array(F.struct(words.alias("words"), own.alias("own")))
    left = F.transform(both, lambda x: F.size(F.filter(x["words"], lambda w: ~F.array_contains(x["own"], w) & ~w.isin("todo", "fixme", "tbd", "xxx"))))
    return F.get(left, F.lit(0))


def documented(rows: DataFrame, least_words: int = 4) -> DataFrame:
    """``entry_id, copy, line_start, name, doc, doc_start, line_end`` of the functions among token rows.

    Docstrings come from Python alone, comments and annotations from the others.

    All windows are partitioned by entry and ``copy``, so that the rows are shuffled once. Where the ends aren't asked for,
    Spark leaves out their window.
    """
    file = ("entry_id", "copy")
    order = Window.partitionBy(*file).orderBy("ord")
    rows = rows.withColumn("before", F.lag("ord").over(order)).where("before is null or before <> ord")  # equal rows delivered twice
    # the depth a token lies at: brackets count to what is outside
    delta = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    depth = F.sum(delta).over(order) - F.when(F.col("kind") == OPEN, 1).otherwise(0)
    joins = F.col("kind").isin(LINE_COMMENT, ANNOTATION) & (F.col("kind") == F.lag("kind").over(order)) & (F.col("first_line") == F.lag("last_line").over(order) + 1)
    rows = rows.withColumn("depth", depth).withColumn("begins", F.when(joins, 0).otherwise(1))
    level = F.when(F.col("kind").isin(OPEN, CLOSE), F.col("depth"))
    closes = F.when(F.col("kind") == OPEN, F.lead("last_line").over(Window.partitionBy(*file, level).orderBy("ord")))
    islands = rows.withColumn("closes", closes).withColumn("island", F.sum("begins").over(order))
    runs = islands.groupBy(*file, "island").agg(
        F.min("kind").alias("kind"),
        F.min("depth").alias("depth"),
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
        F.min("closes").alias("closes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))), lambda x: x["text"]), "\n").alias("text"),
    )
    runs = runs.withColumn("kind", F.when(F.col("kind") == LINE_COMMENT, COMMENT).otherwise(F.col("kind")))
    run = Window.partitionBy(*file).orderBy("island")
    before = ("kind", "depth", "first_line", "last_line", "text")
    after = ("kind", "last_line", "text", "closes")
    near = {f"{column}_{n}": (F.lag if n < 0 else F.lead)(column, abs(n)).over(run) for n in (-2, -1, 1, 2) for column in (before if n < 0 else after)}
    seen = runs.withColumns(near).where(F.col("kind") == FUNCTION)
    above = (F.col("kind_-1") == COMMENT) & (F.col("last_line_-1") == F.col("first_line") - 1) & (F.col("depth_-1") == F.col("depth"))
    beyond = (F.col("kind_-1") == ANNOTATION) & (F.col("last_line_-1") == F.col("first_line") - 1) & (F.col("kind_-2") == COMMENT) & (F.col("last_line_-2") == F.col("first_line_-1") - 1) & (F.col("depth_-2") == F.col("depth"))
    inner = F.when(F.col("kind_1") == DOCSTRING, F.col("text_1")).when((F.col("kind_1") == OPEN) & (F.col("kind_2") == DOCSTRING), F.col("text_2"))
    doc = F.coalesce(inner, F.when(above, F.col("text_-1")).when(beyond, F.col("text_-2")))
    start = F.when(inner.isNotNull(), F.col("first_line")).when(above, F.col("first_line_-1")).when(beyond, F.col("first_line_-2"))
    found = seen.select(*file, F.col("last_line").alias("line_start"), F.col("text").alias("name"), doc.alias("doc"), start.alias("doc_start"), F.when(F.col("kind_1") == OPEN, F.col("closes_1")).otherwise(F.coalesce("last_line_1", "last_line")).alias("line_end"))
    return found.where(F.col("doc").isNotNull()).where(real_words(F.col("doc"), F.col("name")) >= least_words)


def documented_functions(entries: DataFrame, languages: DataFrame, least_words: int = 4) -> DataFrame:
    """``entry_id, line_start, name`` of every named function with real documentation, once each.

    Entries that are null, empty, of other languages or not valid in theirs have none; repeated rows count once.
    """
    return documented(function_tokens(entries, languages, least_words, ends=False), least_words).select("entry_id", "line_start", "name").distinct()


def function_pairs(entries: DataFrame, languages: DataFrame, least_words: int = 4) -> DataFrame:
    """``entry_id, lang, name, line_start, line_end, doc, code``: the code from the line of the name to the end of the body.

    Only texts with such functions are joined for their code, by entry and digest.
    """
    found = documented(function_tokens(entries, languages, least_words), least_words).dropDuplicates(["entry_id", "line_start", "name"])
    per = found.groupBy("entry_id", "copy").agg(F.collect_list(F.struct("name", "line_start", F.greatest("line_end", "line_start").alias("line_end"), "doc")).alias("own"))
    texts = with_language(entries.where("entry_id is not null and content is not null").select("entry_id", "path", "language", "content"), languages)
    held = texts.where(F.col("lang").isin(*LANGUAGES)).select("entry_id", "lang", F.xxhash64("lang", "content").alias("copy"), "content")
    joined = per.join(held, ["entry_id", "copy"]).dropDuplicates(["entry_id", "copy"])
    one = joined.select("entry_id", "lang", F.split("content", "\n").alias("lines"), F.inline("own"))
    code = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return one.select("entry_id", "lang", "name", "line_start", "line_end", "doc", code.alias("code"))
