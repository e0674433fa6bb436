"""Text columns: lines, tokens, limits, fences, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def universal(content: Column) -> Column:
    """``content`` with line feeds only."""
    return F.regexp_replace(content, "\r\n?", "\n")


def lines(content: Column) -> Column:
    """Lines at universal line ends; a last empty one doesn't count; an empty text has none."""
    parts = F.split(universal(content), "\n", -1)
    return F.when(content == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def split_lines(content: Column) -> Column:
    """Lines at every boundary that ``str.splitlines`` knows."""
    return lines(F.regexp_replace(F.regexp_replace(content, "\r\n", "\n"), "[\r\u000b\f\u001c\u001d\u001e\u0085  ]", "\n"))


def line_count(content: Column) -> Column:
    return F.size(lines(content))


def empty_line_count(content: Column) -> Column:
    return F.size(F.filter(lines(content), lambda line: F.trim(F.regexp_replace(line, r"\s", "")) == ""))


def comment_line_count(content: Column, language: Column) -> Column:
    """Lines that are wholly a ``#`` comment in Python and Bash (a first ``#!`` line isn't one in Bash); null for others."""
    own = F.size(F.filter(lines(content), lambda line: line.rlike(r"^\s*#")))
    shebang = F.when(content.rlike(r"\A#!"), 1).otherwise(0)
    return F.when(language == "python", own).when(language == "bash", own - shebang)


def tokens_up(content: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.call_function("div", F.length(content) + 3, F.lit(4))


def tokens_down(content: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.call_function("div", F.length(content), F.lit(4))


def tokens_at_least_one(content: Column) -> Column:
    return F.greatest(tokens_up(content), F.lit(1))


def is_utf8_text(raw: Column, probe: int | None = None) -> Column:
    """Whether the bytes (or their first ``probe``) are valid UTF-8."""
    return F.is_valid_utf8((F.substring(raw, 1, probe) if probe else raw).cast("string"))


def has_nul(raw: Column, probe: int = 1024) -> Column:
    return F.position(F.unhex(F.lit("00")), F.substring(raw, 1, probe)) > 0


def head_lines(content: Column, n: int) -> Column:
    """The first ``n`` lines with their line feeds."""
    return F.regexp_extract(universal(content), rf"\A((?:[^\n]*\n){{0,{n - 1}}}(?:[^\n]*\n|[^\n]*\z)?)", 1) if n > 0 else F.lit("")


def omitted_lines(content: Column, n: int) -> Column:
    return F.greatest(line_count(content) - n, F.lit(0))


def byte_prefix(content: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes."""
    cut = F.substring(F.encode(content, "UTF-8"), 1, most)
    hexed = F.hex(cut)
    # drop a last character whose bytes aren't all there: one lead byte and fewer continuation bytes than it announces
    whole = F.regexp_replace(hexed, r"(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])\z", "")
    aligned = F.when(F.length(whole) % 2 == 0, whole).otherwise(hexed)
    return F.when(F.octet_length(content) <= most, content).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def limited(content: Column, most: int, notice: str) -> Column:
    """``content`` within ``most`` bytes: a prefix without trailing white space, then the notice; a notice that is too long is cut."""
    room = most - len(notice.encode())
    if room <= 0:
        return F.when(F.octet_length(content) <= most, content).otherwise(F.lit(notice.encode()[:most].decode("utf-8", "ignore")))
    return F.when(F.octet_length(content) <= most, content).otherwise(F.concat(F.rtrim(F.regexp_replace(byte_prefix(content, room), r"\s+\z", "")), F.lit(notice)))


def fence(content: Column) -> Column:
    """The shortest run of at least three backticks that ``content`` doesn't hold."""
    longest = F.array_max(F.transform(F.regexp_extract_all(content, F.lit("(`+)"), F.lit(1)), lambda run: F.length(run)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def table_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def xml_escaped(value: Column) -> Column:
    out = value
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def plain_chunks(content: Column, most: Column) -> Column:
    """Consecutive chunks of ``most`` characters; an empty text is one empty chunk."""
    n = F.greatest(F.ceil(F.length(content) / most), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(content, (k * most + 1).cast("int"), most.cast("int")))
