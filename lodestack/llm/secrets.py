"""Credentials embedded in texts: finding and masking them (problem 1).

Texts are cut into chunks of whole lines. Each batch of chunks gets an index of trigrams (see ``trigrams``); the trigrams
that a detection expression requires are derived from the expression itself, their postings are intersected, and the
expression runs over the chunks that remain. The index of a batch is complete for its texts, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.trigrams import Postings, Vocabulary, required

CHUNK_CHARS = 4096
REDACTED = "***REDACTED***"

#: Names of secrets, in lower case.
_KEYWORD = r"(?:pass(?:word|wd|phrase|code)|(?<![a-z])pass(?![a-z])|pwd|secret|token|(?:api|access|private|signing|encryption|auth|account|master|service)[_-]?key|(?<![a-z])auth(?![a-z])|credential)"
#: What follows the name: a quoted value after a separator (perhaps on the next line), a plain value that ends its line, or a default in braces.
_TAIL = (
    r"(?:[\w-]*[\"'\])]{0,3}(?:\s*:\s*[a-z_][\w.|\[\]<>]*(?: *\| *\w+)*)?[ \t]*(?:=>|:=|=|:|,|\|\||\?\?)[ \t]*(?:\(?[ \t]*\r?\n[ \t]*)?[rbuf]{0,2}(?P<q>[\"'`])(?P<v>(?:[^\"'`\s\\]|\\\S|(?!(?P=q))[\"'`]){4,})(?P=q)"
    r"|[\w-]*[ \t]*[:=][ \t]*(?P<plain>[^\s\"'`,;]{4,})[ \t]*(?=\r?\n|\Z|[ \t]#|[ \t];)"
    r"|[\w-]*:?[-=](?P<default>[^\s\"'`{}]{4,})\})"
)

#: Expression by type. The group ``v`` (or ``plain``, ``default``) is the value.
PATTERNS = {
    "PRIVATE_KEY": r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)",
    "ASSIGNED": _KEYWORD + _TAIL,
    "FLAG": r"(?<![\w-])--?[\w-]*?" + _KEYWORD + r"[\w-]*(?:=|[ \t]+)[\"']?(?P<v>[^\s\"'`]{4,})",
    "USER_FLAG": r"(?<![\w-])(?:-u|--user)[ =][\"']?[\w.-]+:(?P<v>[^\s\"'`@]{4,})",
    "HEADER": r"\b(?:Bearer|Basic)[ \t]+(?P<v>[^\s\"'`,;]{8,})",
    "URL": r"[a-z0-9]://[^\s/:@\"'`<>]*:(?P<v>[^\s/\"'`<>]{3,}?)@(?=[\w.\[-])",
    "URL_QUERY": r"[?&][\w-]*?" + _KEYWORD + r"[\w-]*=(?P<v>[^\s&\"'`<>#]{4,})",
    "ELEMENT": r"<[\w.-]*?" + _KEYWORD + r"[\w.-]*>(?P<v>[^\s<>]{4,})</",
    "AWS_KEY": r"(?<![A-Za-z0-9])(?P<v>(?-i:A(?:KIA|SIA)[0-9A-Z]{16}))(?![A-Za-z0-9])",
    "FORGE_TOKEN": r"(?<![A-Za-z0-9])(?P<v>(?-i:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}))",
    "CHAT_TOKEN": r"(?<![A-Za-z0-9])(?P<v>(?-i:xox[abeoprs]-[A-Za-z0-9-]{10,}))",
    "LIVE_KEY": r"(?<![A-Za-z0-9])(?P<v>(?-i:[srp]k[-_](?:live|test|ant|proj|or)[-_][A-Za-z0-9_-]{12,}))",
    "CLOUD_KEY": r"(?<![A-Za-z0-9])(?P<v>(?-i:AIza[A-Za-z0-9_-]{30,}))",
    "SIGNED_TOKEN": r"(?<![A-Za-z0-9])(?P<v>(?-i:eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}))",
}
#: A value after a plain assignment is only one in languages whose values need no quotes.
UNQUOTED = {"ini", "yaml", "markdown", "bash", "toml", "text", "html", "cfg", "sh", "yml", "md", "env", "txt", "conf", "properties", "htm"}

_PLACEHOLDER = re.compile(
    r"(?i)redacted|example|change[-_ ]?me|placeholder|dummy|\byour[-_ ]|your_|[-_]here\b|insert[-_]|replace[-_]?(?:me|with)|todo|fixme|x{5,}|\*{3,}|\.{3}|^<.*>$|^\[.*\]$|^(?:test|none|null|nil|undefined|password|passwd|secret|token|sample|foo|bar|abc123|123456\d*|true|false|yes|no|empty|unset|default)$"
)
_REFERENCE = re.compile(
    r"^\$\{?\w|^\$\(|\$\{|\{\{|\}\}|^%\(|%\(\w+\)s|^%\w+%$|^\{.*\}$|^(?:vault|env|ssm|secretsmanager|keyring|file|ref|op|arn|awssm):|^!\w+|os\.environ|process\.env|getenv|^@\w+@$|^~?\.{0,2}/[a-z_./-]+$"
)
_HASH = re.compile(r"(?i)^(?:sha\d*|md5|blake2[bs]?|crc32)[-:$]|^\$\d\w?\$|^\{sha|^pbkdf2|^argon2|^scrypt")
_NAME_OUT = re.compile(r"(?i)hash|digest|checksum|fingerprint|etag|integrity|public|sha\d|md5|_?(?:length|count|limit|days|ttl|type|name|url|uri|path|file|field|header|param|regex|pattern|policy|min|max|size|prefix|suffix|env|label|hint|prompt|message|error|format|expiry|expires\w*|timeout)$")
_PASSWORD_NAME = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|passcode)$")
_ASSIGNS = re.compile(r"[\"'\])]{0,3}[ \t]*(?:=>|:=|=|:)[ \t]*[rbuf]{0,2}[\"'`]")
_CALL = re.compile(r"^[A-Za-z_][\w.]*\(|[()\[\]]")
_NAME_AFTER = re.compile(r"(?a)[\w-]*")
_COMMENT = re.compile(r"[ \t]*#")


class Finding(NamedTuple):
    line_number: int
    secret_type: str
    name: str
    start: int
    end: int


def value_like(value: str) -> bool:
    """Whether ``value`` can be a secret: no placeholder, reference, number, hash, word or constant name."""
    if len(value) < 6 or _PLACEHOLDER.search(value) or _REFERENCE.search(value) or _HASH.search(value):
        return False
    if re.fullmatch(r"[\d.,_:+-]+|0x[0-9a-fA-F]+|[a-z]+(?:[-_. ][a-z]+)*|[A-Z]+(?:[-_.][A-Z]+)*|[A-Z]?[a-z]+", value):
        return False
    return len(set(value)) > 3 and (re.search(r"\d", value) is not None or (re.search("[A-Z]", value) is not None and re.search("[a-z]", value) is not None))


def password_like(value: str) -> bool:
    """Whether a quoted ``value`` of something called a password can be one: short ones and words, too, but no placeholder, reference, number or hash."""
    return not (_PLACEHOLDER.search(value) or _REFERENCE.search(value) or _HASH.search(value) or re.fullmatch(r"[\d.,_:+-]+|0x[0-9a-fA-F]+|(.)\1*", value))


@lru_cache(maxsize=1)
def _detectors() -> tuple[dict[str, re.Pattern], dict[str, tuple], Vocabulary]:
    compiled = {kind: re.compile(f"(?ai){pattern}") for kind, pattern in PATTERNS.items()}
    queries = {kind: required(f"(?ai){pattern}") for kind, pattern in PATTERNS.items()}
    return compiled, queries, Vocabulary(queries.values())


def _spans(text: str) -> Iterator[tuple[int, int]]:
    """Chunks of whole lines; a longer line is a chunk."""
    at, size = 0, len(text)
    while size - at > CHUNK_CHARS:
        cut = text.rfind("\n", at, at + CHUNK_CHARS) + 1
        if cut <= at:
            cut = text.find("\n", at + CHUNK_CHARS) + 1 or size
        yield at, cut
        at = cut
    if at < size or not size:
        yield at, size


def _context_end(text: str, end: int) -> int:
    """The end of the second line after ``end``, as some values lie on the line after their name."""
    for _ in range(2):
        end = text.find("\n", end) + 1 or len(text)
    return end


def _accepted(kind: str, match: re.Match, start: int, group: str, text: str, unquoted: bool) -> tuple[str, str] | None:
    """``(type, name)`` if ``match``, which began at ``start`` and has its value in ``group``, is a secret."""
    value = match[group]
    line = text.rfind("\n", 0, match.start(group)) + 1
    if _COMMENT.match(text, line) or _COMMENT.match(text, text.rfind("\n", 0, start) + 1):
        return None
    if kind == "PRIVATE_KEY":
        rest = text[match.end() : match.end() + 60].lstrip("\\nr \t\r\n\"'+")
        body = re.match(r"[^\s\\\"'`]*", rest).group()
        return (kind, "") if len(body) >= 8 and not _PLACEHOLDER.search(body) else None
    if kind in ("ASSIGNED", "FLAG", "URL_QUERY", "ELEMENT"):
        if group == "plain" and (not unquoted or _CALL.search(value) or not re.match(r"[ \t]*(?:[-*>|+] )?[ \t]*(?:(?:export|set|local|declare|readonly|ENV|ARG)[ \t]+(?:-\w+[ \t]+)?)?[\w.-]*$", text[text.rfind("\n", 0, start) + 1 : start])):
            return None
        begin = start
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.-"):
            begin -= 1
        name = text[begin:start] + _NAME_AFTER.match(text, start).group()
        if _NAME_OUT.search(name) or not (value_like(value) or (kind == "ASSIGNED" and group == "v" and _PASSWORD_NAME.search(name) and _ASSIGNS.fullmatch(text, begin + len(name), match.start(group)) and password_like(value))):
            return None
        low = name.lower()
        kind = "PASSWORD" if "pass" in low or "pwd" in low else "API_KEY" if "key" in low else "SECRET" if "secret" in low else "TOKEN"
        return kind, name.strip("-.")
    if kind in ("URL", "USER_FLAG"):
        return (kind, "") if len(value) >= 3 and not _PLACEHOLDER.search(value) and not _REFERENCE.search(value) and value.lower() not in ("pass", "pwd", "pw") and not re.fullmatch(r"\d+", value) else None
    return (kind, "") if value_like(value) else None


_KEY, _KEY_TAIL = re.compile(f"(?a){_KEYWORD}"), re.compile(f"(?ai){_TAIL}")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _matches(kind: str, pattern: re.Pattern, text: str, low: str, start: int, stop: int, end: int) -> Iterator[tuple[re.Match, int]]:
    """``(match, its start)`` of the matches of ``pattern`` that begin in ``start:stop``; they may reach to ``end``.

    An assignment is matched in two steps that together are its expression: the names in the lower-cased text, where they
    are plain strings, and from there on what follows.
    """
    if kind != "ASSIGNED":
        for match in pattern.finditer(text, start, end):
            if match.start() >= stop:
                return
            yield match, match.start()
        return
    past = start
    for key in _KEY.finditer(low, start, end):
        if key.start() >= stop:
            return
        if key.start() < past:
            continue  # in the same name as a word before it, from which all that follows was tried
        past = _NAME_AFTER.match(text, key.end()).end()
        if match := _KEY_TAIL.match(text, key.end(), end):
            yield match, key.start()


def scan(texts: list[str], unquoted: list[bool]) -> list[list[Finding]]:
    """The findings of each text, in order; of overlapping ones the first in the order of ``PATTERNS`` counts."""
    compiled, queries, vocabulary = _detectors()
    chunks = [(k, a, b) for k, text in enumerate(texts) for a, b in _spans(text)]
    postings = Postings(vocabulary, [texts[k][a:b] for k, a, b in chunks])
    found: list[list[Finding]] = [[] for _ in texts]
    low: dict[int, str] = {}
    for kind, pattern in compiled.items():
        for number in postings.candidates(queries[kind]):
            k, a, b = chunks[number]
            text = texts[k]
            if kind == "ASSIGNED" and k not in low:
                low[k] = _lower(text)
            for match, at in _matches(kind, pattern, text, low.get(k, ""), a, b, _context_end(text, b)):
                group = "v" if match["v"] is not None else match.lastgroup
                accepted = _accepted(kind, match, at, group, text, unquoted[k])
                start, end = match.span(group)
                if accepted and not any(f.start < end and start < f.end for f in found[k]):
                    found[k].append(Finding(text.count("\n", 0, start) + 1, *accepted, start, end))
    for own in found:
        own.sort(key=lambda f: f.start)
    return found


_END = re.compile(r"-----(?:(?P<end>END)|BEGIN) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: The body of a key without an end: headers and runs of encoded characters with line ends, quotes and the like between them.
_OPEN_BODY = re.compile(r"(?:(?:\\[nr]|[\s\"'`+,\\])*(?:[A-Za-z][\w-]*: [^\n\"'`]*(?=\n)|[A-Za-z0-9+/]{16,}={0,2}(?![\w(.])|[A-Za-z0-9+/]{1,15}={1,2}(?![\w=(])))*")
_BODY_RUN = re.compile(r"[^\s\\\"'`+,]{8,}")
_OPEN_RUN = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2}")


def mask(text: str, findings: list[Finding]) -> str:
    """``text`` with every value, and every line within a private key block, replaced; all else is unchanged.

    A key block reaches to its own END line; of one that has none, only what is encoded directly after it is replaced.
    """
    out, at = [], 0
    for f in findings:
        start, end = f.start, f.end
        if f.secret_type == "PRIVATE_KEY":
            close = _END.search(text, end)
            start = end
            if close and close["end"]:
                end = close.start()
                body = _BODY_RUN.sub(REDACTED, text[start:end])
            else:
                end = _OPEN_BODY.match(text, start).end()
                body = _OPEN_RUN.sub(REDACTED, text[start:end])
        else:
            body = REDACTED
        if start < at:
            continue
        out += [text[at:start], body]
        at = end
    return "".join([*out, text[at:]])


def _is_unquoted(language: str | None, path: str | None) -> bool:
    name = (path or "").rsplit("/", 1)[-1].lower()
    return (language or "").strip().lower() in UNQUOTED or name.rsplit(".", 1)[-1] in UNQUOTED


def _per_batch(emit: Callable[[pd.DataFrame, list[str], list[list[Finding]]], pd.DataFrame]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["content"])
            yield emit(batch, texts, scan(texts, [_is_unquoted(x, p) for x, p in zip(batch["language"], batch["path"], strict=True)]))

    return run


FINDING = "entry_id long, line_number int, secret_type string, variable_name string, masked_text string"


def _findings(batch: pd.DataFrame, texts: list[str], found: list[list[Finding]]) -> pd.DataFrame:
    rows = []
    for entry, text, own in zip(batch["entry_id"], texts, found, strict=True):
        if own:
            lines = mask(text, own).split("\n")
            rows += [(entry, f.line_number, f.secret_type, f.name, lines[f.line_number - 1].strip()) for f in own]
    return pd.DataFrame(rows, columns=["entry_id", "line_number", "secret_type", "variable_name", "masked_text"])


def find_secrets(entries: DataFrame) -> DataFrame:
    """One row per secret: ``entry_id, line_number (from 1, at line feeds), secret_type, variable_name, masked_text``.

    Null and empty contents have none, nor have rows without entry_id; repeated rows of one entry_id give their findings once; the language or path may be
    null, which only disallows values without quotes.
    """
    texts = entries.where("entry_id is not null and content <> ''").select("entry_id", "path", "language", "content")
    return texts.mapInPandas(_per_batch(_findings), FINDING).distinct()


def _lines(batch: pd.DataFrame, texts: list[str], found: list[list[Finding]]) -> pd.DataFrame:
    rows = [(entry, f.line_number) for entry, own in zip(batch["entry_id"], found, strict=True) for f in own]
    return pd.DataFrame(rows, columns=["entry_id", "line_number"])


def secret_lines(entries: DataFrame) -> DataFrame:
    """The distinct ``entry_id, line_number`` of ``find_secrets``."""
    texts = entries.where("entry_id is not null and content <> ''").select("entry_id", "path", "language", "content")
    return texts.mapInPandas(_per_batch(_lines), "entry_id long, line_number int").distinct()


def _masked(batch: pd.DataFrame, texts: list[str], found: list[list[Finding]]) -> pd.DataFrame:
    rows = [(entry, len(own), mask(text, own)) for entry, text, own in zip(batch["entry_id"], texts, found, strict=True) if own]
    return pd.DataFrame(rows, columns=["entry_id", "n_secrets", "masked_content"])


def mask_secrets(entries: DataFrame) -> DataFrame:
    """``entry_id, n_secrets, masked_content`` of every entry with a secret; masking a masked content changes nothing."""
    texts = entries.where("entry_id is not null and content <> ''").select("entry_id", "path", "language", "content")
    return texts.mapInPandas(_per_batch(_masked), "entry_id long, n_secrets int, masked_content string").dropDuplicates(["entry_id"])
