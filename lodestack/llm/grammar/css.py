"""Style sheets."""

from __future__ import annotations

import re

from lodestack.llm.grammar.brackets import Invalid

_TOKEN = re.compile(r"""(?P<s>/\*[\s\S]*?\*/)|(?P<q>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<u>url\((?:[^()"'\\\s]|\\.)*\))|(?P<b>[{}()\[\];])|(?P<x>[^{}()\[\];"'/]+|/)""", re.IGNORECASE)
_PROPERTY = re.compile(r"\s*(?:--[\w-]*|\*?-?[a-z_][\w-]*)\s*:\s*\S", re.IGNORECASE)
_SELECTOR = re.compile(r"\s*(?:[^\s{};=!`$%^<?'\"\d,>+~][^{};=!`$%^<?“”]*|[>+~][^{};]*|\d+(?:\.\d+)?%(?:\s*,\s*\d+(?:\.\d+)?%)*\s*)\Z")
#: At-rules whose blocks hold rules; those of the others hold declarations or rules.
_NAME = re.compile(r"\s*@-?[a-z][\w-]*", re.IGNORECASE)
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def css(text: str) -> None:
    """Accepts rules and at-rules with balanced brackets whose blocks hold declarations (or nested rules)."""
    last = text.rfind("*/") + 1
    if text.count("/*", last) > 100:  # comments without an end, each of which would be searched for one
        text = text[:last] + text[last:].replace("/*", "/ *")
    stack: list[str] = []
    part: list[str] = []
    at = blocks = 0
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        kind, token = m.lastgroup, m.group()
        if kind == "s":
            continue
        if kind != "b" or token in "([":
            if kind == "b":
                stack.append(_CLOSE[token])
            part.append("s" if kind in ("q", "u") else token)
            continue
        if token in ")]":
            if not stack or stack.pop() != token:
                raise Invalid(f"unexpected {token}")
            part.append(token)
            continue
        if stack and stack[-1] != "}":
            if token == ";" and stack[-1] == ")":  # data in url(...)
                part.append(token)
                continue
            raise Invalid(f"{stack[-1]} is missing")
        head = "".join(part)
        part = []
        if token == "{":
            if not (_NAME.match(head) or _SELECTOR.match(re.sub(r"\[[^\]]*\]|\([^()]*\)", "", head)) or re.match(r"\s*[:*.#&\[]", head)):
                raise Invalid(f"selector {head[:40]!r}")
            stack.append("}")
            blocks += 1
        elif token == ";":
            if head.strip():
                _declaration(head, bool(stack))
        else:
            if not stack:
                raise Invalid("unexpected }")
            if head.strip():
                _declaration(head, True)
            stack.pop()
    if at != len(text) or stack or "".join(part).strip():
        raise Invalid(f"end at {at}")


def _declaration(head: str, inside: bool) -> None:
    if _NAME.match(head):
        return
    if not inside or not _PROPERTY.match(head) or "\n\n" in head.strip() or re.search(r"\n\s*[\w-]+\s*:", head.strip()):
        raise Invalid(f"declaration {head[:40]!r}")
