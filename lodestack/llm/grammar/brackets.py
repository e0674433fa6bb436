"""Bracket trees of classed tokens.

A lexer turns a text into one character per token; what stands in brackets becomes a child and one character in its parent.
A grammar then parses one level at a time: given the string of a level and its role it returns the roles of the children,
or nothing if the level is no sentence. Levels repeat a lot in real code, so their results are remembered.
"""

from __future__ import annotations

from collections.abc import Callable

CLOSE = {"(": ")", "[": "]", "{": "}"}
GROUP = {"(": "P", "[": "K", "{": "B"}


class Invalid(Exception):
    """The text is no sentence of the language."""


class Node:
    __slots__ = ("close", "tokens", "children")

    def __init__(self, close: str):
        self.close, self.tokens, self.children = close, [], []


class Levels:
    """Results by (role, level); the table is emptied when it is full."""

    def __init__(self, parse: Callable[[str, str], list[str]], remember: int = 50_000):
        self.parse, self.remember, self.known = parse, remember, {}

    def check(self, root: Node, role: str) -> None:
        todo = [(root, role)]
        while todo:
            node, role = todo.pop()
            key = role, "".join(node.tokens)
            roles = self.known.get(key)
            if roles is None:
                if len(self.known) >= self.remember:
                    self.known.clear()
                try:
                    roles = self.parse(*key)
                except (Invalid, RecursionError):
                    roles = False
                self.known[key] = roles
            if roles is False or len(roles) != len(node.children):
                raise Invalid(f"{role}: {key[1][:80]!r}")
            todo += zip(node.children, roles, strict=True)


class Cursor:
    """A position in a level; ``N`` is a line end, which most rules pass over."""

    def __init__(self, text: str):
        self.s, self.p, self.roles = text, 0, []

    def peek(self) -> str:
        s, p = self.s, self.p
        while p < len(s) and s[p] == "N":
            p += 1
        return s[p] if p < len(s) else ""

    def after(self, n: int = 1) -> str:
        """The token ``n`` after the next one."""
        rest = self.s[self.p :].replace("N", "")
        return rest[n] if n < len(rest) else ""

    def at_line_end(self) -> bool:
        return self.p < len(self.s) and self.s[self.p] == "N"

    def take(self, allowed: str | None = None) -> str:
        c = self.peek()
        if not c or (allowed is not None and c not in allowed):
            raise Invalid(f"{c!r} at {self.p} of {self.s[:60]!r}")
        while self.s[self.p] == "N":
            self.p += 1
        self.p += 1
        return c

    def group(self, kind: str, role: str) -> None:
        self.take(kind)
        self.roles.append(role)

    def optional(self, allowed: str) -> bool:
        if (c := self.peek()) and c in allowed:
            self.take()
            return True
        return False

    def attempt(self, rule: Callable[[], bool]) -> bool:
        """Runs ``rule``; if it fails or returns False, nothing has been read."""
        p, n = self.p, len(self.roles)
        try:
            if rule():
                return True
        except Invalid:
            pass
        self.p = p
        del self.roles[n:]
        return False
