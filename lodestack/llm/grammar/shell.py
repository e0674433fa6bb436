"""Bash scripts: words, quotes, here-documents and compound commands."""

from __future__ import annotations

import re

from lodestack.llm.grammar.brackets import Invalid

_SPACE = re.compile(r"(?:[ \t]|\\\r?\n)+")
_COMMENT = re.compile(r"#[^\n]*")
_PLAIN = re.compile(r"(?:[^\s\\\"'`$()<>|&;#]|(?<=[^\s;|&()])#)+")
_SINGLE = re.compile(r"'[^']*'")
_ANSI = re.compile(r"\$'(?:[^'\\]|\\[\s\S])*'")
_REDIRECT = re.compile(r"(?:\d+|\{\w+\})?(?:<<<|<<-?|<&|<>|>>|>&|>\||&>>|&>|<|>)")
_OPERATOR = re.compile(r"&&|\|\||;;&|;;|;&|\|&|[;|&\n]")
_NAME = re.compile(r"[A-Za-z_]\w*")
_OPEN = {"if": "then", "while": "do", "until": "do"}
_WORD = re.compile(r"[^\s;|&()<>\"'`$\\]+")
_CHAIN = re.compile(r"&&|\|\||\|&?(?!\|)")
_TEST_END = re.compile(r"\s\]\](?=[\s;|&)]|$)")
_FUNCTION = re.compile(r"[^\s()<>|&;\"'`$]+")
_CALL_LIKE = re.compile(r"[^\s()<>|&;\"'`$=]+[ \t]*\([ \t]*\)")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=$")


class _Shell:
    def __init__(self, text: str):
        self.t, self.p, self.heredocs = text, 0, []

    def fail(self, what: str) -> None:
        raise Invalid(f"{what} at {self.p}")

    def space(self) -> None:
        while m := _SPACE.match(self.t, self.p):
            self.p = m.end()
        if self.p < len(self.t) and self.t[self.p] == "#" and (self.p == 0 or self.t[self.p - 1] in " \t\n;|&()"):
            self.p = _COMMENT.match(self.t, self.p).end()
        if self.t.startswith("\r\n", self.p):
            self.p += 1

    def newline(self) -> None:
        """Passes a line end and the bodies of the here-documents that begin after it."""
        self.p += 1
        for word, tabs in self.heredocs:
            while True:
                end = self.t.find("\n", self.p)
                line = self.t[self.p : end if end >= 0 else len(self.t)].rstrip("\r")
                if self.p >= len(self.t):
                    return  # ended by the end of the file, which Bash only warns of
                self.p = end + 1 if end >= 0 else len(self.t)
                if (line.lstrip("\t") if tabs else line) == word:
                    break
        self.heredocs = []

    def lines(self) -> None:
        while True:
            self.space()
            if self.p < len(self.t) and self.t[self.p] == "\n":
                self.newline()
            else:
                return

    # words

    def double(self) -> None:
        t = self.t
        self.p += 1
        while self.p < len(t):
            c = t[self.p]
            if c == '"':
                self.p += 1
                return
            if c == "\\":
                self.p += 2
            elif c == "$":
                self.dollar()
            elif c == "`":
                self.backtick()
            else:
                self.p += 1
        self.fail('" is missing')

    def backtick(self) -> None:
        end = self.p + 1
        while end < len(self.t) and self.t[end] != "`":
            end += 2 if self.t[end] == "\\" else 1
        if end >= len(self.t):
            self.fail("` is missing")
        self.p = end + 1

    def dollar(self) -> None:
        t, p = self.t, self.p
        if t.startswith("$((", p):
            depth, q = 0, p + 1
            while q < len(t):
                depth += (t[q] == "(") - (t[q] == ")")
                q += 1
                if not depth:
                    self.p = q
                    return
            self.fail(") is missing")
        if t.startswith("$(", p):
            self.p += 2
            self.list_(")")
            self.p += 1
        elif t.startswith("${", p):
            self.p += 2
            while self.p < len(t):
                c = t[self.p]
                if c == "}":
                    self.p += 1
                    return
                if c == "\\":
                    self.p += 2
                elif c == '"':
                    self.double()
                elif c == "'" and (m := _SINGLE.match(t, self.p)):
                    self.p = m.end()
                elif c == "$":
                    self.dollar()
                elif c == "`":
                    self.backtick()
                else:
                    self.p += 1
            self.fail("} is missing")
        else:
            self.p += 1

    def word(self) -> str | None:
        """The next word as written, or None."""
        start, t = self.p, self.t
        while self.p < len(t):
            c = t[self.p]
            if m := _PLAIN.match(t, self.p):
                self.p = m.end()
            elif c == "\\":
                self.p += 2
            elif c == "'":
                m = _SINGLE.match(t, self.p)
                if not m:
                    self.fail("' is missing")
                self.p = m.end()
            elif c == '"':
                self.double()
            elif c == "$":
                m = _ANSI.match(t, self.p)
                if m:
                    self.p = m.end()
                else:
                    self.dollar()
            elif c == "`":
                self.backtick()
            elif c == "(" and _ASSIGN.search(t[max(start, self.p - 200) : self.p]):
                self.p += 1
                self.array()
            elif c in "<>" and t.startswith("(", self.p + 1) and self.p == start:
                self.p += 2
                self.list_(")")
                self.p += 1
            elif c == "(" and self.p > start and t[self.p - 1] in "?*+@!" and t[self.p - 1 : self.p] != "":
                end = t.find(")", self.p)
                if end < 0 or "\n" in t[self.p : end]:
                    self.fail(") is missing")
                self.p = end + 1
            else:
                break
        return t[start : self.p] if self.p > start else None

    def array(self) -> None:
        while True:
            self.lines()
            if self.t.startswith(")", self.p):
                self.p += 1
                return
            if self.word() is None:
                self.fail("array")

    def redirect(self) -> bool:
        m = _REDIRECT.match(self.t, self.p)
        if not m or (m.group() in ("<", ">") and self.t.startswith("(", m.end())):
            return False
        self.p = m.end()
        self.space()
        word = self.word()
        if word is None:
            self.fail("target of a redirection")
        if m.group().endswith(("<<", "<<-")):
            self.heredocs.append((re.sub(r"[\\\"']", "", word), m.group().endswith("-")))
        return True

    # commands

    def keyword(self) -> str:
        """The word at this place, if it is plain; nothing is read."""
        m = _WORD.match(self.t, self.p)
        return m.group() if m and (m.end() == len(self.t) or self.t[m.end()] in " \t\r\n;|&()<>") else ""

    def expect(self, word: str) -> None:
        self.lines()
        if self.keyword() != word:
            self.fail(f"{word} is missing")
        self.p += len(word)

    def list_(self, until: str) -> str:
        """Commands up to one of the ``until`` words (not read); returns it. The list may be empty only in places that allow it."""
        ends = until.split()
        count = 0
        while True:
            self.lines()
            if self.p >= len(self.t):
                if "" in ends or not ends:
                    return ""
                self.fail(f"{until} is missing")
            if ")" in ends and self.t[self.p] == ")":
                return ")"
            if ";;" in ends and self.t.startswith((";;", ";&"), self.p):
                return ";;"
            word = self.keyword()
            if word in ends and word:
                if not count and word not in ("esac",):
                    self.fail("empty list")
                return word
            self.pipeline()
            count += 1
            self.space()
            while m := _CHAIN.match(self.t, self.p):
                self.p = m.end()
                self.lines()
                self.pipeline()
                self.space()
            if self.p >= len(self.t) or (")" in ends and self.t[self.p] == ")") or self.t.startswith((";;", ";&"), self.p):
                continue
            if self.t[self.p] in ";&":
                self.p += 1
            elif self.t[self.p] != "\n":
                self.fail(f"unexpected {self.t[self.p]!r}")

    def pipeline(self) -> None:
        while self.keyword() in ("!", "time"):
            self.p += len(self.keyword())
            self.space()
        self.command()

    def redirects(self) -> None:
        self.space()
        while self.redirect():
            self.space()

    def command(self) -> None:
        t, word = self.t, self.keyword()
        if t.startswith("((", self.p):
            depth, q = 0, self.p
            while q < len(t):
                depth += (t[q] == "(") - (t[q] == ")")
                q += 1
                if not depth:
                    break
            else:
                self.fail(") is missing")
            self.p = q
            return self.redirects()
        if t.startswith("(", self.p):
            self.p += 1
            self.list_(")")
            self.p += 1
            return self.redirects()
        if word == "{":
            self.p += 1
            self.list_("}")
            self.p += 1
            return self.redirects()
        if word in _OPEN:
            self.p += len(word)
            self.list_(_OPEN[word])
            self.p += len(_OPEN[word])
            if word == "if":
                while (end := self.list_("elif else fi")) == "elif":
                    self.p += 4
                    self.list_("then")
                    self.p += 4
                if end == "else":
                    self.p += 4
                    self.list_("fi")
                self.p += 2
            else:
                self.list_("done")
                self.p += 4
            return self.redirects()
        if word in ("for", "select"):
            self.p += len(word)
            self.space()
            if t.startswith("((", self.p):
                end = t.find("))", self.p)
                if end < 0:
                    self.fail(")) is missing")
                self.p = end + 2
            else:
                m = _NAME.match(t, self.p)
                if not m:
                    self.fail("name of a loop")
                self.p = m.end()
                self.lines()
                if self.keyword() == "in":
                    self.p += 2
                    self.space()
                    while self.word() is not None:
                        self.space()
            self.space()
            if t.startswith(";", self.p):
                self.p += 1
            self.expect("do")
            self.list_("done")
            self.p += 4
            return self.redirects()
        if word == "case":
            self.p += 4
            self.space()
            if self.word() is None:
                self.fail("case")
            self.expect("in")
            while True:
                self.lines()
                if self.keyword() == "esac":
                    self.p += 4
                    return self.redirects()
                if t.startswith("(", self.p):
                    self.p += 1
                while True:
                    self.space()
                    if self.word() is None:
                        self.fail("pattern")
                    self.space()
                    if not t.startswith("|", self.p):
                        break
                    self.p += 1
                if not t.startswith(")", self.p):
                    self.fail("pattern")
                self.p += 1
                if self.list_(";; esac") == ";;":
                    self.p += 3 if t.startswith(";;&", self.p) else 2
        if word == "[[":
            end = _TEST_END.search(t, self.p)
            if not end:
                self.fail("]] is missing")
            self.p = end.end()
            return self.redirects()
        if word == "function":
            self.p += 8
            self.space()
            if not (m := _FUNCTION.match(t, self.p)):
                self.fail("name of a function")
            self.p = m.end()
            self.space()
            if t.startswith("(", self.p):
                self.p += 1
                self.space()
                if not t.startswith(")", self.p):
                    self.fail("function")
                self.p += 1
            return self.function_body()
        if word in ("then", "do", "done", "fi", "else", "elif", "esac", "}", "in", "]]"):
            if word not in ("in", "]]"):
                self.fail(f"unexpected {word}")
        if m := _CALL_LIKE.match(t, self.p):
            self.p = m.end()
            return self.function_body()
        count = 0
        while True:
            self.space()
            if self.redirect():
                count += 1
                continue
            if self.word() is None:
                break
            count += 1
        if not count:
            self.fail(f"unexpected {t[self.p : self.p + 1]!r}")
        if t.startswith("(", self.p):
            self.fail("unexpected (")
        return None

    def function_body(self) -> None:
        self.lines()
        if self.keyword() not in ("{", "if", "for", "while", "until", "case", "[[", "select") and not self.t.startswith("(", self.p):
            self.fail("body of a function")
        self.command()


def bash(text: str) -> None:
    shell = _Shell(text)
    shell.list_("")
    if shell.p < len(text):
        shell.fail("end")
