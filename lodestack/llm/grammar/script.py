"""JavaScript (ECMAScript modules and scripts) and TypeScript."""

from __future__ import annotations

import re

from lodestack.llm.grammar.brackets import CLOSE, GROUP, Cursor, Invalid, Levels, Node

_COMMON = {
    "function": "f", "class": "c", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "try": "t", "catch": "C", "finally": "y",
    "return": "r", "throw": "h", "var": "l", "let": "l", "const": "l", "new": "n", "import": "m", "export": "x", "default": "d", "switch": "s",
    "case": "a", "break": "b", "continue": "b", "async": "A", "await": "w", "yield": "Y", "typeof": "u", "void": "u", "delete": "u",
    "in": "o", "instanceof": "o", "of": "O", "this": "v", "super": "v", "null": "v", "true": "v", "false": "v", "extends": "e", "static": "S",
    "debugger": "b",
}
_TYPED = {
    "interface": "G", "type": "H", "enum": "U", "namespace": "M", "module": "M", "declare": "L", "abstract": "Q", "as": "Z", "satisfies": "Z",
    "keyof": "q", "unique": "q", "infer": "q", "readonly": "q", "public": "X", "private": "X", "protected": "X", "override": "X",
    "implements": "J", "is": "j", "asserts": "j",
}
_PUNCT = {"=>": "R", "...": "p", "?.": ".", "++": "#", "--": "#", "!": "!", "~": "!", "+": "+", "-": "+", ";": ";", ",": ",", ".": ".", ":": ":", "?": "?", "*": "*", "@": "@", "<": "<", ">": ">", "|": "|", "&": "|"}
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_OPERATOR = r"=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|\*\*=?|&&=?|\|\|=?|\?\?=?|<<=?|[+\-*%&|^]=|[=!~+\-*%&|^<>?:;,(\[{@]"
_INNER = r"(?:[^{}`]|\{(?:[^{}`]|\{[^{}`]*\})*\}|`[^`]*`)*"
_TOKEN = re.compile(
    rf"""[ \t\f\v ﻿]*(?:(?P<w>(?:[^\W\d]|\$)(?:\w|\$)*)(?P<wr>(?<=return)\s*{_REGEX}|(?<=typeof)\s*{_REGEX}|(?<=case)\s*{_REGEX})?
    |(?P<n>(?:\r?\n|[\r\u2028\u2029])\s*)
    |(?P<c>//[^\n\r]*|/\*[\s\S]*?\*/|^\#![^\n]*)
    |(?P<u>/\*)
    |(?P<v>"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?(?!\w))
    |(?P<t>`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|\$\{{{_INNER}\}})*`)
    |(?P<i>\#(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<x>\+\+|--)
    |(?P<o>(?:{_OPERATOR}))(?:\s*(?P<r>{_REGEX}))?
    |(?P<e>[)\]}}])
    |(?P<d>>=|/=?|\.)
    |(?P<end>\Z))""",
    re.VERBOSE,
)
IDENTIFIER = "iAOSGHMLQZqXJj"
_NAME = IDENTIFIER + "fcIEFWDtCyrhlnmxdsabwYuovUe"


class _Classes(dict):
    """The class of each operator."""

    def __missing__(self, op: str) -> str:
        assigns = op == "=" or (len(op) > 1 and op[-1] == "=" and op not in ("==", "===", "!=", "!==", "<="))
        self[op] = "=" if assigns else _PUNCT.get(op, "o")
        return self[op]


_CLASSES = _Classes()


def lex(text: str, typed: bool) -> Node:
    words = {**_COMMON, **_TYPED} if typed else _COMMON
    root = Node("")
    stack, tokens = [root], root.tokens
    at = 0
    for m in iter(_TOKEN.scanner(text).match, None):
        kind = m.lastgroup
        if kind == "w":
            tokens.append(words.get(m[1], "i"))
        elif kind == "wr":
            tokens += [words[m["w"]], "v"]
        elif kind == "n":
            tokens.append("N")
        elif kind == "v":
            tokens.append("v")
        elif kind in ("o", "r"):
            op = m["o"]
            if op in GROUP:
                tokens.append(GROUP[op])
                node = Node(CLOSE[op])
                stack[-1].children.append(node)
                stack.append(node)
                tokens = node.tokens
            else:
                tokens.append(_CLASSES[op])
            if kind == "r":
                tokens.append("v")
        elif kind == "e":
            if stack[-1].close != m["e"]:
                raise Invalid(f"unexpected {m['e']}")
            stack.pop()
            tokens = stack[-1].tokens
        elif kind == "d":
            tokens.append("." if m["d"] == "." else ">=" if m["d"] == ">=" else "=" if m["d"] == "/=" else "o")
        elif kind == "t":
            tokens.append("V")
        elif kind == "x":
            tokens.append("#")
        elif kind == "i":
            tokens.append("i")
        elif kind == "c":
            if "\n" in m["c"]:
                tokens.append("N")
        elif kind == "u":
            raise Invalid("a comment without an end")
        else:  # the end
            at = m.end()
            break
        at = m.end()
    if at != len(text):
        raise Invalid(f"no token at {at}")
    if len(stack) > 1:
        raise Invalid(f"{stack[-1].close} is missing")
    return root


class _Level(Cursor):
    def __init__(self, text: str, typed: bool):
        super().__init__(text)
        self.typed = typed

    # statements

    def statements(self) -> None:
        while self.peek():
            self.statement()

    def end(self) -> None:
        if not self.optional(";") and self.peek() and not self.at_line_end():
            raise Invalid("end of statement")

    def body(self) -> None:
        if self.typed and self.peek() != "B":
            return self.end()  # an overload
        self.group("B", "block")

    def statement(self) -> None:
        c, n = self.peek(), self.after()
        if c == ";":
            self.take()
        elif c == "B":
            self.group("B", "block")
        elif c == "I":
            self.take()
            self.group("P", "expression")
            self.statement()
            if self.optional("E"):
                self.statement()
        elif c == "F":
            self.take()
            self.optional("w")
            self.group("P", "for")
            self.statement()
        elif c == "W":
            self.take()
            self.group("P", "expression")
            self.statement()
        elif c == "D":
            self.take()
            self.statement()
            self.take("W")
            self.group("P", "expression")
            self.optional(";")
        elif c == "t":
            self.take()
            self.group("B", "block")
            if self.optional("C"):
                if self.peek() == "P":
                    self.group("P", "parameters")
                self.group("B", "block")
                if self.optional("y"):
                    self.group("B", "block")
            else:
                self.take("y")
                self.group("B", "block")
        elif c == "s":
            self.take()
            self.group("P", "expression")
            self.group("B", "switch")
        elif c in "rh" and c:
            self.take()
            if c == "h" or (self.peek() not in ("", ";") and not self.at_line_end()):
                self.expression()
            self.end()
        elif c == "b":
            self.take()
            if not self.at_line_end():
                self.optional(IDENTIFIER)
            self.end()
        elif c == "l" and not (self.typed and n == "U"):
            self.take()
            self.declarators()
            self.end()
        elif c == "f" or (c == "A" and n == "f"):
            self.optional("A")
            self.function(named=True)
        elif c == "c" or (self.typed and c == "Q" and n == "c"):
            self.optional("Q")
            self.class_(named=True)
        elif c == "m" and n not in ("P", "."):
            self.import_()
        elif c == "x":
            self.export()
        elif c == "@":
            self.decorator()
            self.statement()
        elif self.typed and c == "G" and n in IDENTIFIER and n:
            self.take()
            self.take(IDENTIFIER)
            self.type_parameters()
            if self.optional("e"):
                self.types()
            self.group("B", "members")
        elif self.typed and c == "H" and n and n in IDENTIFIER:
            self.take()
            self.take(IDENTIFIER)
            self.type_parameters()
            self.take("=")
            self.type()
            self.end()
        elif self.typed and (c == "U" or (c == "l" and n == "U")):
            self.optional("l")
            self.take("U")
            self.take(IDENTIFIER)
            self.group("B", "enum")
        elif self.typed and c == "M" and n and n in IDENTIFIER + "v":
            self.take()
            self.take(IDENTIFIER + "v")
            while self.optional("."):
                self.take(IDENTIFIER)
            self.group("B", "block")
        elif self.typed and c == "L" and n and n in "flcGHUMQAx":
            self.take()
            self.statement()
        elif c and c in IDENTIFIER and n == ":":
            self.take()
            self.take()
            self.statement()
        else:
            self.expression()
            self.end()

    def declarators(self) -> None:
        while True:
            self.binding()
            if self.typed:
                self.optional("!")
                if self.optional(":"):
                    self.type()
            if self.optional("="):
                self.assignment()
            if not self.optional(","):
                return

    def binding(self) -> None:
        c = self.peek()
        if c == "K":
            self.group("K", "array")
        elif c == "B":
            self.group("B", "object")
        else:
            self.take(IDENTIFIER + "v" if self.typed else IDENTIFIER)

    def function(self, named: bool) -> None:
        self.take("f")
        self.optional("*")
        if named or (self.peek() and self.peek() in IDENTIFIER):
            self.take(IDENTIFIER)
        self.type_parameters()
        self.group("P", "parameters")
        self.returned()
        self.body() if named else self.group("B", "block")

    def returned(self) -> None:
        if self.typed and self.optional(":"):
            self.type()

    def class_(self, named: bool) -> None:
        self.take("c")
        if self.peek() not in ("B", "e", "J"):
            self.take(IDENTIFIER)
        elif named:
            raise Invalid("class without a name")
        self.type_parameters()
        if self.optional("e"):
            self.operand()
            if self.typed and self.peek() == "<":
                self.type_arguments()
        if self.typed and self.optional("J"):
            self.types()
        self.group("B", "class")

    def decorator(self) -> None:
        self.take("@")
        self.take(IDENTIFIER)
        while self.optional("."):
            self.take(_NAME)
        if self.peek() == "P":
            self.group("P", "arguments")

    def import_(self) -> None:
        self.take("m")
        if self.peek() == "v":
            self.take()
            return self.end()
        if self.typed and self.peek() == "H" and self.after() != "i":
            self.take()
        elif self.typed and self.peek() == "H" and self.after() == "i":
            self.take()
        while True:
            c = self.peek()
            if c == "B":
                self.group("B", "names")
            elif c == "*":
                self.take()
                self.take("iZ")
                self.take(IDENTIFIER)
            else:
                self.take(IDENTIFIER)
            if not self.optional(","):
                break
        if self.typed and self.optional("="):
            self.expression()
            return self.end()
        self.take("i")  # from
        self.take("v")
        if not self.at_line_end() and self.optional("i"):
            self.group("B", "object")
        self.end()

    def export(self) -> None:
        self.take("x")
        c = self.peek()
        if c == "d":
            self.take()
            c = self.peek()
            if c == "f" or (c == "A" and self.after() == "f"):
                self.optional("A")
                self.take("f")
                self.optional("*")
                self.optional(IDENTIFIER)
                self.type_parameters()
                self.group("P", "parameters")
                self.returned()
                self.body()
            elif c == "c" or (c == "Q" and self.after() == "c"):
                self.optional("Q")
                self.class_(named=False)
            elif self.typed and c == "G":
                self.statement()
            else:
                self.assignment()
                self.end()
        elif c == "*":
            self.take()
            if self.peek() in "iZ" and self.after(2) == "i":
                self.take()
                self.take(_NAME)
            self.take("i")
            self.take("v")
            self.end()
        elif c == "B" or (self.typed and c == "H" and self.after() == "B"):
            self.optional("H")
            self.group("B", "names")
            if not self.at_line_end() and self.optional("i"):
                self.take("v")
            self.end()
        elif self.typed and c == "=":
            self.take()
            self.expression()
            self.end()
        elif c and c in "lfcA@" or (self.typed and c and c in "GHUMLQ"):
            self.statement()
        else:
            raise Invalid("export")

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.optional(","):
            self.assignment()

    def assignment(self) -> None:
        self.operand()
        while c := self.peek():
            if c in "o+*<>=|":
                self.take()
                if c == ">":
                    while not self.at_line_end() and self.peek() in (">", "=") and self.peek():
                        self.take()
                self.operand()
            elif c == "?":
                self.take()
                self.assignment()
                self.take(":")
                self.assignment()
            elif c == "Z" and self.typed and not self.at_line_end():
                self.take()
                self.optional("l") or self.type()
            elif c == "!" and not self.typed:
                return
            else:
                return

    def arrow(self) -> bool:
        if self.typed and self.peek() == "<":
            self.type_parameters()
        if self.peek() == "P":
            self.group("P", "parameters")
            self.returned()
        else:
            self.take(IDENTIFIER)
        if self.peek() != "R" or self.at_line_end():
            return False
        self.take()
        if self.peek() == "B":
            self.group("B", "block")
        else:
            self.assignment()
        return True

    def operand(self) -> None:
        while (c := self.peek()) and c in "+!#uw":
            if c == "w" and self.after() in ("", ",", ";", ")", ".", "="):
                break
            self.take()
        c = self.peek()
        if c == "Y":
            self.take()
            self.optional("*")
            if self.peek() not in ("", ",", ";", ":") and not self.at_line_end():
                self.assignment()
            return
        if c == "n":
            self.take()
            if self.optional("."):
                self.take(IDENTIFIER)
            else:
                self.operand()
            return self.postfix()
        if c in ("v", "V"):
            self.take()
        elif c == "K":
            self.group("K", "array")
        elif c == "f":
            self.function(named=False)
        elif c == "A" and self.after() == "f":
            self.take()
            self.function(named=False)
        elif c == "A" and self.after() in ("P", "i") and self.attempt(lambda: bool(self.take("A")) and self.arrow()):
            return
        elif c == "c":
            self.class_(named=False)
        elif c in ("P", "<") and self.attempt(self.arrow):
            return
        elif c == "P":
            self.group("P", "expression")
        elif c == "B":
            self.group("B", "object")
        elif c == "m":
            self.take()
            if self.optional("."):
                self.take(IDENTIFIER)
            else:
                self.group("P", "arguments")
        elif c == "<" and self.typed:
            self.type_arguments()
            return self.operand()
        elif c and c in IDENTIFIER:
            if self.after() == "R" and self.attempt(self.arrow):
                return
            self.take()
        elif c == "w":
            self.take()
        else:
            raise Invalid(f"operand {c!r}")
        self.postfix()

    def postfix(self) -> None:
        while c := self.peek():
            if c == ".":
                self.take()
                if self.peek() == "P":
                    self.group("P", "arguments")
                elif self.peek() == "K":
                    self.group("K", "expression")
                else:
                    self.take(_NAME)
            elif c == "P":
                self.group("P", "arguments")
            elif c == "K":
                self.group("K", "expression")
            elif c == "V":
                self.take()
            elif c == "#" and not self.at_line_end():
                self.take()
            elif c == "!" and self.typed and not self.at_line_end():
                self.take()
            elif c == "<" and self.typed and self.attempt(lambda: self.type_arguments() or self.peek() in ("P", "V")):
                continue
            else:
                return

    # types

    def type_parameters(self) -> None:
        if not self.typed or self.peek() != "<":
            return
        self.take("<")
        while True:
            self.optional("lq")
            self.take(IDENTIFIER)
            if self.optional("e"):
                self.type()
            if self.optional("="):
                self.type()
            if not self.optional(",") or self.peek() == ">":
                break
        self.take(">")

    def type_arguments(self) -> None:
        self.take("<")
        self.types()
        self.take(">")

    def types(self) -> None:
        self.type()
        while self.optional(","):
            self.type()

    def type(self) -> None:
        self.optional("|")
        self.single_type()
        while (c := self.peek()) and (c == "|" or (c == "e" and not self.at_line_end())):
            self.take()
            if c == "e":
                self.type()
                self.take("?")
                self.type()
                self.take(":")
                self.type()
            else:
                self.single_type()

    def single_type(self) -> None:
        while (c := self.peek()) == "q" and self.after() not in ("", ",", ";", ":", ">", "="):
            self.take()
        c = self.peek()
        if c == "j":
            self.take()
            c = self.peek()
        if c == "u":
            self.take()
            if self.peek() and self.peek() in IDENTIFIER and not self.at_line_end():
                self.take()
                while self.optional("."):
                    self.take(_NAME)
        elif c == "n" or c == "<" or (c == "P" and self.after() == "R"):
            self.optional("n")
            self.type_parameters()
            self.group("P", "parameters")
            self.take("R")
            return self.type()
        elif c == "P":
            self.group("P", "type")
        elif c == "B":
            self.group("B", "members")
        elif c == "K":
            self.group("K", "tuple")
        elif c in ("v", "V"):
            self.take()
        elif c == "+":
            self.take()
            self.take("v")
        elif c == "m":
            self.take()
            self.group("P", "arguments")
        else:
            self.take(IDENTIFIER)
            while self.optional("."):
                self.take(_NAME)
            if self.peek() == "j" and not self.at_line_end():
                self.take()
                return self.type()
            if self.peek() == "<" and not self.at_line_end():
                self.type_arguments()
        if c == "v" and self.peek() == "j":
            self.take()
            return self.type()
        while self.peek() == "K" and not self.at_line_end():
            self.group("K", "index")

    # bracketed levels

    def items(self, item, holes: bool = False) -> None:
        while self.peek():
            if holes and self.optional(","):
                continue
            item()
            if self.peek():
                self.take(",")

    def argument(self) -> None:
        self.optional("p")
        self.assignment()

    def parameter(self) -> None:
        while self.peek() == "@":
            self.decorator()
        if self.typed:
            while self.peek() in ("X", "q") and self.after() in tuple("iXqBKGHMA"):
                self.take()
        self.optional("p")
        self.binding()
        if self.typed:
            self.optional("?")
            if self.optional(":"):
                self.type()
        if self.optional("="):
            self.assignment()

    def key(self) -> None:
        if self.peek() == "K":
            self.group("K", "key")
        else:
            self.take(_NAME + "v")

    def property(self) -> None:
        if self.optional("p"):
            return self.assignment()
        while (self.peek() == "*") or (self.peek() in ("A", "i") and self.after() and (self.after() in _NAME + "vK*")):
            self.take()
        self.key()
        if self.optional(":") or self.optional("="):
            self.assignment()
        elif self.peek() in ("P", "<"):
            self.type_parameters()
            self.group("P", "parameters")
            self.returned()
            self.group("B", "block")

    def class_member(self) -> None:
        if self.optional(";"):
            return
        while self.peek() == "@":
            self.decorator()
        if self.peek() == "S" and self.after() == "B":
            self.take()
            return self.group("B", "block")
        modifiers = "SA*iXqQL" if self.typed else "SA*i"
        while (c := self.peek()) and c in modifiers and (n := self.after()) and n in _NAME + "vK*" and not (c == "i" and self.s[self.p :].lstrip("N")[1:2] == "N"):
            self.take()
        if self.typed and self.peek() == "K" and self.after() == ":":
            self.group("K", "index")
        else:
            self.key()
        if self.typed and not self.at_line_end():
            self.optional("?!")
        if self.peek() in ("P", "<"):
            self.type_parameters()
            self.group("P", "parameters")
            self.returned()
            self.body()
        else:
            if self.typed and self.optional(":"):
                self.type()
            if self.optional("="):
                self.assignment()
            self.end()

    def type_member(self) -> None:
        if self.optional(";") or self.optional(","):
            return
        while self.peek() in ("q", "X", "i") and self.after() and self.after() in _NAME + "vK" and not self.s[self.p :].lstrip("N")[1:2] == "N":
            self.take()
        if self.peek() in ("P", "<") or (self.peek() == "n" and self.after() == "P"):
            self.optional("n")
            self.type_parameters()
            self.group("P", "parameters")
        else:
            if self.peek() == "K":
                self.group("K", "index")
            elif self.peek() == "+":
                self.take()
                return
            else:
                self.key()
            self.optional("+")
            self.optional("?")
            if self.peek() in ("P", "<"):
                self.type_parameters()
                self.group("P", "parameters")
        if self.optional(":"):
            self.type()
        if self.peek() and self.peek() not in ";," and not self.at_line_end():
            raise Invalid("type member")

    def name(self) -> None:
        if self.typed and self.peek() == "H" and self.after() in tuple(IDENTIFIER):
            self.take()
        self.take(_NAME + "v")
        if self.peek() and self.peek() in "iZ":
            self.take()
            self.take(_NAME + "v")

    def enum_member(self) -> None:
        self.key()
        if self.optional("="):
            self.assignment()

    def switch(self) -> None:
        while c := self.peek():
            if c == "a":
                self.take()
                self.expression()
                self.take(":")
            elif c == "d" and self.after() == ":":
                self.take()
                self.take()
            else:
                self.statement()

    def for_(self) -> None:
        if self.optional("l"):
            self.binding()
            if self.typed and self.optional(":"):
                self.type()
            if self.peek() in ("O", "o"):
                self.take()
                return self.expression()
            if self.optional("="):
                self.assignment()
            if self.optional(","):
                self.declarators()
        elif self.peek() != ";":
            self.expression()
            if self.optional("O"):
                return self.expression()
            if not self.peek():
                return None  # x in y
        self.take(";")
        if self.peek() != ";":
            self.expression()
        self.take(";")
        if self.peek():
            self.expression()
        return None


def _parse(role: str, text: str, typed: bool) -> list[str]:
    c = _Level(text, typed)
    if role == "block":
        c.statements()
    elif role in ("expression", "key"):
        c.expression()
    elif role == "arguments":
        c.items(c.argument)
    elif role == "array":
        c.items(c.argument, holes=True)
    elif role == "parameters":
        c.items(c.parameter)
    elif role == "object":
        c.items(c.property)
    elif role == "class":
        while c.peek():
            c.class_member()
    elif role == "members":
        while c.peek():
            c.type_member()
    elif role == "names":
        c.items(c.name)
    elif role == "enum":
        c.items(c.enum_member)
    elif role == "switch":
        c.switch()
    elif role == "for":
        c.for_()
    elif role == "type":
        c.type()
    elif role == "tuple":
        c.items(lambda: (c.optional("p"), c.optional("?"), c.type(), c.optional("?"), c.optional(":") and c.type()))
    elif role == "index" and c.peek():
        if c.after() in (":", "o"):
            c.take(IDENTIFIER)
            c.take(":o")
        c.type()
    if c.peek():
        raise Invalid(f"{c.peek()!r} is left")
    return c.roles


_SCRIPT = Levels(lambda role, text: _parse(role, text, typed=False))
_TYPED_SCRIPT = Levels(lambda role, text: _parse(role, text, typed=True))


def javascript(text: str) -> None:
    _SCRIPT.check(lex(text, typed=False), "block")


def typescript(text: str) -> None:
    _TYPED_SCRIPT.check(lex(text, typed=True), "block")
