"""Java compilation units."""

from __future__ import annotations

import re

from lodestack.llm.grammar.brackets import CLOSE, GROUP, Cursor, Invalid, Levels, Node

_WORDS = {
    "package": "k", "import": "m", "class": "c", "interface": "G", "enum": "U", "record": "Q", "extends": "e", "implements": "J", "permits": "J",
    "throws": "T", "throw": "h", "return": "r", "if": "I", "else": "E", "for": "F", "while": "W", "do": "D", "try": "t", "catch": "C",
    "finally": "y", "switch": "s", "case": "a", "default": "d", "break": "b", "continue": "b", "new": "n", "instanceof": "w", "yield": "Y",
    "this": "v", "super": "v", "null": "v", "true": "v", "false": "v", "assert": "A", "synchronized": "z", "static": "S", "var": "i",
    **dict.fromkeys("public private protected final abstract native transient volatile strictfp sealed".split(), "X"),
    **dict.fromkeys("int long short byte char boolean float double void".split(), "p"),
    **dict.fromkeys("const goto".split(), "!!"),
}
_TOKEN = re.compile(
    r"""(?:\s+|//[^\n\r]*|/\*[\s\S]*?\*/)*(?:(?P<w>(?:[^\W\d]|\$)(?:\w|\$)*)
    |(?P<v>\"{3}[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?\"{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))'|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w))
    |(?P<u>/\*)
    |(?P<b>[(\[{])|(?P<e>[)\]}])
    |(?P<o>->|::|\.{3}|\+\+|--|&&|\|\||<<=?|[=!<]=|[+\-*/%&|^]=|[;,.:?@=<>+\-*/%&|^!~])
    |(?P<end>\Z))""",
    re.VERBOSE,
)
_PUNCT = {"->": "R", "::": "O", "...": "P3", "++": "#", "--": "#", "+": "+", "-": "+", "!": "!", "~": "!", "==": "o", "!=": "o", "<=": "o", "&": "&", "*": "*", "<<": "o"}
IDENTIFIER = "iQY"


class _Classes(dict):
    """The class of each operator."""

    def __missing__(self, op: str) -> str:
        self[op] = op if op in ";,.:?@=<>" else "_" if op == "..." else "=" if op[-1] == "=" and op not in _PUNCT else _PUNCT.get(op, "o")
        return self[op]


_CLASSES = _Classes()


def lex(text: str) -> Node:
    root = Node("")
    stack, tokens, at = [root], root.tokens, 0
    for m in iter(_TOKEN.scanner(text).match, None):
        kind = m.lastgroup
        if kind == "w":
            tokens.append(_WORDS.get(m[1], "i"))
        elif kind == "v":
            tokens.append("v")
        elif kind == "o":
            tokens.append(_CLASSES[m["o"]])
        elif kind == "b":
            tokens.append(GROUP[m["b"]])
            node = Node(CLOSE[m["b"]])
            stack[-1].children.append(node)
            stack.append(node)
            tokens = node.tokens
        elif kind == "e":
            if stack[-1].close != m["e"]:
                raise Invalid(f"unexpected {m['e']}")
            stack.pop()
            tokens = stack[-1].tokens
        elif kind == "u":
            raise Invalid("a comment without an end")
        at = m.end()
        if kind == "end":
            break
    if at != len(text):
        raise Invalid(f"no token at {at}")
    if len(stack) > 1:
        raise Invalid(f"{stack[-1].close} is missing")
    return root


class _Level(Cursor):
    # names and types

    def qualified(self) -> None:
        self.take(IDENTIFIER)
        while self.peek() == "." and self.after() in tuple(IDENTIFIER):
            self.take()
            self.take()

    def annotations(self, modifiers: str = "") -> None:
        while c := self.peek():
            if c == "@" and self.after() != "G":
                self.take()
                self.qualified()
                if self.peek() == "P":
                    self.group("P", "annotation")
            elif c in modifiers and not (c == "d" and self.after() in (":", "R")):
                self.take()
                if c == "i":  # non-sealed
                    return
            else:
                return

    def type(self) -> None:
        self.annotations()
        if not self.optional("p"):
            self.qualified()
            if self.peek() == "<":
                self.type_arguments()
                while self.peek() == "." and self.after() in tuple(IDENTIFIER):
                    self.take()
                    self.qualified()
                    if self.peek() == "<":
                        self.type_arguments()
        while self.peek() == "K":
            self.group("K", "empty")

    def types(self) -> None:
        self.type()
        while self.optional(",&"):
            self.type()

    def type_arguments(self) -> None:
        self.take("<")
        while self.peek() != ">":
            self.annotations()
            if self.optional("?"):
                if self.optional("ev"):
                    self.types_and()
            else:
                self.type()
                if self.optional("e"):
                    self.types_and()
            if not self.optional(","):
                break
        self.take(">")

    def types_and(self) -> None:
        self.type()
        while self.optional("&"):
            self.type()

    # declarations

    def unit(self) -> None:
        self.annotations()
        if self.optional("k"):
            self.qualified()
            self.take(";")
        while self.peek() == "m" or self.peek() == ";":
            if self.take() == "m":
                self.optional("S")
                self.qualified()
                if self.optional("."):
                    self.take("*")
                self.take(";")
        while self.peek():
            if not self.optional(";"):
                self.annotations("XS")
                self.declaration()

    def declaration(self) -> None:
        c = self.take("cGUQ@")
        if c == "@":
            self.take("G")
        self.take(IDENTIFIER)
        if self.peek() == "<":
            self.type_arguments()
        if c == "Q":
            self.group("P", "parameters")
        while self.optional("eJ"):
            self.types()
        self.group("B", "enum" if c == "U" else "class")

    def is_declaration(self) -> bool:
        c = self.peek()
        return c in ("c", "G", "U") or (c == "@" and self.after() == "G") or (c == "Q" and self.after() in tuple(IDENTIFIER) and self.after(2) in ("P", "<"))

    def member(self) -> None:
        if self.optional(";"):
            return
        if self.peek() == "B" or (self.peek() == "S" and self.after() == "B"):
            self.optional("S")
            return self.group("B", "block")
        self.annotations("XSdz")
        if self.is_declaration():
            return self.declaration()
        if self.peek() == "<":
            self.type_arguments()
            self.annotations()
        if self.peek() in tuple(IDENTIFIER) and self.after() in ("P", "B"):
            self.take()  # constructor
            if self.peek() == "P":
                self.group("P", "parameters")
            if self.optional("T"):
                self.types()
            return self.group("B", "block")
        self.type()
        if self.after() == "P":
            self.take(IDENTIFIER)
            self.group("P", "parameters")
            while self.peek() == "K":
                self.group("K", "empty")
            if self.optional("T"):
                self.types()
            if self.optional("d"):
                self.initializer()
            if not self.optional(";"):
                self.group("B", "block")
            return
        self.declarators()
        self.take(";")

    def initializer(self) -> None:
        if self.peek() == "B":
            self.group("B", "values")
        else:
            self.assignment()

    def declarators(self) -> None:
        while True:
            self.take(IDENTIFIER)
            while self.peek() == "K":
                self.group("K", "empty")
            if self.optional("="):
                self.initializer()
            if not self.optional(","):
                return

    def enum(self) -> None:
        while self.peek() and self.peek() != ";":
            self.annotations()
            self.take(IDENTIFIER)
            if self.peek() == "P":
                self.group("P", "arguments")
            if self.peek() == "B":
                self.group("B", "class")
            if not self.optional(","):
                break
        if self.optional(";"):
            while self.peek():
                self.member()

    def parameter(self) -> None:
        self.annotations("X")
        self.type()
        self.optional("_")
        if not self.optional("v"):
            self.take(IDENTIFIER)
        while self.peek() == "K":
            self.group("K", "empty")

    # statements

    def local(self) -> bool:
        self.annotations("X")
        self.type()
        if self.peek() not in tuple(IDENTIFIER) or self.after() not in ("=", ";", ",", ":", "K", ""):
            return False
        self.declarators()
        return True

    def statement(self) -> None:
        c = self.peek()
        if c == ";":
            self.take()
        elif c == "B":
            self.group("B", "block")
        elif c in "IW" and c:
            self.take()
            self.group("P", "expression")
            self.statement()
            if c == "I" and self.optional("E"):
                self.statement()
        elif c == "F":
            self.take()
            self.group("P", "for")
            self.statement()
        elif c == "D":
            self.take()
            self.statement()
            self.take("W")
            self.group("P", "expression")
            self.take(";")
        elif c == "t":
            self.take()
            resources = self.peek() == "P"
            if resources:
                self.group("P", "resources")
            self.group("B", "block")
            n = 0
            while self.optional("C"):
                self.group("P", "caught")
                self.group("B", "block")
                n += 1
            if self.optional("y"):
                self.group("B", "block")
            elif not n and not resources:
                raise Invalid("try alone")
        elif c == "s" and self.after(2) == "B":
            self.take()
            self.group("P", "expression")
            self.group("B", "switch")
        elif c == "z" and self.after() == "P":
            self.take()
            self.group("P", "expression")
            self.group("B", "block")
        elif c == "r":
            self.take()
            if self.peek() != ";":
                self.expression()
            self.take(";")
        elif c in ("h", "A") or (c == "Y" and self.after() not in ("=", ".", "P", "#")):
            self.take()
            self.expression()
            if c == "A" and self.optional(":"):
                self.expression()
            self.take(";")
        elif c == "b":
            self.take()
            self.optional(IDENTIFIER)
            self.take(";")
        elif c in tuple(IDENTIFIER) and self.after() == ":":
            self.take()
            self.take()
            self.statement()
        elif self.is_declaration():
            self.declaration()
        elif c in ("X", "S") or (c == "@"):
            self.annotations("XS")
            if self.is_declaration():
                self.declaration()
            else:
                if not self.local():
                    raise Invalid("local variable")
                self.take(";")
        elif self.attempt(self.local):
            self.take(";")
        else:
            self.expression()
            self.take(";")

    def switch(self) -> None:
        while c := self.peek():
            if c == "a" or (c == "d" and self.after() in (":", "R")):
                self.take()
                if c == "a":
                    self.case_label()
                    while self.optional(","):
                        self.case_label()
                if self.take(":R") == "R":
                    self.statement()
            else:
                self.statement()

    def case_label(self) -> None:
        if not self.optional("d") and not self.attempt(self.pattern):
            self.assignment(arrow=False)

    def pattern(self) -> bool:
        self.annotations("X")
        self.type()
        if self.peek() == "P":
            self.group("P", "patterns")
            self.optional(IDENTIFIER)
        else:
            self.take(IDENTIFIER)
        return self.peek() in (":", "R", ",", "i", "")

    def for_(self) -> None:
        if self.peek() != ";" and not self.attempt(self.local):
            self.expression()
        if self.optional(":"):
            return self.expression()
        self.take(";")
        if self.peek() != ";":
            self.expression()
        self.take(";")
        if self.peek():
            self.expression()
        return None

    # expressions

    def expression(self) -> None:
        self.assignment()
        while self.optional(","):
            self.assignment()

    def assignment(self, arrow: bool = True) -> None:
        self.operand(arrow)
        while c := self.peek():
            if c in "o+*<>=&":
                self.take()
                if c == ">":
                    while self.peek() in (">", "=") and self.peek():
                        self.take()
                self.operand(arrow)
            elif c == "w":
                self.take()
                self.annotations("X")
                self.type()
                if self.peek() == "P":
                    self.group("P", "patterns")
                self.optional(IDENTIFIER)
            elif c == "?":
                self.take()
                self.assignment()
                self.take(":")
                self.assignment(arrow)
            else:
                return

    def lambda_(self, role: str) -> bool:
        if role == "P":
            self.group("P", "lambda")
        else:
            self.take(IDENTIFIER)
        self.take("R")
        if self.peek() == "B":
            self.group("B", "block")
        else:
            self.assignment()
        return True

    def operand(self, arrow: bool = True) -> None:
        while self.optional("+!#"):
            pass
        c = self.peek()
        if c == "P" and arrow and self.after() == "R":
            self.lambda_("P")
            return
        if c in tuple(IDENTIFIER) and arrow and self.after() == "R":
            self.lambda_("i")
            return
        if c == "P":
            cast = self.after() in tuple("iQvPn!s")
            self.group("P", "cast" if cast else "expression")
            if cast:
                return self.operand(arrow)
        elif c == "n":
            self.take()
            self.annotations()
            if not self.optional("p"):
                self.qualified()
                if self.peek() == "<":
                    self.type_arguments()
            if self.peek() == "P":
                self.group("P", "arguments")
                if self.peek() == "B":
                    self.group("B", "class")
            else:
                n = 0
                while self.peek() == "K":
                    self.group("K", "size")
                    n += 1
                if self.peek() == "B":
                    self.group("B", "values")
                if not n:
                    raise Invalid("new")
        elif c == "s":
            self.take()
            self.group("P", "expression")
            self.group("B", "switch")
        elif c == "p":
            self.type()
            if self.peek() == ".":
                self.take(".")
                self.take("c")
            else:
                self.take("O")
                self.take(IDENTIFIER + "n")
        elif c == "v" or c in tuple(IDENTIFIER):
            self.take()
            if c != "v" and self.peek() in ("<", "K"):
                self.attempt(self.reference)
        else:
            raise Invalid(f"operand {c!r}")
        self.postfix()

    def reference(self) -> bool:
        if self.peek() == "<":
            self.type_arguments()
        while self.peek() == "K":
            self.group("K", "empty")
        return self.peek() == "O" or (self.peek() == "." and self.after() == "c")

    def postfix(self) -> None:
        while c := self.peek():
            if c == ".":
                self.take()
                if self.peek() == "<":
                    self.type_arguments()
                if self.peek() == "n":
                    return self.operand()
                self.take(IDENTIFIER + "vc")
            elif c == "P":
                self.group("P", "arguments")
            elif c == "K":
                self.group("K", "expression")
            elif c == "O":
                self.take()
                self.take(IDENTIFIER + "n")
            elif c == "#":
                self.take()
            else:
                return

    def items(self, item, separators: str = ",") -> None:
        while self.peek():
            item()
            if self.peek():
                self.take(separators)
                if not self.peek() and "," in separators and len(separators) == 1 and item in (self.assignment, self.parameter):
                    raise Invalid("trailing comma")


def _parse(role: str, text: str) -> list[str]:
    c = _Level(text)
    if role == "unit":
        c.unit()
    elif role == "class":
        while c.peek():
            c.member()
    elif role == "enum":
        c.enum()
    elif role == "block":
        while c.peek():
            c.statement()
    elif role in ("expression", "size"):
        if role == "expression" or c.peek():
            c.expression()
    elif role == "cast":
        if not c.attempt(lambda: (c.types_and(), not c.peek())[1]):
            c.expression()
    elif role == "arguments":
        c.items(c.assignment)
    elif role == "annotation":
        c.items(lambda: c.group("B", "values") if c.peek() == "B" else (c.take(IDENTIFIER), c.take("="), c.annotations() if c.peek() == "@" else c.initializer()) if c.after() == "=" else c.annotations() if c.peek() == "@" else c.assignment())
    elif role == "values":
        c.items(lambda: c.annotations() if c.peek() == "@" else c.initializer())
    elif role == "parameters":
        c.items(c.parameter)
    elif role == "lambda":
        if not c.attempt(lambda: (c.items(c.parameter), True)[1]):
            c.items(lambda: c.take(IDENTIFIER))
    elif role == "patterns":
        c.items(lambda: (c.annotations("X"), c.type(), c.group("P", "patterns") if c.peek() == "P" else c.take(IDENTIFIER)))
    elif role == "caught":
        c.annotations("X")
        c.type()
        while c.optional("o"):
            c.type()
        c.take(IDENTIFIER)
    elif role == "resources":
        c.items(lambda: c.attempt(c.local) or c.assignment(), ";")
    elif role == "switch":
        c.switch()
    elif role == "for":
        c.for_()
    if c.peek():
        raise Invalid(f"{c.peek()!r} is left")
    return c.roles


_UNIT = Levels(_parse)


def java(text: str) -> None:
    _UNIT.check(lex(text), "unit")
