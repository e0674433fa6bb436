"""Trigram queries derived from regular expressions, and postings over chunks of text.

A regular expression that matches a text forces certain trigrams to occur in it. ``required`` derives them from the parsed
expression as an and/or query; a ``Postings`` index answers such queries for the chunks of one batch by intersecting and
uniting lists of chunk numbers. Expressions and texts are compared in lower case, so that the index serves both kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np

_parser = re._parser  # the standard library's own parser of regular expressions
_MOST_STRINGS = 48

ANY = ("any",)  # every text


def _and(parts: Iterable[tuple]) -> tuple:
    flat: set = set()
    for part in parts:
        flat |= set(part[1]) if part[0] == "and" else set() if part == ANY else {part}
    return ANY if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _or(parts: Iterable[tuple]) -> tuple:
    flat: set = set()
    for part in parts:
        if part == ANY:
            return ANY
        flat |= set(part[1]) if part[0] == "or" else {part}
    sets = {part: part[1] if part[0] == "and" else frozenset({part}) for part in flat}
    least = {part for part, own in sets.items() if not any(other < own for other in sets.values())}  # the others are implied
    return next(iter(least)) if len(least) == 1 else ("or", frozenset(least))


def _of_strings(strings: set[str]) -> tuple:
    """What one of ``strings`` within a text requires."""
    return _or(_and(("tri", s[i : i + 3]) for i in range(len(s) - 2)) for s in strings) if strings else ANY


def _walk(nodes: Sequence) -> tuple[set[str] | None, tuple]:
    """``(all strings that the nodes can match, or None if there are too many; query)``."""
    exact: set[str] = {""}
    whole = True
    queries: list[tuple] = []

    def flush() -> None:
        nonlocal exact, whole
        queries.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, arg in nodes:
        name = str(op)
        strings: set[str] | None = None
        query = ANY
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            chars: set[str] = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    chars = set()
                    break
            strings = chars if 0 < len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            strings, query = _walk(arg[3])
        elif name == "BRANCH":
            found = [_walk(branch) for branch in arg[1]]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= _MOST_STRINGS:
                strings = set().union(*(s for s, _ in found))
            query = _or(_and([q, _of_strings(s)]) if s is not None else q for s, q in found)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            s, q = _walk(inner)
            if low == 0 and high == 1 and s is not None:
                strings = s | {""}
            elif low >= 1:
                if s is not None and low == high and len(s) ** low <= _MOST_STRINGS:
                    strings = {""}
                    for _ in range(low):
                        strings = {a + b for a in strings for b in s}
                else:
                    query = _and([q, _of_strings(s)]) if s is not None else q
        elif name == "AT" or name.startswith("ASSERT"):
            continue  # takes no text
        if strings is not None and len(exact) * len(strings) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            queries.append(query)
        else:
            flush()
            queries.append(query if strings is None else _and([query, _of_strings(strings)]))
            if strings is not None and len(strings) <= _MOST_STRINGS:
                exact = set(strings)
    return (exact if whole else None), _and([*queries, _of_strings(exact)])


def required(pattern: str) -> tuple:
    """The trigram query that every lower-cased match of ``pattern`` satisfies."""
    return _walk(list(_parser.parse(pattern)))[1]


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_of(part) for part in query[1])) if query[0] in ("and", "or") else set()


class Vocabulary:
    """The trigrams that some query needs; only these have postings."""

    def __init__(self, queries: Iterable[tuple]):
        self.trigrams = sorted({t for q in queries for t in trigrams_of(q) if t.isascii()})
        self.number = {t: i for i, t in enumerate(self.trigrams)}
        self.slot = np.zeros(1 << 21, dtype=np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.slot[a << 14 | b << 7 | c] = i + 1


class Postings:
    """Postings of one batch of chunks: for each trigram of the vocabulary the sorted numbers of the chunks that hold it."""

    def __init__(self, vocabulary: Vocabulary, chunks: Sequence[str]):
        self.vocabulary, self.n = vocabulary, len(chunks)
        joined = "\0".join(chunk.replace("\0", " ") for chunk in chunks).lower()
        raw = np.frombuffer(joined.encode("ascii", "replace"), dtype=np.uint8)  # one byte a character; others become '?'
        starts = np.flatnonzero(raw == 0)
        code = raw.astype(np.int32)
        found = vocabulary.slot[code[:-2] << 14 | code[1:-1] << 7 | code[2:]] if len(raw) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(found)
        chunk = np.searchsorted(starts, at)
        pairs = np.unique((found[at].astype(np.int64) - 1) << 32 | chunk)
        numbers = pairs >> 32
        edges = np.searchsorted(numbers, np.arange(len(vocabulary.trigrams) + 1))
        self.lists = [pairs[edges[i] : edges[i + 1]] & 0xFFFFFFFF for i in range(len(vocabulary.trigrams))]

    def candidates(self, query: tuple) -> np.ndarray:
        """Sorted numbers of the chunks that satisfy ``query``."""
        if query[0] == "any":
            return np.arange(self.n)
        if query[0] == "tri":
            number = self.vocabulary.number.get(query[1])
            return np.arange(self.n) if number is None else self.lists[number]
        parts = [self.candidates(part) for part in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for part in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, part, assume_unique=True)
        return out
