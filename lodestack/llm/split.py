"""Oversized texts cut into pieces at natural boundaries (problem 6).

Atomic segments are lines, and words of lines that alone exceed the limit. Adjacent segments lie in a heap ordered by the
strength of the boundary between them; the weakest boundary whose two sides still fit together goes first. What is left
when nothing fits any more are the pieces, whose boundaries are the strongest ones.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a boundary by what the line after it begins.
HEADING, FUNCTION, PARAGRAPH, LINE, WORD, CHARACTER = 5, 4, 3, 2, 1, 0
_HEADING = re.compile(r" {0,3}#{1,6}\s+\S")
_FUNCTION = re.compile(
    r"\s*(?:(?:export|default|public|private|protected|static|final|abstract|async|declare)\s+)*(?:def|class|function|interface|enum|namespace|module)\b"
    r"|\s*(?:export\s+)?(?:const|let|var)\s+\w+.*=>\s*\{\s*$|\s*(?:(?:public|private|protected|static|final|abstract|async)\s+)+[\w<>\[\], ]+\(|[\w-]+\s*\(\)\s*\{|@\w|\[[^\]\n]+\]\s*$"
)
_WORDS = re.compile(r"\S+\s*|\s+")
_LINES = re.compile(r"[^\n]*\n|[^\n]+")


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def atoms(text: str, most_chars: int, most_bytes: int, widest: int) -> list[tuple[int, int]]:
    """``(start, strength of the boundary before it)`` of every atomic segment; no character takes more than ``widest`` bytes."""
    out: list[tuple[int, int]] = []
    at, blank = 0, False
    step = max(1, min(most_chars, most_bytes // widest))
    for line in _LINES.findall(text):
        strength = HEADING if _HEADING.match(line) else FUNCTION if _FUNCTION.match(line) else PARAGRAPH if blank else LINE
        blank = not line.strip()
        if len(line) <= step or (len(line) <= most_chars and _bytes(line) <= most_bytes):
            out.append((at, strength))
        else:
            begin = len(out)
            for word in _WORDS.finditer(line):
                out += [(at + i, CHARACTER if i > word.start() else WORD) for i in range(word.start(), word.end(), step)]
            out[begin] = (at, strength)
        at += len(line)
    return out


def split_text(text: str, max_chars: int | None, max_bytes: int | None, overlap: int | None) -> list[tuple[int, int, int]]:
    """``(first new character, end, repeated characters before it)`` of each piece, in order.

    A null limit is no limit; a limit under one character counts as one character (in bytes: the text's widest). A text
    within its limits is one piece. Each piece but the first repeats ``overlap`` characters of the piece before, or all of a
    shorter one; only where limit and overlap leave no room for a new character is the overlap shorter by what that needs.
    """
    size, ascii_only = len(text), text.isascii()
    offset = None if ascii_only else list(accumulate(map(_bytes, text), initial=0))
    total = size if ascii_only else offset[-1]
    chars = size if max_chars is None else max(1, max_chars)
    widest = 1 if ascii_only else _bytes(max(text))
    most = total if max_bytes is None else max(widest, max_bytes)
    if size <= chars and total <= most:
        return [(0, size, 0)]
    repeat = max(0, min(overlap or 0, chars - 1))
    room = total if max_bytes is None else most - widest  # bytes that an overlap may take
    if ascii_only:
        repeat = min(repeat, room)

    def first(start: int) -> int:
        return max(0, start - repeat) if ascii_only else max(0, start - repeat, bisect_left(offset, offset[start] - room))

    def fits(start: int, end: int) -> bool:
        begin = first(start)
        return end - begin <= chars and (end - begin if ascii_only else offset[end] - offset[begin]) <= most

    parts = atoms(text, chars - repeat, most - min(room, repeat * widest), widest)
    starts = [start for start, _ in parts]
    strength = [s for _, s in parts]
    n = len(parts)
    ends = [*starts[1:], size]
    before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(strength[j], ends[j] - starts[j - 1], j) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, length, right = heapq.heappop(heap)
        left = before[right] if alive[right] else -1
        if left < 0 or length != ends[right] - starts[left] or not fits(starts[left], ends[right]):
            continue  # gone, outgrown (it was put back with its new size), or too large for ever
        alive[right] = False
        ends[left] = ends[right]
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        for j in (left, after[left]):
            if j > 0 and before[j] >= 0:
                heapq.heappush(heap, (strength[j], ends[j] - starts[before[j]], j))
    out, previous = [], 0
    for j in range(n):
        if alive[j]:
            begin = max(previous, first(starts[j])) if out else 0
            out.append((starts[j], ends[j], starts[j] - begin))
            previous = begin
    return out


PIECE = "entry_id long, export_id long, piece_no int, n_pieces int, start_char long, overlap_chars int, n_chars int, n_bytes int, piece string"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            limits = [None if pd.isna(x) else int(x) for x in (row.split_max_chars, row.max_export_bytes, row.split_overlap_chars)]
            cuts = split_text(row.content, *limits)
            out = []
            for k, (start, end, repeated) in enumerate(cuts):
                piece = row.content[start - repeated : end]
                out.append((row.entry_id, row.export_id, k + 1, len(cuts), start, repeated, len(piece), len(piece.encode("utf-8", "surrogatepass")), piece))
            yield pd.DataFrame(out, columns=["entry_id", "export_id", "piece_no", "n_pieces", "start_char", "overlap_chars", "n_chars", "n_bytes", "piece"])


def split_oversized(entries: DataFrame, exports: DataFrame) -> DataFrame:
    """The pieces of every entry whose content exceeds ``split_max_chars`` or ``max_export_bytes`` of its export.

    Repeated rows of one entry_id are one entry; entries without id, without content, within their limits or without export give
    no row. Null limits are none. Two steps keep the texts out of needless shuffles: a text no longer than the least limit
    of all exports is dropped where it is read, and the limits are joined afterwards.
    """
    limits = exports.select("export_id", "split_max_chars", "max_export_bytes", "split_overlap_chars").where("split_max_chars is not null or max_export_bytes is not null").dropDuplicates(["export_id"])
    least = limits.agg(F.min("split_max_chars"), F.min("max_export_bytes")).first()  # two numbers
    texts = entries.where("entry_id is not null and content is not null").select("entry_id", "export_id", "content", F.length("content").alias("chars"), F.octet_length("content").alias("bytes"))
    above = [F.col(c) > limit for c, limit in zip(("chars", "bytes"), least, strict=True) if limit is not None]
    large = texts.where(above[0] | above[-1] if above else F.lit(False))
    over = large.join(limits, "export_id").where("chars > split_max_chars or bytes > max_export_bytes").dropDuplicates(["entry_id"])
    wanted = over.select("entry_id", "export_id", "content", "split_max_chars", "max_export_bytes", "split_overlap_chars")
    return wanted.mapInPandas(_pieces, PIECE)
