"""Token counts under a unigram vocabulary: a double-array trie and a Viterbi pass that keeps counts only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class DoubleArrayTrie:
    """Keys are sequences of symbols; ``base``/``check`` hold the transitions, ``score`` the score of the key that ends at a state."""

    def __init__(self, scored: Iterable[tuple[str, float]]):
        tree: dict = {}
        alphabet: set[str] = set()
        for key, score in scored:
            node = tree
            for symbol in key:
                alphabet.add(symbol)
                node = node.setdefault(symbol, {})
            if key:
                node[None] = max(score, node.get(None, -np.inf))
        self.code = {symbol: i + 1 for i, symbol in enumerate(sorted(alphabet))}
        self.base, self.check, self.score = [0], [0], [np.nan]
        taken, lowest = bytearray(b"\x01"), 1  # slots in use, and where the search for free ones begins
        queue = [(0, tree)]
        while queue:
            state, node = queue.pop()
            if None in node:
                self.score[state] = node[None]
            codes = sorted(self.code[symbol] for symbol in node if symbol is not None)
            if not codes:
                continue
            at, met, first = max(codes[0] + 1, lowest) - 1, 0, True
            while True:
                at += 1
                base = at - codes[0]
                if len(taken) <= base + codes[-1]:
                    taken.extend(bytes(max(1024, base + codes[-1] + 1 - len(taken))))
                if taken[at]:
                    met += 1
                    continue
                if first:
                    lowest, first = at, False
                if not any(taken[base + c] for c in codes):
                    break
            if met >= 0.95 * (at - lowest + 1):  # a crowded stretch isn't searched again
                lowest = at
            self._grow(base + codes[-1] + 1)
            self.base[state] = base
            for symbol, child in node.items():
                if symbol is not None:
                    slot = base + self.code[symbol]
                    taken[slot] = 1
                    self.check[slot] = state + 1  # 0 marks a free slot
                    queue.append((slot, child))

    def _grow(self, size: int) -> None:
        if (more := size - len(self.base)) > 0:
            self.base += [0] * more
            self.check += [0] * more
            self.score += [np.nan] * more

    def matches(self, codes: list[int], start: int):
        """``(end, score)`` of every key that begins at ``start`` of the coded text (code 0 is outside the alphabet)."""
        state, base, check, score = 0, self.base, self.check, self.score
        for end in range(start, len(codes)):
            code = codes[end]
            slot = base[state] + code
            if not code or not base[state] or slot >= len(check) or check[slot] != state + 1:
                return
            state = slot
            if score[state] == score[state]:
                yield end + 1, score[state]


class UnigramCounter:
    """Counts the pieces on the best path of a text.

    ``normalize`` maps a text to its normalized form, ``segments`` cuts that into pieces that no token crosses. Of equal
    paths the one with fewer pieces counts. A symbol outside the vocabulary is one piece at ``unknown`` (by default ten
    below the least score). Counts of segments are remembered in a table of bounded size.
    """

    def __init__(self, scored: Iterable[tuple[str, float]], unknown: float | None = None, normalize: Callable[[str], str] | None = None, segments: Callable[[str], Iterable[str]] | None = None, remember: int = 200_000):
        scored = list(scored)
        self.trie = DoubleArrayTrie(scored)
        self.unknown = unknown if unknown is not None else min((s for _, s in scored), default=0.0) - 10.0
        self.normalize, self.segments, self.remember = normalize or (lambda text: text), segments or (lambda text: (text,)), remember
        self.known: dict[str, int] = {}

    def best_counts(self, segment: str) -> list[int]:
        """Pieces on the best path of every prefix of ``segment``: one forward pass, no back pointers."""
        code = self.trie.code
        codes = [code.get(symbol, 0) for symbol in segment]
        best, count = [0.0] + [-np.inf] * len(codes), [0] * (len(codes) + 1)
        for at in range(len(codes)):
            here, pieces, single = best[at], count[at] + 1, False
            for end, score in self.trie.matches(codes, at):
                single |= end == at + 1
                total = here + score
                if total > best[end] or (total == best[end] and pieces < count[end]):
                    best[end], count[end] = total, pieces
            if not single and here + self.unknown > best[at + 1]:
                best[at + 1], count[at + 1] = here + self.unknown, pieces
        return count

    def count(self, text: str | None) -> int | None:
        """Null for null, 0 for an empty text."""
        if text is None:
            return None
        total = 0
        for segment in self.segments(self.normalize(text)):
            n = self.known.get(segment)
            if n is None:
                if len(self.known) >= self.remember:
                    self.known.clear()
                n = self.known[segment] = self.best_counts(segment)[-1]
            total += n
        return total


class BatchCounter:
    """``UnigramCounter`` over many texts at once: every text is normalized, matched by the trie at each position and passed through by Viterbi.

    The trie is walked from all positions of a slice together; the forward pass goes over texts of like length in step and
    keeps scores and counts of the last ``longest`` positions only. Segments are whole texts. Where few texts are left, and in
    texts longer than a slice, the pass goes on text by text over stretches of ``STRETCH`` positions, so that memory is bounded.
    """

    SLICE, STRETCH, NARROW = 1 << 21, 1 << 16, 12

    def __init__(self, counter: UnigramCounter):
        trie = counter.trie
        self.normalize, self.unknown = counter.normalize, counter.unknown
        # a last state without transitions stands for the texts that left the trie; no slot lies beyond the tables
        rest = max(trie.code.values(), default=0) + 1
        self.base, self.check = np.array([*trie.base, 0], np.int32), np.array([*trie.check, *[0] * rest], np.int32)
        self.score, self.nowhere = np.array([*trie.score, np.nan]), np.int32(len(trie.base))
        self.score[np.isnan(self.score)] = -np.inf
        symbols = sorted((ord(symbol), code) for symbol, code in trie.code.items())
        self.points, self.codes = np.array([p for p, _ in symbols], np.uint32), np.array([c for _, c in symbols], np.int32)
        depth = {0: 0}
        while deeper := {int(s): depth[int(self.check[s]) - 1] + 1 for s in np.flatnonzero(self.check) if int(s) not in depth and int(self.check[s]) - 1 in depth}:
            depth |= deeper
        self.longest = max(1, *depth.values())

    def coded(self, text: str) -> np.ndarray:
        """The codes of the normalized text, 0 outside the alphabet."""
        points = np.frombuffer(self.normalize(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.points):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.codes[at], 0)

    def matched(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Row ``d`` has the score of the key of ``d + 1`` symbols that begins at each of the first ``size`` positions, or none; a single unknown symbol is a key."""
        out = np.empty((self.longest, size))
        ahead, state = np.concatenate([codes, np.zeros(self.longest, np.int32)]), np.zeros(size, np.int32)
        for d in range(self.longest):
            slot = self.base[state] + ahead[d : d + size]
            state = np.where(self.check[slot] == state + 1, slot, self.nowhere)
            out[d] = self.score[state]
        out[0, np.isneginf(out[0])] = self.unknown
        return out

    def _on(self, codes: np.ndarray, begin: int, held: list[tuple[float, int]]) -> int:
        """The count of a text of which ``held`` are the last (score, count) up to position ``begin``."""
        for start in range(begin, len(codes), self.STRETCH):
            low = max(0, start - self.longest + 1)
            stop = min(start + self.STRETCH, len(codes))
            scores = self.matched(codes[low : stop + self.longest], stop - low).T.tolist()
            for end in range(start + 1, stop + 1):
                best, count = -np.inf, 0
                for size in range(1, min(len(held), self.longest) + 1):
                    before, n = held[-size]
                    total = before + scores[end - size - low][size - 1]
                    if total > best or (total == best and n + 1 < count):
                        best, count = total, n + 1
                held.append((best, count))
                if len(held) > self.longest:
                    del held[0]
        return held[-1][1]

    def _together(self, texts: list[np.ndarray]) -> list[int]:
        """The counts of texts that come longest first."""
        lengths = np.array([len(t) for t in texts])
        apart = np.zeros(1, np.int32)  # a code that no key goes over
        starts = np.cumsum(lengths + 1) - lengths - 1
        flat = np.concatenate([part for t in texts for part in (t, apart)])
        scores, ring = self.matched(flat, len(flat)), self.longest + 1
        best, counts = np.full((ring, len(texts)), -np.inf), np.zeros((ring, len(texts)), np.int64)
        best[0] = 0
        out = np.zeros(len(texts), np.int64)
        active = len(texts) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1))
        for end in range(1, lengths[0] + 1):
            m = active[end - 1]
            if m < self.NARROW:
                for k in range(m):
                    held = [(float(best[p % ring, k]), int(counts[p % ring, k])) for p in range(max(0, end - self.longest), end)]
                    out[k] = self._on(texts[k], end - 1, held)
                break
            top, n = np.full(m, -np.inf), np.zeros(m, np.int64)
            for size in range(1, min(self.longest, end) + 1):
                total = best[(end - size) % ring, :m] + scores[size - 1].take(starts[:m] + (end - size))
                pieces = counts[(end - size) % ring, :m] + 1
                better = (total > top) | ((total == top) & (pieces < n))
                top, n = np.where(better, total, top), np.where(better, pieces, n)
            best[end % ring, :m], counts[end % ring, :m] = top, n
            out[:m] = n
        return out.tolist()

    def count(self, texts: list[str | None]) -> list[int | None]:
        """Null for null, 0 for an empty text."""
        out: list[int | None] = [None if t is None else 0 for t in texts]
        order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: -len(texts[k]))
        own: list[int] = []
        coded: list[np.ndarray] = []

        def finish() -> None:
            known = sorted(zip(coded, own, strict=True), key=lambda x: -len(x[0]))  # normalizing may change lengths
            if known and len(known[0][0]):
                for (_, k), n in zip(known, self._together([c for c, _ in known]), strict=True):
                    out[k] = n
            own.clear()
            coded.clear()

        size = 0
        for k in order:
            codes = self.coded(texts[k])
            if len(codes) > self.SLICE:
                out[k] = self._on(codes, 0, [(0.0, 0)])
                continue
            if size + len(codes) > self.SLICE:
                finish()
                size = 0
            own.append(k)
            coded.append(codes)
            size += len(codes)
        finish()
        return out


class RunCounter:
    """Counts for texts whose normalized form is a run of one symbol; the run is given by its length.

    The forward pass keeps a window of the longest piece. When the scores and counts of the window, taken relative to its
    end, come again, all further counts follow from the period; a vocabulary without a period within ``REMEMBERED`` steps is
    passed through to each length that is asked for. Memory doesn't grow with the length.
    """

    REMEMBERED = 4096

    def __init__(self, counter: UnigramCounter, symbol: str):
        trie = counter.trie
        code = trie.code.get(symbol, 0)
        longest = 1
        while self._goes_on(trie, code, longest + 1):
            longest += 1
        self.pieces = list(trie.matches([code] * longest, 0))
        if not any(end == 1 for end, _ in self.pieces):
            self.pieces.append((1, counter.unknown))
        self.window = max(end for end, _ in self.pieces)
        self.first, self.period, self.gain = self._find_period()

    @staticmethod
    def _goes_on(trie: DoubleArrayTrie, code: int, depth: int) -> bool:
        """Whether some key begins with a run of ``depth``."""
        state = 0
        for _ in range(depth):
            slot = trie.base[state] + code
            if not code or not trie.base[state] or slot >= len(trie.check) or trie.check[slot] != state + 1:
                return False
            state = slot
        return True

    def _steps(self):
        """The count of every length from 0 on, with the window that it ends."""
        held = [(0.0, 0)]
        yield 0, held
        while True:
            best, count = -np.inf, 0
            for size, score in self.pieces:
                if size <= len(held):
                    before, n = held[-size]
                    if before + score > best or (before + score == best and n + 1 < count):
                        best, count = before + score, n + 1
            held.append((best, count))
            if len(held) > self.window:
                held.pop(0)
            yield count, held

    def _find_period(self) -> tuple[list[int], int, int]:
        """``(counts up to the end of the first period, its length, what the count gains by it)``; the length is 0 without one."""
        seen: dict[tuple, int] = {}
        counts: list[int] = []
        for count, held in self._steps():
            counts.append(count)
            best, n = held[-1]
            state = tuple((b - best, k - n) for b, k in held)
            if len(held) == self.window and state in seen:
                start = seen[state]
                return counts, len(counts) - 1 - start, count - counts[start]
            seen[state] = len(counts) - 1
            if len(counts) > self.REMEMBERED:
                return counts, 0, 0
        raise AssertionError

    def count(self, lengths: np.ndarray) -> np.ndarray:
        lengths = np.asarray(lengths, dtype=np.int64)
        first, last = np.array(self.first, dtype=np.int64), len(self.first) - 1
        if self.period:
            over = np.maximum(-(-(lengths - last) // self.period), 0)
            return first[lengths - over * self.period] + over * self.gain
        out = first[np.minimum(lengths, last)]
        if (far := np.unique(lengths[lengths > last])).size:
            wanted, counts = iter(far.tolist()), {}
            target = next(wanted)
            for size, (count, _) in enumerate(self._steps()):
                if size == target:
                    counts[size] = count
                    if (target := next(wanted, None)) is None:
                        break
            out[lengths > last] = [counts[int(n)] for n in lengths[lengths > last]]
        return out


#: The project's own estimate as a unigram vocabulary: every code point is normalized to one symbol, and any run of one to
#: four symbols is a piece of equal score, so that the best path has a quarter of the characters, rounded up.
ESTIMATE_SYMBOL = "x"
ESTIMATE_PIECES = tuple((ESTIMATE_SYMBOL * n, -1.0) for n in range(1, 5))


def estimate_counter() -> UnigramCounter:
    return UnigramCounter(ESTIMATE_PIECES, normalize=lambda text: ESTIMATE_SYMBOL * len(text))
