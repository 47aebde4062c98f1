"""Byte-pair encoding as dynamic programming over prefixes.

The encoding of a prefix of length i ends in exactly one piece t, namely the one for which the
encoding of the prefix without t ends in a piece u such that u followed by t encodes to those two again.
So a table of last pieces, filled from left to right, holds the encoding of every prefix. Finding
the matches takes one automaton pass; whether two pieces may stand side by side is remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

#: Remembered pairs and words per worker; a full memory is emptied, which costs time only.
MEMORY = 400_000


class PrefixBpe:
    """``pieces`` are the strings that may come out; ``rank(a, b)`` orders merges, None where there is none."""

    def __init__(self, pieces: list[str], rank: Callable[[str, str], int | None]):
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for piece in pieces:
            if len(piece) > 1 and self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.beside: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging, for strings of a piece or two."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) >= MEMORY:
                self.beside.clear()
            known = self.beside[a, b] = self._stays_apart(a, b)
        return known

    def _stays_apart(self, a: str, b: str) -> bool:
        """Merges both sides as byte-pair encoding would and stops at the first merge across the border."""
        rank, left, right = self.rank, list(a), list(b)
        ranks_left = [rank(x, y) for x, y in zip(left, left[1:], strict=False)]
        ranks_right = [rank(x, y) for x, y in zip(right, right[1:], strict=False)]
        while True:
            across = rank(left[-1], right[0])
            l_best = min((r for r in ranks_left if r is not None), default=None)
            r_best = min((r for r in ranks_right if r is not None), default=None)
            # ties go to the leftmost merge: left side, border, right side
            if across is not None and (l_best is None or across < l_best) and (r_best is None or across <= r_best):
                return False
            if l_best is None and r_best is None:
                return True
            if r_best is None or (l_best is not None and l_best <= r_best):
                parts, ranks, at = left, ranks_left, ranks_left.index(l_best)
            else:
                parts, ranks, at = right, ranks_right, ranks_right.index(r_best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])
            if at > 0:
                ranks[at - 1] = rank(parts[at - 1], parts[at])

    def matches(self, text: str):
        """``(end, pieces)`` for every position, longest piece first, the single character last."""
        found: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            found[end].append(piece)
        return found

    def last_pieces(self, text: str) -> list[str]:
        """For every prefix that is not empty, the last piece of its encoding."""
        last: list[str] = []
        may, beside = self.may_follow, self.beside
        for end, found in enumerate(self.matches(text)):
            for piece in found:
                before = end - len(piece)
                if before < 0:
                    break
                u = last[before]
                ok = beside.get((u, piece))
                if ok or (ok is None and may(u, piece)):
                    break
            else:
                piece = text[end]
            last.append(piece)
        return last

    def counts(self, text: str) -> list[int]:
        """Number of pieces of every prefix that is not empty."""
        out: list[int] = []
        for end, piece in enumerate(self.last_pieces(text)):
            before = end - len(piece)
            out.append(1 if before < 0 else out[before] + 1)
        return out
