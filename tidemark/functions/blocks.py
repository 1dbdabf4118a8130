"""The longest block that a growing text shares with others, by a suffix automaton."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of a text, which may grow at its end, in time and room that grow with its length."""

    def __init__(self, text: str = ""):
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [0]
        self.last, self.size = 0, 0
        self.extend(text)

    def _state(self, length: int, link: int, first_end: int, moves: dict[str, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first_end.append(first_end)
        return len(self.link) - 1

    def extend(self, text: str) -> None:
        for c in text:
            self.size += 1
            new = self._state(self.size, 0, self.size, {})
            at = self.last
            while at >= 0 and c not in self.moves[at]:
                self.moves[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.moves[at][c]
                if self.length[to] != self.length[at] + 1:  # longer substrings lead there too, which don't end here
                    short = self._state(self.length[at] + 1, self.link[to], self.first_end[to], dict(self.moves[to]))
                    self.link[to] = short
                    while at >= 0 and self.moves[at].get(c) == to:
                        self.moves[at][c] = short
                        at = self.link[at]
                    to = short
                self.link[new] = to
            self.last = new

    def longest_in(self, other: str) -> tuple[int, int, int]:
        """(place in the text, place in other, length) of the longest block that both hold: of equal ones the first in the text, then in other."""
        best, at, n = (0, 0, 0), 0, 0
        for k, c in enumerate(other, 1):
            while at and c not in self.moves[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.moves[at]:
                at, n = self.moves[at][c], n + 1
            else:
                n = 0
            if n and (n > best[2] or (n == best[2] and self.first_end[at] - n < best[0])):
                best = (self.first_end[at] - n, k - n, n)
        return best
