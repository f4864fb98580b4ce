"""A generalised suffix automaton over word sequences."""

import numpy as np


class SuffixAutomaton:
    """All word sequences that occur in any of the added items.

    A state stands for sequences with the same end positions; ``length`` is its longest one and
    ``link`` the state of the longest suffix with further end positions.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """Give the sequences of ``q`` up to ``length[p] + 1`` a state of their own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def walk(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """After each word: the state reached and the length of the longest match ending there."""
        states, lengths = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        state = size = 0
        step, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            moves = step[state]
            if word not in moves:
                if not state:
                    continue
                while state and word not in moves:
                    state = link[state]
                    moves = step[state]
                size = length[state]
                if word not in moves:
                    state = size = 0
                    continue
            state = moves[word]
            size += 1
            states[i], lengths[i] = state, size
        return states, lengths
