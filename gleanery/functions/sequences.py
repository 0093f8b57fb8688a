"""Runs that two sequences share, by a suffix automaton: linear in both, for texts and for lists of words."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Every run of ``items``: states by transitions, each with the length of its longest run and where that first ends."""

    def __init__(self, items: Sequence):
        self.next: list[dict] = [{}]
        self.link, self.size, self.ends = [-1], [0], [0]
        last = 0
        for at, item in enumerate(items, 1):
            new = self._state({}, self.size[last] + 1, at)
            while last >= 0 and item not in self.next[last]:
                self.next[last][item] = new
                last = self.link[last]
            if last < 0:
                self.link[new] = 0
            else:
                self.link[new] = self._split(last, item)
            last = new

    def _state(self, following: dict, size: int, ends: int) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.size.append(size)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, state: int, item) -> int:
        """The state of the runs of ``state`` followed by ``item``, apart from longer ones."""
        target = self.next[state][item]
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._state(dict(self.next[target]), self.size[state] + 1, self.ends[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.next[state].get(item) == target:
            self.next[state][item] = copy
            state = self.link[state]
        return copy

    def longest_in(self, other: Sequence) -> tuple[int, int, int]:
        """(start in ``other``, start in the items, size) of the longest shared run, the first of equal ones in both."""
        state, size, best = 0, 0, (0, 0, 0)
        for at, item in enumerate(other, 1):
            while state and item not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if item in self.next[state]:
                state, size = self.next[state][item], size + 1
                if size > best[2]:
                    best = (at - size, self.ends[state] - size, size)
        return best


def shared_runs(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """The longest shared run of ``a`` and ``b``, then those to its left and right, and so on, in order."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, n = SuffixAutomaton(b[b0:b1]).longest_in(a[a0:a1])
        if n:
            i, j = a0 + i, b0 + j
            found.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(found)
