"""Levenshtein automata and tries, shared by the operators on misread and mistyped words."""

from __future__ import annotations

from bisect import bisect_left


class Automaton:
    """The universal Levenshtein automaton for a bound: one table of states and moves for all words.

    A state holds the edit distances in a band around the diagonal, and, where swapped neighbours count as one edit, the
    band before it and where the letter before it stands in the word. What a letter does to a state depends only on where
    that letter stands in the word within the band, a number of a few bits. States and moves are made the first time they
    are needed and then serve every word.
    """

    MOST_STATES = 1 << 18

    def __init__(self, edits: int, swaps: bool = False) -> None:
        self.edits, self.swaps, self.width = edits, swaps, 2 * edits + 1
        self.window = (1 << (2 * edits + 3)) - 1
        self.reset()

    def reset(self) -> None:
        beyond = self.edits + 1
        first = tuple(abs(k - self.edits) if k >= self.edits else beyond for k in range(self.width))
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[int, int]] = []
        self.start = self.state(first, (beyond,) * self.width, 0)

    def state(self, band: tuple, before: tuple, seen: int) -> int:
        beyond = self.edits + 1
        if not self.swaps:
            before, seen = (), 0
        else:  # only what a swap could still use
            before = tuple(x if x < self.edits else beyond for x in before)
            useful = 0
            for k, x in enumerate(before):
                if x < self.edits:
                    useful |= 1 << (k + 2)
            seen &= useful
            if not seen:
                before = (beyond,) * self.width
        key = (band, before, seen)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def step(self, at: int, where: int) -> int:
        """The state after a letter that stands at the bits of ``where`` in the band; -1 if no word can follow."""
        band, before, seen = self.states[at]
        beyond = self.edits + 1
        new: list[int] = []
        for k in range(self.width):
            d = band[k] + (not where >> (k + 1) & 1)
            if k + 1 < self.width:
                d = min(d, band[k + 1] + 1)
            if k:
                d = min(d, new[k - 1] + 1)
            if self.swaps and before[k] < self.edits and seen >> (k + 2) & 1 and where >> k & 1:
                d = min(d, before[k] + 1)
            new.append(min(d, beyond))
        nxt = self.state(tuple(new), band, where) if min(new) <= self.edits else -1
        self.moves[at][where] = nxt
        return nxt


class Trie:
    """The sorted vocabulary as a trie: a node is a range of words with a common prefix. The children of nodes met before
    are remembered, up to a bound."""

    MEMO = 1 << 17

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.known: dict[tuple[int, int], tuple] = {}
        self.automata: dict[tuple[int, bool], Automaton] = {}

    def node(self, lo: int, hi: int, depth: int) -> tuple:
        """(the word that ends here or None, children as (letter, from, to))."""
        found = self.known.get((lo, depth))
        if found is None:
            words, at, out, ended = self.words, lo, [], None
            while at < hi:
                w = words[at]
                if len(w) <= depth:
                    ended, at = w, at + 1
                    continue
                nxt = hi if words[hi - 1][depth] == w[depth] else bisect_left(words, w[:depth] + chr(ord(w[depth]) + 1), at, hi)
                out.append((w[depth], at, nxt))
                at = nxt
            found = (ended, tuple(out))
            if len(self.known) >= self.MEMO:
                self.known.clear()
            self.known[lo, depth] = found
        return found

    def near(self, word: str, edits: int, swaps: bool = False) -> list[str]:
        """All words within ``edits`` edits, with ``swaps`` those of neighbouring letters as one edit: a walk of the
        product of the trie and the word's Levenshtein automaton."""
        auto = self.automata.get((edits, swaps))
        if auto is None:
            auto = self.automata[edits, swaps] = Automaton(edits, swaps)
        elif len(auto.states) > auto.MOST_STATES:
            auto.reset()
        places: dict[str, int] = {}
        for i, ch in enumerate(word):
            places[ch] = places.get(ch, 0) | 1 << (i + edits + 1)
        found: list[str] = []
        moves, window, n, node = auto.moves, auto.window, len(word), self.node
        if not self.words:
            return found
        stack = [(0, len(self.words), 0, auto.start)]
        while stack:
            lo, hi, depth, at = stack.pop()
            ended, children = node(lo, hi, depth)
            if ended is not None and 0 <= n - depth + edits < auto.width and auto.states[at][0][n - depth + edits] <= edits:
                found.append(ended)
            for ch, a, b in children:
                where = (places[ch] >> depth) & window if ch in places else 0
                nxt = moves[at].get(where)
                if nxt is None:
                    nxt = auto.step(at, where)
                if nxt >= 0:
                    stack.append((a, b, depth + 1, nxt))
        return found


def edit_distance(a: str, b: str, most: int = 9) -> int:
    """Edits with transpositions of neighbours as one edit; ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)
