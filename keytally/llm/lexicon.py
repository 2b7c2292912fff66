"""A trie of terms intersected with Levenshtein automata, made deterministic as words are read.

A state is a set of (trie node, edits so far); reading a character follows all ways to match it, change
it, skip it or skip a character of a term. States and their transitions are remembered, so that a
word costs a lookup per character, and a word that no term can be near ends after its first characters.
"""

from __future__ import annotations

#: States kept before the memory of transitions starts anew.
MOST_STATES = 50_000


def edits_for(term: str) -> int:
    """How many edits a term of this length allows."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms with a weight. A stem matches any word that begins with it, exactly."""

    def __init__(self, terms: list[tuple[str, float, bool]]) -> None:
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.limit: list[int] = [0]  # the most edits that a term below allows
        for number, (text, _, stem) in enumerate(terms):
            node, most = 0, 0 if stem else edits_for(text)
            self.limit[0] = max(self.limit[0], most)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.limit.append(0)
                node = self.child[node][c]
                self.limit[node] = max(self.limit[node], most)
            self.term[node] = number
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of pairs, after the skipping of terms' characters; -1 if empty."""
        best: dict[int, int] = {}
        work = sorted(pairs, key=lambda p: p[1])
        while work:
            node, edits = work.pop()
            if edits > self.limit[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            work += [(n, edits + 1) for n in self.child[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [
                (edits, self.term[node])
                for node, edits in best.items()
                if self.term[node] >= 0 and edits <= self._most(self.term[node])
            ]
            self.ends.append(min(ends) if ends else None)
            stems = [t for e, t in ends if e == 0 and self.terms[t][2]]
            self.stems.append(min(stems) if stems else -1)
        return self.states[key]

    def _most(self, number: int) -> int:
        text, _, stem = self.terms[number]
        return 0 if stem else edits_for(text)

    def _step(self, state: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            children = self.child[node]
            if c in children:
                pairs.add((children[c], edits))
            pairs.add((node, edits + 1))
            pairs.update((n, edits + 1) for n in children.values())
        return self._state(pairs)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term number, edits) of the nearest term, the first of equals; None if there is none."""
        if not word or not self.terms:
            return None
        if len(self.sets) > MOST_STATES:
            self._reset()
        state, stem = self.start, -1
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._step(state, c)
            if to < 0:
                return None if stem < 0 else (stem, 0)
            state = to
            if stem < 0:
                stem = self.stems[state]
        end = self.ends[state]
        if end is not None and (end[0] == 0 or stem < 0):
            return end[1], end[0]
        return None if stem < 0 else (stem, 0)
