"""Levenshtein automata intersected with a lexicon trie."""

from __future__ import annotations


class Trie:
    """Entries as nested maps; `END` marks where one ends."""

    END = "\0"

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[self.END] = {}

    def accepts(self, word: str) -> bool:
        """Whether the word is an entry."""
        node = self.root
        for letter in word:
            node = node.get(letter)
            if node is None:
                return False
        return self.END in node


class Levenshtein:
    """Automaton of all strings within `limit` edits of `word`.

    A state holds, in order, the positions of the word that can be reached and the edits
    spent there; a position that costs more than a neighbour explains is left out.
    """

    def __init__(self, word: str, limit: int):
        self.word, self.limit = word, limit

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.limit, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], letter: str) -> tuple[tuple[int, int], ...]:
        best: dict[int, int] = {}

        def reach(at: int, spent: int) -> None:
            if spent <= self.limit and spent < best.get(at, self.limit + 1):
                best[at] = spent

        for at, spent in state:
            reach(at, spent + 1)  # a letter more
            if at < len(self.word):
                reach(at + 1, spent + (self.word[at] != letter))
        for at in sorted(best):  # letters of the word left out
            for skip in range(1, self.limit - best[at] + 1):
                if at + skip <= len(self.word):
                    reach(at + skip, best[at] + skip)
        return tuple(sorted(best.items()))

    def spent(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """Edits in an accepting state, else None."""
        return dict(state).get(len(self.word))


def edits(word: str, trie: Trie, limit: int) -> int | None:
    """Fewest edits, at most `limit`, to an entry: the intersection, walked depth first."""
    automaton = Levenshtein(word, limit)
    best: int | None = None
    stack = [(trie.root, automaton.start())]
    while stack:
        node, state = stack.pop()
        if not state:
            continue
        if Trie.END in node:
            spent = automaton.spent(state)
            if spent is not None:
                best = spent if best is None else min(best, spent)
        for letter, child in node.items():
            if letter != Trie.END:
                stack.append((child, automaton.step(state, letter)))
    return best
