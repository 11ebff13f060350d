"""A generalised suffix automaton over the words of several items."""

from __future__ import annotations

import numpy as np

from .text_words import LOWER, PLAIN, Words, scan


class ItemAutomaton:
    """Finds the item windows that end at each word of a text.

    A window is ``window`` consecutive words of an item, or the whole of an item that has fewer. The
    automaton has a state for each set of places where the same runs of words end; the longest run that
    ends at a word of a text is tracked while the words are read.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int, keys: np.ndarray):
        """``keys`` are the word keys of all item words, in the order of ``items``."""
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.word: dict[bytes, int] = {}
        self.owners: dict[tuple[int, int], set[str]] = {}
        self.short: set[int] = set()
        coded = [[self.word.setdefault(w, len(self.word)) for w in words] for _, words in items]
        for codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        for (item, _), codes in zip(items, coded, strict=True):
            span = min(window, len(codes))
            if not span:
                continue
            if span < window:
                self.short.add(span)
            for end, state, _ in self._follow(codes):
                if end + 1 >= span:
                    self.owners.setdefault((self._shortest(state, span), span), set()).add(item)
        self.least = min([window, *self.short])
        self.keys = np.unique(keys)
        flat = np.searchsorted(self.keys, keys)
        edge = np.cumsum([len(words) for _, words in items], dtype=np.int64)[:-1]
        follows = np.ones(max(len(flat) - 1, 0), dtype=bool)
        follows[edge[(edge > 0) & (edge < len(flat))] - 1] = False
        self.pairs = np.unique((flat[:-1] * len(self.keys) + flat[1:])[follows]) if len(flat) else flat

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, code, known)
        state = self._add(self.length[last] + 1, {}, 0)
        while last != -1 and code not in self.next[last]:
            self.next[last][code] = state
            last = self.link[last]
        if last != -1:
            known = self.next[last][code]
            fits = self.length[known] == self.length[last] + 1
            self.link[state] = known if fits else self._clone(last, code, known)
        return state

    def _clone(self, last: int, code: int, known: int) -> int:
        state = self._add(self.length[last] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = state
        while last != -1 and self.next[last].get(code) == known:
            self.next[last][code] = state
            last = self.link[last]
        return state

    def _add(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _follow(self, codes):
        """(place, state, length) of the longest run that ends at each code; None is no item word."""
        state, length = 0, 0
        for place, code in enumerate(codes):
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            step = self.next[state].get(code)
            if step is None:
                state, length = 0, 0
            else:
                state, length = step, length + 1
            yield place, state, length

    def _shortest(self, state: int, span: int) -> int:
        """The state of the last ``span`` words of ``state``."""
        while self.length[self.link[state]] >= span:
            state = self.link[state]
        return state

    def matches(self, words: Words) -> list[tuple[int, int, frozenset[str]]]:
        """(first word, end, items) of every window found in ``words``, as places in ``words``.

        Only stretches are read in which every two neighbours are neighbours in some item; others
        cannot hold a window.
        """
        total = len(words.key)
        if not total or not len(self.keys):
            return []
        code = np.minimum(np.searchsorted(self.keys, words.key), len(self.keys) - 1)
        known = self.keys[code] == words.key
        joined = known[:-1] & known[1:]
        joined[words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < total)] - 1] = False
        near = np.flatnonzero(joined)
        if len(self.pairs):
            pair = code[near] * len(self.keys) + code[near + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[near] = self.pairs[at] == pair
        else:
            joined[:] = False
        begin = np.flatnonzero(np.concatenate([[True], ~joined]))
        end = np.append(begin[1:], total)
        out = []
        for first, stop in zip(*(x[(end - begin >= self.least) & known[begin]].tolist() for x in (begin, end)), strict=True):
            spelled = [words.data[words.start[i]:words.end[i]].tobytes().lower() for i in range(first, stop)]
            for place, state, length in self._follow([self.word.get(w) for w in spelled]):
                for span in (self.window, *self.short):
                    if length >= span:
                        items = self.owners.get((self._shortest(state, span), span))
                        if items:
                            out.append((first + place + 1 - span, first + place + 1, items))
        return out


def item_words(texts) -> Words:
    """Words of a text column by the rule for items and documents."""
    return scan(texts, PLAIN, LOWER)
