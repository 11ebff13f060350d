"""Token ids of texts from caches of whole pre-tokens, equal to what the tokenizer gives for the text.

A text is first cut before each blank that follows a visible character. The tokenizer's own pattern
never lets a token cross such a place, so the pieces can be encoded one by one. A piece is cut further into
pre-tokens, which are looked up; only pre-tokens never seen before are encoded, by the tokenizer's model alone.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import regex

#: Entries of a worker's caches, about 80 MB each; a cache that is full starts anew.
PIECES, PRE_TOKENS = 400_000, 400_000
#: Pieces with letters past this one are left to the tokenizer whole, as Unicode tables may differ.
LAST_PLAIN = "ɏ"
_CUT = re.compile(r"(?<=\S) ")
#: White space before a blank, where a text is not cut.
_WIDE = re.compile(r"\s ")
#: Byte-level models write each byte as one printable character: itself, or one from 256 on.
_SHOWN = {b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)}
_LETTERS = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


def tokenizer_path(tokenizer: str) -> str:
    """A file, or the name of a file that the public tokenizers' package knows."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


@functools.lru_cache(maxsize=4)
def load(tokenizer: str):
    """The tokenizer, its special strings and its pattern for pre-tokens."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer_path(tokenizer))
    special = [x.content for x in loaded.get_added_tokens_decoder().values()]
    return loaded, special, regex.compile(public_tokenizers.PATTERN)


class _Bounded(dict):
    """A dictionary that fills itself and starts anew when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def pieces(text: str) -> list[str]:
    """Parts of ``text`` that hold whole pre-tokens. All but the first are without the blank they begin with."""
    return _CUT.split(text) if text[:1] == " " or _WIDE.search(text) else text.split(" ")


class _Lookup:
    """Values of pieces, put together from those of pre-tokens."""

    def __init__(self, tokenizer: str, value, put_together, frequent=None):
        """``value`` makes one of a list of ids; ``put_together`` one of a list of values."""
        self.tokenizer, self.special, pattern = load(tokenizer)
        self.value, self.put_together = value, put_together
        model = self.tokenizer.model.tokenize
        pre_tokens = _Bounded(lambda x: value([t.id for t in model(x.encode().decode("latin-1").translate(_LETTERS))]), PRE_TOKENS)
        known = frequent or {}

        def look_up(pre):
            found = known.get(pre)
            return pre_tokens[pre] if found is None else found

        def of_piece(piece: str):
            if piece.isascii() or max(piece, default="") <= LAST_PLAIN:
                return put_together([look_up(x) for x in pattern.findall(piece)])
            return value(self.tokenizer.encode(piece, add_special_tokens=False).ids)

        def of_later_piece(piece: str):
            if piece.isalpha() and (piece.isascii() or max(piece) <= LAST_PLAIN):
                return look_up(" " + piece)
            return of_piece(" " + piece)

        self.of_piece, self.pre_tokens = of_piece, pre_tokens
        self.later = _Bounded(of_later_piece, PIECES)

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds no memory."""
        self.pre_tokens.clear()
        self.later.clear()

    def __call__(self, text: str):
        if any(x in text for x in self.special):
            return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = pieces(text)
        return self.put_together([self.of_piece(first), *map(self.later.__getitem__, rest)])


class Counter(_Lookup):
    """Numbers of tokens. ``frequent`` has those of common pre-tokens."""

    def __init__(self, tokenizer: str, frequent: dict[str, int]):
        super().__init__(tokenizer, len, sum, frequent)


class Encoder(_Lookup):
    """Token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str):
        super().__init__(tokenizer, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join)
