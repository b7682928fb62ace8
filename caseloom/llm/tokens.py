"""Token ids of whole texts, word by word.

The split pattern of byte-level vocabularies never joins characters across a single space between two visible
characters.  A text can therefore be cut there, and the ids of each cut piece be remembered: most words of a corpus
repeat.  A text of ids is kept as a Python string with one character per id, so that joining pieces is one call and
``encode('utf-32-le', 'surrogatepass')`` gives the little-endian 32-bit ids, also of vocabularies above 55,296 ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product


#: Remembered pieces per generation; two generations are held, so memory is bounded.
REMEMBERED = 600_000
#: Pieces longer than this are not remembered.
LONG_PIECE = 64
#: Letters below are letters in any version of Unicode that a library may follow.
_LATIN = "\u0250"
_ODD = re.compile(r"[^\S \n]|\s\s(?:\s|\Z)")
_ODD_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
_RUNS = ["".join(run) for run in product(" \n", repeat=3)]
_ENDS = tuple("".join(run) for run in product(" \n", repeat=2))
_CUT = re.compile(r"(?<=\S)(?= \S)")


def odd_spaces(text: str) -> bool:
    """Whether a text has white space other than single or paired spaces and line feeds between visible characters."""
    if not text.isascii():
        return _ODD.search(text) is not None
    return any(c in text for c in _ODD_ASCII) or any(run in text for run in _RUNS) or text.endswith(_ENDS)


class Remembered(dict):
    """piece -> ids, computed on first use; the oldest of two generations is dropped when the newer is full."""

    def __init__(self, compute: Callable[[str], str], limit: int = REMEMBERED):
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.compute(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class WordwiseEncoder:
    """Encodes texts with ``encode(piece) -> str of ids``, which must follow the byte-level split pattern.

    ``match`` may be a shorter way for a piece that is a single match of that pattern: a space and Latin letters.
    """

    def __init__(self, encode: Callable[[str], str], limit: int = REMEMBERED, match: Callable[[str], str] | None = None):
        self.encode, self.match = encode, match
        self.first = Remembered(lambda w: encode(w) if w else "", limit)
        self.later = Remembered(self._word, limit)
        self.newline = encode("\n")
        self.mark = {m: encode(m) for m in ".,"}

    def _word(self, word: str) -> str:
        """Ids of a space and a word; letters and a closing mark are separate matches of the split pattern."""
        if self.match and word.isalpha() and max(word) < _LATIN:
            return self.match(" " + word)
        if word[-1:] in self.mark and word[:-1].isalpha():
            return self.later[word[:-1]] + self.mark[word[-1]]
        return self.encode(" " + word)

    def __call__(self, text: str) -> str:
        if odd_spaces(text):
            # other white space, or a run of it: cut only where both neighbours of a space are visible
            return "".join(map(self.encode, _CUT.split(text))) if text else ""
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self.first[head] + "".join(map(self.later.__getitem__, rest)))
        return self.newline.join(out)
