"""Safe cuts for tokenizers that split words before merging.

A text may be cut before ASCII white space that follows something else: no pre-token reaches over
such a place, so the ids of the text are those of the pieces one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Other white space before ASCII white space makes one run of both: such texts stay whole.
_MIXED = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　][\x20\x09-\x0d]")
_PIECE = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
_DOUBLE = re.compile("[\x20\x09-\x0d][\x20\x09-\x0d]|[\x09\x0b-\x0d]")


def cut(text: str) -> list[str]:
    """Pieces of a text; their order and sum are the text."""
    if not text or (not text.isascii() and _MIXED.search(text)) or (text.isascii() and re.search("[\x1c-\x1f][\x20\x09-\x0d]", text)):
        return [text] if text else []
    if _DOUBLE.search(text):
        return _PIECE.findall(text)
    parts = text.replace("\n", " \n").split(" ")
    head = parts[0]
    out = [p if p[:1] == "\n" else " " + p for p in parts]
    out[0] = head
    return out if head else out[1:]


class Pieces:
    """Encodes texts by their pieces; what a piece gives is kept in two bounded memos: a full one is the older one from then on."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = 400_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.memo: dict = {}
        self.older: dict = {}

    def __call__(self, texts: list[str | None]) -> list[list]:
        """For each text what encode gives for its pieces; encode gets the new pieces of all texts at once."""
        cuts = [cut(t) if t else [] for t in texts]
        memo, get = self.memo, self.memo.get
        out = [list(map(get, pieces)) for pieces in cuts]
        short = [i for i, found in enumerate(out) if None in found]
        if short:
            missed = {p for i in short for p, x in zip(cuts[i], out[i], strict=True) if x is None}
            own = {p: x for p in missed if (x := self.older.get(p)) is not None}
            fresh = [p for p in missed if p not in own]
            for i in range(0, len(fresh), 50_000):
                own.update(zip(fresh[i : i + 50_000], self.encode(fresh[i : i + 50_000]), strict=True))
            for i in short:
                out[i] = [own[p] if x is None else x for p, x in zip(cuts[i], out[i], strict=True)]
            if len(memo) + len(own) > self.most:
                self.older = memo
                self.memo = memo = {}
            memo.update((p, x) for p, x in own.items() if len(p) <= self.longest)
        return out
