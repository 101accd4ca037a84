"""Cut texts where byte-level tokenizers always cut, and remember what each piece encodes to.

The pre-tokenization pattern of byte-level BPE vocabularies never matches across a single space that
has no other white space beside it: a match always starts at that space.  So such a text can be cut
at its spaces and every piece encoded on its own, and pieces repeat so often that a bounded memory
per Python worker answers most of them.  A text where a space touches other white space, or ends in
a space, goes through the pattern whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

#: A worker forgets all pieces once they take about so many bytes, and starts again.
REMEMBERED_BYTES = 128 << 20
#: Bytes that an entry takes beside its strings' own, and the characters of the longest piece that is remembered.
_ENTRY, _LONGEST = 200, 64


def _apart(piece: str) -> bool:
    """Whether a piece between single spaces can be encoded without its neighbours."""
    return bool(piece) and not piece[0].isspace() and not piece[-1].isspace()


def _plain(word: str) -> bool:
    """Letters only, of scripts whose letters every Unicode version agrees on."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class PieceEncoder:
    """Packed token ids of whole texts.

    ``matches`` splits a string as the tokenizer's pattern does; ``encode_matches`` gives the packed
    ids of each of several distinct matches, which come in sorted order.  What is remembered is bounded
    in bytes, and long pieces are not remembered; neither changes a result.
    """

    def __init__(
        self,
        matches: Callable[[str], list[str]],
        encode_matches: Callable[[Sequence[str]], Iterable[bytes]],
        bound: int = REMEMBERED_BYTES,
    ):
        self._matches, self._encode_matches, self._bound = matches, encode_matches, bound
        self._held = 0
        self._of_match: dict[str, bytes] = {}  # matches that do not begin with a space
        self._of_piece: dict[str, bytes] = {}  # by what follows the space, single matches among them

    def _keep(self, memory: dict[str, bytes], new: dict[str, bytes]) -> None:
        memory.update(new)
        self._held += _ENTRY * len(new) + 2 * sum(map(len, new)) + sum(map(len, new.values()))

    def learn(self, texts: Iterable[str | None]) -> None:
        """Encode what a batch has and the memory lacks, each distinct match once."""
        if self._held > self._bound:
            self._of_piece.clear()
            self._of_match.clear()
            self._held = 0
        new: set[str] = set()
        for text in texts:
            new.update((text or "").split(" "))
        of_piece, of_match = self._of_piece, self._of_match
        split = {p: self._split(p) for p in new if p not in of_piece and len(p) <= _LONGEST and _apart(p)}
        every = {m for found in split.values() for m in found}
        unseen = sorted(m for m in every if (m[1:] not in of_piece if m[0] == " " else m not in of_match))
        ids = dict(zip(unseen, self._encode_matches(unseen), strict=True))
        self._keep(of_piece, {m[1:]: x for m, x in ids.items() if m[0] == " "})
        self._keep(of_match, {m: x for m, x in ids.items() if m[0] != " "})
        several = ((p, found) for p, found in split.items() if len(found) > 1)
        self._keep(of_piece, {p: b"".join([of_piece[m[1:]] if m[0] == " " else of_match[m] for m in found]) for p, found in several})

    def _split(self, piece: str) -> list[str]:
        """Matches of a piece and the space before it: a word, perhaps with a comma or full stop, needs no pattern."""
        if _plain(piece):
            return [" " + piece]
        if piece[-1] in ".," and _plain(piece[:-1]):
            return [" " + piece[:-1], piece[-1]]
        return self._matches(" " + piece)

    def _encoded(self, found: list[str]) -> bytes:
        """Ids of matches that may be unknown, without remembering them."""
        some = sorted(set(found))
        return b"".join(map(dict(zip(some, self._encode_matches(some), strict=True)).__getitem__, found))

    def __call__(self, text: str | None) -> bytes:
        """Packed ids of one text, of a batch that was learnt or not."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if rest and first and first[-1].isspace():
            return self._encoded(self._matches(text))
        of_piece = self._of_piece
        try:
            packed = b"".join(map(of_piece.__getitem__, rest))
        except KeyError:
            if not all(p in of_piece or _apart(p) for p in rest):
                return self._encoded(self._matches(text))
            packed = b"".join(of_piece[p] if p in of_piece else self._encoded(self._split(p)) for p in rest)
        return self._encoded(self._matches(first)) + packed if first else packed
