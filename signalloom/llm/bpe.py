"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

Both vocabularies split a text into pre-tokens before merging, and no
pre-token runs on over a place where white space follows other characters. A
text is therefore cut at such places, each distinct piece is encoded once by
the library, and the ids of the text are those of its pieces in order. Texts
for which a cut is not provably safe are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: A memo is emptied at so many pieces (some 230 bytes each); longer pieces never enter it.
MEMO_PIECES, MEMO_CHARS = 1_200_000, 48
#: Characters that Python takes for white space and the library's patterns don't.
_ODD = re.compile("[\x1c-\x1f]")
#: A space that another white space or the end follows: pieces would cut a run of white space.
_RUN = re.compile(r" (?:\s|\Z)")
#: Outside this range lower-casing or composition may depend on neighbours; an apostrophe may begin a contraction.
_BEYOND = re.compile("[^\x00-\u017f]|['\u0130\x1c-\x1f\x85<]")
#: Within it, the vocabulary that drops white space cuts between letters and anything else.
_RUNS = re.compile("[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[^\\sa-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")
#: What leaves the byte-level vocabulary's cuts unsure, besides: white space that runs on.
_UNSURE = re.compile("[^\x00-\u017f]|['\x1c-\x1f\x85<]|\\s\\s\\s| \\s|\\s\\s\\Z| \\Z")
#: Else it too cuts between letters and anything else; a space goes with what follows.
_SPACED_RUNS = re.compile(" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+| ?[^\\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|\\s")
_END = "<|endoftext|>"
_PIECES = re.compile(r"\s*\S+|\s+\Z")


class PieceEncoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``spaced``: the vocabulary attaches a leading space to a piece (byte-level
    BPE); else white space is dropped (word-level BPE). Null counts as empty.
    """

    def __init__(self, path: str, spaced: bool, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.spaced = Tokenizer.from_file(path), spaced
        self.end = self.model.token_to_id(_END)
        self.memo: dict[str, bytes] = {}
        self.memo_pieces = memo_pieces

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[bytes]:
        """Ids of many short pieces: joined by the end token, which the library never merges with its neighbours."""
        out, odd = [], [x for x in pieces if "<|" in x]
        if odd:
            known = dict(zip(odd, self.whole(odd), strict=True))
            rest = iter(self.each([x for x in pieces if x not in known]))
            return [known[x] if x in known else next(rest) for x in pieces]
        for i in range(0, len(pieces), 4096):
            part = self.model.encode_batch_fast([_END.join(pieces[i : i + 4096])], add_special_tokens=False)[0]
            ids = np.array(part.ids, dtype="<u4")
            cut, raw = np.flatnonzero(ids == self.end), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(cut * 4 + 4).tolist()], [*(cut * 4).tolist(), len(raw)], strict=True)]
        return out

    def pieces(self, text: str) -> list[str] | None:
        """The text cut where it is safe, or None."""
        if not self.spaced:
            if not _BEYOND.search(text):
                return _RUNS.findall(text.lower())
            return None if _ODD.search(text) else text.replace("\n", " ").split(" ")
        if not _UNSURE.search(text):
            return _SPACED_RUNS.findall(text)
        if not _RUN.search(text):
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        return None if _ODD.search(text) else _PIECES.findall(text)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t) if t else [] for t in texts]
        memo = self.memo
        new = set().union(*(p for p in cut if p)).difference(memo) if cut else set()
        if len(memo) + len(new) > self.memo_pieces:
            memo.clear()
            new = set().union(*(p for p in cut if p))
        new = list(new)
        memo.update(zip(new, self.each(new) if self.end is not None else self.whole(new), strict=True))
        get = memo.__getitem__
        out = [b"".join(map(get, p)) if p is not None else self.whole([t])[0] for p, t in zip(cut, texts, strict=True)]
        for x in new:
            if len(x) > MEMO_CHARS:
                del memo[x]
        return out


_encoders: dict[tuple[str, bool, int], PieceEncoder] = {}


def encoder(path: str, spaced: bool, memo_pieces: int = MEMO_PIECES) -> PieceEncoder:
    """One encoder a Python worker."""
    key = (path, spaced, memo_pieces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
