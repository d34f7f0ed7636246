"""Encoding with a public BPE file: texts are cut at safe boundaries and each distinct piece is encoded once.

A helper for tasks.  A boundary is safe where the tokenizer never lets a token
reach across, so the pieces' ids in order are the ids of the whole text:

* ``word_bpe`` drops white space, so every run of ASCII white space is one; it lower-cases, so A-Z may be
  lower-cased before; and a single mark between a letter or digit and a space is a piece of its own, unless
  the letter is one that the tokenizer writes as a letter and a combining mark: only ASCII ones are trusted
  where a text holds letters beyond the Latin ones, or U+0130;
* ``byte_bpe`` starts a token at a space that stands alone between two
  characters that are not white space; the space goes with what follows.

Texts that hold an added token's string, or white space in any other
arrangement for ``byte_bpe``, are encoded in larger pieces or as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

CACHE_PIECES = 300_000
LONG_RUN = 1 << 16


_ENCODERS: dict = {}
_LAST_LATIN = "\u024f"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_LEAD = _BYTE_LETTERS[0x20]


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Two characters in a row that are neither letters, digits nor white space, or an apostrophe (contractions).
_ODD_SPACE = re.compile(r" [^\S ]|[^\S ] ")
_MARKS = re.compile(r"(?:[^\w\s]|[_\x1c-\x1f]){2}|'")


_COMPOSED = re.compile("[\u0130\u0250-\U0010ffff]")
_ASCII_MARK = re.compile(rb"(?<=[0-9a-z])([.,])[ \n]")


def _latin(text: str) -> bool:
    """Whether a text holds no letter that may be taken apart into a letter and a mark."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _COMPOSED.search(text)
    return True


def encoder(path: str, drops_space: bool) -> PieceEncoder:
    """The worker's encoder for a file; its pieces serve all tasks that the worker runs."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, drops_space)
    return _ENCODERS[key]


def _words_only(raw: bytes) -> bool:
    """Whether a text is only letters, digits and ASCII white space with single commas and stops between them."""
    if any(pair in raw for pair in (b"..", b".,", b",.", b",,")):
        return False
    return raw.translate(None, b" \t\n\v\f\r.,").decode("utf-8", "replace").isalnum()


class _Pieces(dict):
    """Ids by piece; a piece not met before is encoded, and all are forgotten when there are too many."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids = self.encode(piece)
        return ids


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers; keeps the latest ``CACHE_PIECES`` pieces."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = drops_space
        self.cache = _Pieces(self.encode_piece)

    def _plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _whole(self, text: str) -> bytes:
        """A text without simple boundaries: cut only where a lone space follows a letter and precedes one."""
        if any(a in text for a in self.added) or len(text) <= LONG_RUN:
            return self._plain(text)
        out, start = [], 0
        while len(text) - start > LONG_RUN:
            cut = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])").search(text, start + LONG_RUN)
            if not cut:
                break
            out.append(self._plain(text[start : cut.start()]))
            start = cut.start()
        out.append(self._plain(text[start:]))
        return b"".join(out)

    def _letters(self, word: str, lead: str = "") -> bytes | None:
        """Ids of a word of Latin letters: one piece for the tokenizer, which is handed to its merges at once."""
        if not word.isalpha() or max(word) > _LAST_LATIN or "\u0130" in word:
            return None
        if self.drops_space:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _packed([t.id for t in self.model.tokenize(lead + word)])

    def _simple(self, piece) -> bytes | None:
        """Ids of a word of letters with at most one mark after it, or None for any other piece."""
        if self.drops_space:
            return self._letters(piece.decode())
        if piece[-1] in ".,":
            word = self._letters(piece[:-1], _LEAD)
            return word and word + _packed([t.id for t in self.model.tokenize(piece[-1])])
        return self._letters(piece, _LEAD)

    def encode_piece(self, piece) -> bytes:
        ids = self._simple(piece)
        if ids is None:
            ids = self._plain(piece.decode() if self.drops_space else " " + piece)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._dropping(t) if self.drops_space else self._keeping(t) for t in texts]

    def _dropping(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        if _words_only(raw) or not any(a in text.lower() for a in self.added) and not _MARKS.search(text):
            raw = raw.lower()
            if _latin(text):
                raw = raw.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" . ")
            else:
                raw = _ASCII_MARK.sub(rb" \1 ", raw)
        return b"".join(map(self.cache.__getitem__, raw.split()))

    def _keeping(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        plain = rest and first and not first[-1].isspace() and not text[-1].isspace()
        # a piece that is empty, or begins or ends with white space, has no safe boundary
        if not plain or "  " in text or any(a in text for a in self.added) or _ODD_SPACE.search(text):
            return self._whole(text) if text else b""
        return self._whole(first) + b"".join(map(self.cache.__getitem__, rest))
