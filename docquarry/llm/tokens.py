"""Ids of texts by a public tokenizer file, exactly as the tokenizers library gives them.

The library reads the file and stays the reference; two faster ways to the same
ids are used where they are known to agree (tests compare them). A byte-level
vocabulary whose ids are its merge ranks goes to tiktoken's merges. For a
vocabulary that drops white space, texts are cut at white space, which no token
crosses, and pieces met before are looked up; new ones go to the library's merges.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import regex

END_ID = 2
#: Pieces in the younger half of what a worker remembers; those not met while it fills are forgotten.
REMEMBER = 150_000

# fixed values: the patterns by which the two public vocabularies split a text before their merges
_BYTE_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
_WHITE = "\t\n\v\f\r"
_BEYOND = re.compile("[\u0130\u0250-\U0010ffff]").search
_SIGNS = re.compile(r"[^\w ][^\w ]|['_]").search


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _below_0250() -> dict[int, str]:
    letters = _byte_letters()
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}


#: Each character below U+0250 as the letters of its UTF-8 bytes.
_BYTES = _below_0250()


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes, the end id included."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.end = array("I", [end_id]).tobytes()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_white = self.ids("a \n\tb") == self.ids("a") + self.ids("b")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = regex.compile(_WORD_PARTS).findall
        self.merge = self.tokenizer.model.tokenize
        self.core = None if self.drops_white else self._tiktoken()
        self.plain = self.core is None and not self.drops_white  # neither faster way: the library

    def ids(self, text: str) -> list[int]:
        """By the tokenizers library itself."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _ranked(self) -> bool:
        """Whether ids ascend in the order of merges and every byte has one, so that the least id is the next merge."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [x if isinstance(x, str) else " ".join(x) for x in model.get("merges", [])]
        made = [model["vocab"].get(x.replace(" ", "", 1), -1) for x in merges]
        return len(merges) > 0 and min(made) >= 0 and all(a < b for a, b in zip(made, made[1:], strict=False)) and all(x in model["vocab"] for x in _byte_letters().values())

    def _tiktoken(self):
        import tiktoken

        if not self._ranked():
            return None
        back = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(back[c] for c in token): rank for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in back for c in token) and token not in self.special}
        return tiktoken.Encoding("file", pat_str=_BYTE_PARTS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.plain or any(s in text for s in self.special):  # found across pieces
            return array("I", self.ids(text)).tobytes() + self.end
        if self.core is not None:
            return array("I", self.core(text)).tobytes() + self.end
        for c in _WHITE:
            if c in text:
                text = text.replace(c, " ")
        if not _BEYOND(text):
            text = text.lower()
            if not _SIGNS(text):  # commas and full stops stand alone then
                text = text.replace(",", " , ").replace(".", " . ")
        pieces = text.split(" ")
        found = list(map(self.young.get, pieces))
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
            if len(self.young) > REMEMBER:
                self.old, self.young = self.young, {}
        found.append(self.end)
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        """Letters alone are one part; other pieces are split like the vocabulary does; beyond U+0250 the library encodes them whole."""
        known = self.young.get(piece) or self.old.get(piece)
        if known is None:
            if piece.isascii():
                if piece.isalpha():
                    known = array("I", [t.id for t in self.merge(piece.lower())]).tobytes()
                else:
                    known = self._parts(piece)
            elif max(piece) >= "ɐ" or "İ" in piece:
                known = array("I", self.ids(piece)).tobytes()
            elif piece.isalpha():
                known = array("I", [t.id for t in self.merge(piece.lower().translate(_BYTES))]).tobytes()
            else:
                known = self._parts(piece)
        self.young[piece] = known
        return known

    def _parts(self, piece: str) -> bytes:
        parts = self.split(piece.lower())
        return b"".join([self._piece(p) if p.isalpha() else array("I", [t.id for t in self.merge(p.translate(_BYTES))]).tobytes() for p in parts])


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path, end_id)


def vocabulary_file(name: str) -> str:
    """Place of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)
