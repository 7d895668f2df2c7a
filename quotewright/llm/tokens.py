"""Token ids by a byte-level BPE file of the ``tokenizers`` library.

The pre-tokenizer of these files never joins a character that is not white space with a following
space. A text may so be cut before each such space, and the parts encoded one by one. Words repeat
far more often than texts do, so that the ids of a part are mostly looked up, not computed again.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

CACHED_PARTS = 300_000  # of one generation; a bound on memory, about 50 MB each
SPACE_RUN = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")
PUNCTUATION = frozenset(".,;:!?")  # single pieces after a word


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand
    for themselves, the others, in order, for the characters from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = (b for b in range(256) if b not in set(kept))
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces:
    """Cuts texts by a pattern, with letters and digits as a library's own tables have them.

    Tables of different releases of Unicode differ in characters that older ones do not have. For those that Python's
    own table lacks, ``pieces`` tells into how many pieces the library cuts two characters: a letter goes with a
    letter, a digit with a digit. Texts without such characters are cut by the pattern as it is.
    """

    def __init__(self, pattern: str, pieces: Callable[[str], int]):
        import regex

        self.plain = regex.compile(pattern).findall
        unknown = "".join([c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"])
        self.unsure: set[str] = set()
        exact = f"(?V1){pattern}"
        for kind, partner in (("L", "a"), ("N", "1")):
            found = regex.findall(rf"\p{{{kind}}}", unknown)
            self.unsure.update(found)
            not_ = "".join([c for c in found if pieces(partner + c) > 1])
            if not_:
                exact = exact.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{not_}]]")
        self.exact = regex.compile(exact).findall

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or self.unsure.isdisjoint(text) else self.exact(text)


class PartTokenizer:
    """Encodes whole texts to little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Nothing is added at the ends. Strings of the file's added tokens inside a text get the ids of these tokens, as the
    library has it by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        if not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or isinstance(
                tokenizer.normalizer, normalizers.Normalizer):
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in what is around them are not supported")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(longest_first)})").split if added else None
        self.tokenize = tokenizer.model.tokenize
        cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces_of = Pieces(public_tokenizers.PATTERN, lambda text: len(cut(text)))
        self.characters = byte_characters()
        self.space = self.characters[32]
        self.new: dict[str, bytes] = {}  # ids of " " + part
        self.old: dict[str, bytes] = {}  # the generation before
        self.marks = {p: self._piece(p) for p in PUNCTUATION}

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.encode().decode("latin-1").translate(self.characters))

    def _ids(self, units: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(units)]).tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a space and ``part``, which are remembered."""
        ids = self.old.get(part)
        if ids is None:
            if part.isalpha():
                ids = self._ids(self.space + part) if part.isascii() else self._piece(" " + part)
            elif part[-1:] in PUNCTUATION and part[:-1].isalpha():
                word = part[:-1]
                ids = (self.new.get(word) or self._part(word)) + self.marks[part[-1]]
            else:
                ids = b"".join([self._piece(p) for p in self.pieces_of(" " + part)])
        self.new[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        for mark in self.added:
            if mark in text:
                return b"".join([self.added.get(p) or self._plain(p) for p in self.split(text) if p])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        parts = CUT.split(text) if SPACE_RUN.search(text) else text.split(" ")
        if len(self.new) > CACHED_PARTS:
            self.new, self.old = {}, self.new
        known, compute = self.new.get, self._part
        head = b"".join([self._piece(p) for p in self.pieces_of(parts[0])])
        del parts[0]
        return head + b"".join([known(p) or compute(p) for p in parts])
