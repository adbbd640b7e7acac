"""Token ids as the tokenizers library gives them, through a memo of words: most words of a corpus have been seen before.

Texts are cut where the library's own pre-tokenizer always cuts, so the ids of the parts, joined, are those of the text.
Each worker process keeps one encoder, and a bounded memo, for all of its tasks.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that are remembered at most, at about 250 bytes. The first three quarters stay: frequent words are met early. The last
#: quarter takes what comes later and is emptied when it is full, so that other words than the first ones are remembered too.
MEMO = 200_000
MARKED = 1 << 22  #: marks of words that have been met


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, others are moved up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


BYTES = _byte_characters()
#: Letters for which the libraries' and Python's notions of a letter agree; marks of which a run after a letter is one pre-token.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = ".,;:!?"
#: Pre-tokens of an ASCII word without an apostrophe (which may begin a contraction): digits one by one, or in runs.
ONE_DIGIT, DIGITS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+"), re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")


class _Memo(dict):
    """word -> its ids as little-endian bytes. lead: the byte-level character of the space before it, if it keeps one."""

    def __init__(self, tokenizer, lead: str, code: str, pattern: re.Pattern, most: int):
        self.tokenizer, self.lead, self.code, self.pattern, self.most = tokenizer, lead, code, pattern, most
        self.bpe = tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.met, self.marked = bytearray(MARKED), 0

    def _keep(self, word: str, out: bytes) -> None:
        """Remembers a word that has been met before, as far as marks of hashes can tell; most words are met once."""
        mark = hash(word) % MARKED
        if not self.met[mark]:
            self.met[mark] = 1
            self.marked += 1
            if self.marked > MARKED // 2:
                self.met, self.marked = bytearray(MARKED), 0
        elif len(word) <= 64:
            if len(self) < self.most * 3 // 4:
                self[word] = out
            else:
                if len(self.later) >= self.most // 4:
                    self.later.clear()
                self.later[word] = out

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, lead: str, piece: str) -> bytes:
        """Ids of one pre-token."""
        plain = piece
        if not piece.isascii():
            plain = piece.encode().decode("latin-1")
            if not plain.isprintable():  # printable characters stand for their own bytes
                plain = plain.translate(BYTES)
        return array(self.code, [t.id for t in self.bpe(lead + plain)]).tobytes()

    def _parts(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens that follow one another without a space."""
        out = self.parts
        for x in pieces:
            if x not in out:
                if len(out) > MEMO // 8:
                    out.clear()
                out[x] = self._piece("", x)
        return b"".join(map(out.__getitem__, pieces))

    def __missing__(self, word: str) -> bytes:
        later = self.later
        if word in later:
            return later[word]
        stem = word.rstrip(MARKS)
        if not (stem.isalpha() and (stem.isascii() or LETTERS.fullmatch(stem))):
            out = self._ids(word)
        elif len(stem) == len(word):
            out = self._piece(self.lead, word)
        else:
            own = self.get(stem) or later.get(stem)
            tail = self.parts.get(word[len(stem) :]) or self._parts([word[len(stem) :]])
            if own is None:  # a stem met for the first time is remembered, with its marks only from the second time on
                own = self._piece(self.lead, stem)
                self._keep(stem, own)
                return own + tail
            out = own + tail
        self._keep(word, out)
        return out

    def _ids(self, word: str) -> bytes:
        """Ids of a word that is more than letters and marks after them."""
        if word and word.isascii() and word.isprintable() and " " not in word and "'" not in word:
            first, *more = self.pattern.findall(word)
            return self._piece(self.lead, first) + self._parts(more)
        return self._whole((" " if self.lead else "") + word)


#: White space but for the space and the line feed, and what Python alone counts as such.
SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Ids of whole texts as bytes, `width` bytes each, for byte-level BPE (spaces kept) or lower-casing BPE (spaces dropped)."""

    #: What may not be parted at each space and line end; what may not be lowered and parted at white space. By substring
    #: search, which costs far less than a class of characters in a regular expression.
    ODD_KEPT = (*SPACES, "  ", "\n\n", " \n", "\n ")
    ODD_DROPPED = (*SPACES[2:], "Σ")
    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = lambda part: json.loads(part.__getstate__()) if part is not None else {}  # noqa: E731  without the vocabulary, which is large as JSON
        normal = [x["type"] for x in told(self.tokenizer.normalizer).get("normalizers", [])]
        pre = {"type": None} | told(self.tokenizer.pre_tokenizer)
        self.kept = normal == [] and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        self.dropped = normal == ["NFC", "Replace", "Lowercase"] and self.tokenizer.model.end_of_word_suffix == "</w>"
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        pattern = ONE_DIGIT if self.dropped else DIGITS
        # of texts whose spaces are kept, only the first word of a line stands without one
        self.first = _Memo(self.tokenizer, "", self.code, pattern, memo if self.dropped else memo // 4)
        self.after = _Memo(self.tokenizer, BYTES[32], self.code, pattern, 0 if self.dropped else memo * 3 // 4)
        self.newline = self.first._whole("\n")

    def _whole(self, text: str) -> bytes:
        return self.first._whole(text)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return self._whole(text)
        if self.dropped:
            return b"".join(map(self.first.__getitem__, text.lower().split())) if not any(x in text for x in self.ODD_DROPPED) else self._whole(text)
        if not self.kept:
            return self._whole(text)
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.ODD_KEPT):
            first, *more = self.SAFE.split(text)
            return self.first[first] + b"".join(map(self.after.__getitem__, more))
        out = []
        for line in text.split("\n"):
            first, *more = line.split(" ")
            out.append(self.first[first] + b"".join(map(self.after.__getitem__, more)))
        return self.newline.join(out)


@lru_cache(maxsize=4)
def encoder(path: str, memo: int = MEMO) -> Encoder:
    return Encoder(path, memo)


def wide(ids: bytes, width: int) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
