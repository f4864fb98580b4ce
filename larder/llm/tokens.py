"""Token ids of whole texts by the tokenizers library.

Encoding is split at white space, where a token can never span, so that a word is encoded once per
worker and then looked up, one text at a time (``text``) or a column of texts at once (``texts``). The cut is
exact for the two supported pre-tokenizers:

* ``spaces="dropped"``: white space separates words and is not encoded (word BPE);
* ``spaces="leading"``: a single space belongs to the word after it (byte-level BPE). Any other run
  of white space sends the whole text through the tokenizer.

Added tokens (``<|endoftext|>``) get their own ids where a text holds them, as in the library. They hold no
white space, and a piece with one is encoded as it stands.
"""

import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE_WORDS = 400_000  # pieces of each of two generations
LETTERS = frozenset(string.ascii_letters)
# ASCII marks that end a letter run for both tokenizers; the apostrophe opens contractions.
MARKS = "".join(c for c in string.punctuation if c != "'")


# Letters that no normaliser changes but for their case; a run of them is a single token of the first split.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
# Those among them whose lower case is among them too.
LOWERED = "".join(c for c in map(chr, range(0x250)) if LATIN.fullmatch(c) and LATIN.fullmatch(c.lower()))


def _byte_chars() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself where it prints."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()
SPACE = BYTE_CHARS[0x20]
# What is shown for Latin letters that are no single byte.
SHOWN = {n: chr(n).encode().decode("latin-1").translate(BYTE_CHARS) for n in range(0xC0, 0x250)}


class Irregular(Exception):
    """A piece with white space of its own."""


class WordIds(dict):
    """Piece -> little-endian unsigned 32-bit ids as bytes.

    When ``CACHE_WORDS`` pieces are held they become the older generation, and the one before is dropped.
    """

    def __init__(self, path: str, spaces: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        # Whether no added token can be in letters with marks behind them.
        self.plain = not any(not (stem := token.rstrip(MARKS)) or stem.isalpha() for token in self.added)
        self.leading = spaces == "leading"
        self.older: dict[str, bytes] = {}
        self.newline = self.raw("\n")

    def raw(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        return ids.tobytes()

    def letters(self, text: str) -> bytes:
        """The ids of a run of Latin letters, after a space if there is one: a single merge of its bytes."""
        shown = text.replace(" ", SPACE) if text.isascii() else text.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [token.id for token in self.tokenizer.model.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.turn()
        out = self.older.get(piece)
        if out is None:
            out = self.encoded(piece)
        self[piece] = out
        return out

    def turn(self) -> None:
        self.older = dict(self)
        self.clear()

    def encoded(self, piece: str) -> bytes:
        added = any(token in piece for token in self.added)
        stem = piece.rstrip(MARKS)
        if not added and len(stem) < len(piece) and stem and stem[-1] in LETTERS:
            # Marks after a letter start a token of their own.
            return self[stem] + self.tail(piece[len(stem):])
        if self.leading:
            body = piece[1:] if piece[0] == "\n" else piece
            if LATIN.fullmatch(body):
                return self.letters(" " + body) if body is piece else self.newline + self.letters(body)
            if not body or any(c.isspace() for c in body):
                raise Irregular
            return self.raw(piece if piece[0] == "\n" else " " + piece)
        if LATIN.fullmatch(piece):
            lower = piece.lower()
            if lower == piece:
                return self.letters(piece)
            if len(lower) == len(piece):
                return self[lower]
        return self.raw(piece)

    def tail(self, marks: str) -> bytes:
        return tail_ids(self, marks)

    __hash__ = object.__hash__

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not self.leading:
            pieces = text.replace("\n", " ").split(" ")
            return b"".join(map(self.__getitem__, filter(None, pieces)))
        if not text:
            return b""
        first, *pieces = text.replace("\n", " \n").split(" ")
        if not first or "" in pieces or any(c.isspace() for c in first):
            return self.raw(text)
        try:
            return self.raw(first) + b"".join(map(self.__getitem__, pieces))
        except Irregular:
            return self.raw(text)

    def regular(self, piece: str) -> bytes | None:
        try:
            return self[piece] if piece else None
        except Irregular:
            return None

    def looked_up(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of different pieces that a space precedes; None where a text with the piece is encoded whole."""
        if len(self) >= CACHE_WORDS:
            self.turn()
        out, merge, plain = list(map(self.get, pieces)), self.tokenizer.model.tokenize, self.plain
        for i in [i for i, ids in enumerate(out) if ids is None]:
            piece = pieces[i]
            ids = self.older.get(piece)
            if ids is None:
                stem = piece if piece.isalpha() else piece.rstrip(MARKS)
                if plain and stem.isascii() and stem.isalpha():
                    shown = SPACE + stem
                elif plain and LATIN.fullmatch(stem):
                    shown = SPACE + stem.translate(SHOWN)
                else:
                    out[i] = self.regular(piece)
                    continue
                ids = self.get(stem) or self.older.get(stem)
                if ids is None:
                    self[stem] = ids = array("I", [token.id for token in merge(shown)]).tobytes()
                if len(stem) < len(piece):
                    ids += tail_ids(self, piece[len(stem):])
            self[piece] = out[i] = ids
        return out

    def merged(self, stems: list[str]) -> list[bytes]:
        """The ids of different runs of small Latin letters; none for an empty one."""
        if len(self) >= CACHE_WORDS:
            self.turn()
        out, merge = list(map(self.get, stems)), self.tokenizer.model.tokenize
        for i in [i for i, ids in enumerate(out) if ids is None]:
            stem = stems[i]
            ids = self.older.get(stem)
            if ids is None:
                shown = stem if stem.isascii() else stem.translate(SHOWN)
                ids = array("I", [token.id for token in merge(shown)]).tobytes()
            self[stem] = out[i] = ids
        return out

    def dropped(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces between dropped spaces.

        A piece of Latin letters and marks behind them is looked up as its letters in lower case and its marks, any
        other as a whole.
        """
        rest = pc.utf8_ltrim(pieces, LOWERED if self.plain else "")
        lettered = pc.and_(pc.less(pc.binary_length(rest), pc.binary_length(pieces)),
                           pc.equal(pc.utf8_rtrim(rest, MARKS), ""))
        stems = pc.utf8_lower(pc.utf8_rtrim(pieces, MARKS))
        stems = pc.if_else(lettered, stems, pa.scalar("", pieces.type)).dictionary_encode()
        rest = pc.if_else(lettered, rest, pieces).dictionary_encode()
        first = self.merged(stems.dictionary.to_numpy(zero_copy_only=False).tolist())
        then = [self[piece] if piece else b"" for piece in rest.dictionary.to_pylist()]
        return pc.binary_join_element_wise(
            pa.array(first, pa.large_binary()).take(stems.indices), pa.array(then, pa.large_binary()).take(rest.indices),
            pa.scalar(b"", pa.large_binary()))

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """``text`` of each, null being empty; a piece (not the first, before leading spaces) is looked up once for all texts."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.leading else " "), " ")
        at, pieces = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        if not self.leading:
            _, ends, data = self.dropped(pieces.dictionary).take(pieces.indices).buffers()
            ends, data = np.frombuffer(ends, np.int64)[at].tolist(), memoryview(data or b"")
            yield from (bytes(data[start:end]) for start, end in zip(ends, ends[1:]))
            return
        index, words = np.array(pieces.indices), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.looked_up(words)
        odd = np.fromiter((ids is None for ids in found), bool, len(found))
        whole = np.logical_or.reduceat(odd[index], at[:-1]).tolist()
        firsts = index[at[:-1]].tolist()
        index[at[:-1]] = len(words)  # no space precedes the first piece, which is encoded by itself
        joined = pa.array([*found, b""], pa.large_binary()).take(pa.array(index))
        _, ends, data = joined.buffers()
        ends, data = np.frombuffer(ends, np.int64)[at].tolist(), memoryview(data or b"")
        for i, (first, start, end) in enumerate(zip(firsts, ends, ends[1:])):
            if whole[i]:
                yield self.raw(texts[i].as_py())
            else:
                yield b"".join((self.raw(words[first]), data[start:end]))


@lru_cache(maxsize=4096)
def tail_ids(words: WordIds, marks: str) -> bytes:
    return words.raw(marks)


@lru_cache(maxsize=2)
def word_ids(path: str, spaces: str) -> WordIds:
    """One table per worker process and tokenizer file."""
    return WordIds(path, spaces)


def release() -> None:
    """Free the words that this worker process holds; called by passes that encode nothing."""
    word_ids.cache_clear()
    tail_ids.cache_clear()
    pa.default_memory_pool().release_unused()
