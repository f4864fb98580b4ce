"""Alignment of two tokenizers' tokens, composed from fragments of byte ranges.

The bytes of a text (with a space before it) are cut by two tokenizers A and B. Where a token of both ends,
there is a cut; between cuts lies a group. Tokens that share a byte are linked.

* Fragments. The tokens that end in a byte range give a fragment: what comes up to its first cut (open
  prefix), what lies between its first and last cut (closed groups), and what follows (open suffix); a range
  without a cut is open as a whole. Two neighbours compose: the suffix of the left and the prefix of the
  right close a group. This is associative and the empty fragment is its identity, so any tree gives the
  result of the whole text.
* Short texts, up to ``RANGE`` bytes, are one range. Longer ones are cut into ranges of that size wherever they
  fall; a range is encoded with the words that it cuts, from the nearest places that no token of either
  tokenizer can span (a space or line end between two Latin characters that print), and keeps the tokens that end in it.
  Ranges of a text are dealt to all tasks and their fragments are composed ``FAN`` at a time by position, level by level.
* Words. At such places both tokenizers cut, so a word is a closed fragment of its own; it is encoded
  once per worker and then looked up. Letters and the marks behind them are put together from two such fragments.
* Counts. Links of equal id pairs are summed over all documents. Pairs that are frequent, ``FREQUENT`` at most,
  go to the tasks as a table; the links of all other pairs are counted by a join. The highest count of each B
  id is at most one number per vocabulary entry.

Defined results: a null or empty text, and one whose A or B tokens do not spell its bytes (U+2581 in a text
becomes a space under B), has no tokens and zeros; rows that repeat an id are aligned one by one; an empty
table gives an empty result; other columns are not read.
"""

import pickle
import re
import weakref
from functools import lru_cache
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import batched, query, rows, small_batches, table
from larder.llm.tokens import BYTE_CHARS
from larder.session import stage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
RANGE = 1 << 16
FAN = 16
FREQUENT = 1 << 20
CACHE_WORDS = 240_000
GROUP_DOCS = 128
BATCH_BYTES, READ_ROWS, ROW_GROUP = 4 << 20, 512, 16 << 20
HELD_PAIRS = 1 << 20

NONE = np.empty(0, np.int64)
# Characters whose neighbourhood is known: printing ASCII and U+00C0 to U+00FF.
# A place that no token spans: before a single space or line end between two of them.
_BEFORE = rb"(?:(?<=[!-~])|(?<=\xc3[\x80-\xbf]))"
PLACE = re.compile(_BEFORE + rb"(?=[ \n](?:[!-~]|\xc3[\x80-\xbf]))")
# All bytes of such characters, with space and line end.
KNOWN = bytes(range(0x20, 0x7F)) + b"\n\xc3" + bytes(range(0x80, 0xC0))
GAPS = b"  ", b" \n", b"\n ", b"\n\n"
# Letters and then marks: both tokenizers cut between the two (a test reads B's pieces for it).
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
STEM = re.compile(rb"(\n?" + _LETTER + rb"+)([!-/:-@\[-`{-~]+)")
LETTERS = re.compile(rb" " + _LETTER + rb"+")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Tokens(NamedTuple):
    """Tokens of both kinds with the byte after each, in order."""
    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other):
        return Tokens(*(np.concatenate(pair) for pair in zip(self, other)))

    def part(self, first: int, end: int) -> "Tokens":
        """The tokens that end behind ``first`` and not behind ``end``."""
        a, b = (slice(*np.searchsorted(ends, (first, end), "right")) for ends in (self.a_end, self.b_end))
        return Tokens(self.a[a], self.a_end[a], self.b[b], self.b_end[b])


NO_TOKENS = Tokens(NONE, NONE, NONE, NONE)


class Closed(NamedTuple):
    """Closed groups: how they are written, their number, tokens of each kind, and linked pairs."""
    text: bytes
    groups: int
    n_a: int
    n_b: int
    links: np.ndarray

    def __add__(self, other):
        text = b";".join(t for t in (self.text, other.text) if t)
        return Closed(text, self.groups + other.groups, self.n_a + other.n_a, self.n_b + other.n_b,
                      np.concatenate([self.links, other.links]))


NO_GROUPS = Closed(b"", 0, 0, 0, NONE)


class Fragment(NamedTuple):
    """Open prefix, closed groups and open suffix; without a cut all is prefix. ``spelt``: the tokens spell the bytes."""
    cut: bool
    prefix: Tokens
    closed: Closed
    suffix: Tokens
    spelt: bool


EMPTY = Fragment(False, NO_TOKENS, NO_GROUPS, NO_TOKENS, True)
EDGE = Fragment(True, NO_TOKENS, NO_GROUPS, NO_TOKENS, True)  # the start of a text
UNSPELT = EDGE._replace(spelt=False)  # stays so in any company


@lru_cache(maxsize=2)
def numerals(digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of up to so many digits with a comma, bar or semicolon behind them: their bytes, zeros after them, and lengths."""
    ids = np.arange(10 ** digits).astype(bytes)
    signed = np.stack([np.char.add(ids, sign) for sign in (b",", b"|", b";")], axis=1).reshape(-1)
    return signed.view(np.uint8).reshape(len(signed), -1), np.char.str_len(signed)


class Linked(NamedTuple):
    """Groups of tokens that begin and end at cuts: their text with a semicolon behind each, the cut at which each
    ends and how far the text goes to there, the linked pairs and the end of each."""
    text: bytes
    cuts: np.ndarray
    text_end: np.ndarray
    links: np.ndarray
    link_end: np.ndarray


def linked(tokens: Tokens) -> Linked:
    """The groups and links of tokens that begin and end at cuts.

    Every stretch between two ends, of whichever kind, links the two tokens over it.
    """
    a, a_end, b, b_end = tokens
    ends = np.unique(np.concatenate([a_end, b_end]))
    over_a, over_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    cuts = ends[(a_end[over_a] == ends) & (b_end[over_b] == ends)]
    # In the text a group's tokens of A stand before those of B.
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    a_before, b_before = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.r_[0, b_before][a_group]] = a * 3 + (a_end == cuts[a_group])
    order[np.arange(len(b)) + a_before[b_group]] = b * 3 + 2 * (b_end == cuts[b_group])
    shown, width = numerals(len(str(max(a.max(), b.max()))))
    text = shown[order]
    return Linked(text[text != 0].tobytes(), cuts, np.cumsum(width[order])[a_before + b_before - 1],
                  a[over_a] << 32 | b[over_b], ends)


def closed(tokens: Tokens) -> Closed:
    """The groups of tokens that begin and end at cuts."""
    if not len(tokens.a):
        return NO_GROUPS
    found = linked(tokens)
    return Closed(found.text[:-1], len(found.cuts), len(tokens.a), len(tokens.b), found.links)


def fragment(tokens: Tokens) -> Fragment:
    """The fragment of the tokens that end in a range."""
    cuts = np.intersect1d(tokens.a_end, tokens.b_end)
    if not len(cuts):
        return EMPTY._replace(prefix=tokens)
    return Fragment(True, tokens.part(-1, cuts[0]), closed(tokens.part(cuts[0], cuts[-1])),
                    tokens.part(cuts[-1], np.iinfo(np.int64).max), True)


def compose(left: Fragment, right: Fragment) -> Fragment:
    if not (left.spelt and right.spelt):
        return UNSPELT
    if not right.cut:
        if not left.cut:
            return left._replace(prefix=left.prefix + right.prefix)
        return left._replace(suffix=left.suffix + right.prefix)
    if not left.cut:
        return right._replace(prefix=left.prefix + right.prefix)
    middle = left.closed + closed(left.suffix + right.prefix) + right.closed
    return Fragment(True, left.prefix, middle, right.suffix, True)


def spelt(texts: list[bytes], ids: list[list[int]], pieces: list[bytes], sizes: np.ndarray):
    """Ids one text after the other, their lengths, the number of each one's text, and which texts they spell."""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, count.sum())
    length, of = sizes[flat], np.repeat(np.arange(len(ids)), count)
    ends = np.r_[0, np.cumsum(length)][np.cumsum(count)]
    ok = np.diff(ends, prepend=0) == np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(map(pieces.__getitem__, flat[ok[of]].tolist()))
    if joined != b"".join(compress(texts, ok)):
        at = 0
        for i in np.flatnonzero(ok).tolist():
            at, begin = at + len(texts[i]), at
            ok[i] = joined[begin:at] == texts[i]
    return flat, length, of, ok


class Speller:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in BYTE_CHARS.items()}
        self.a_bytes = [b""] * self.a.get_vocab_size()  # added tokens are plain text here and have no id
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in byte_of for c in token):
                self.a_bytes[i] = bytes(byte_of[c] for c in token)
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode()
                        for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array(list(map(len, pieces)), np.int64) for pieces in (self.a_bytes, self.b_bytes))
        self.words = Words(self)

    def a_ids(self, texts: list[bytes]) -> list[list[int]]:
        """Letters behind a space are one word of the first split: a single merge. They are shown as bytes all at once."""
        merged = [LETTERS.fullmatch(t) is not None for t in texts]
        shown = b"\n".join(compress(texts, merged)).decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[0x0A])
        shown, merge = iter(shown), self.a.model.tokenize
        return [[t.id for t in merge(next(shown))] if one else self.a.encode(t.decode(), add_special_tokens=False).ids
                for t, one in zip(texts, merged)]

    def b_ids(self, texts: list[bytes]) -> list[list[int]]:
        """B puts a space before what it encodes; behind a line end, which it spells by its byte, the lone space is cut off.

        A text that starts with neither is encoded behind a line end, so that no space comes before it.
        """
        found = self.b.encode([t[1:].decode() if t[:1] == b" " else "\n" + t.lstrip(b"\n").decode() for t in texts], num_threads=1)
        return [ids if t[:1] == b" " else ids[1 if t[:1] == b"\n" else 2:] for t, ids in zip(texts, found)]

    def tokens(self, text: bytes) -> tuple[Tokens, bool]:
        """The tokens of ``text``, which starts with a space, and whether both kinds spell it."""
        a, b = self.a.encode(text.decode(), add_special_tokens=False).ids, self.b.encode(text[1:].decode())
        (a, a_len, _, a_ok), (b, b_len, _, b_ok) = self.spelt([text], [a], [b])
        return Tokens(a, np.cumsum(a_len), b, np.cumsum(b_len)), bool(a_ok[0] and b_ok[0])

    def spelt(self, texts: list[bytes], a: list[list[int]], b: list[list[int]]):
        """For both kinds: ids, their lengths, the number of each one's text, and which texts they spell."""
        return spelt(texts, a, self.a_bytes, self.a_size), spelt(texts, b, self.b_bytes, self.b_size)

    def aligned(self, texts: list[bytes]) -> list[Fragment]:
        """The fragments of whole texts that start with a space: the closed fragments of their words, composed."""
        return self.words.composed([split_words(t) for t in texts])


class Words:
    """Closed fragments of words, by a number per word. Cleared when ``CACHE_WORDS`` are held."""

    def __init__(self, tools: Speller):
        self.tools = weakref.proxy(tools)  # who holds these words; a cycle would outlive its last use
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # groups, tokens of both kinds, links; groups are -1 where not spelt
        self.start = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def extend(self, words: list[bytes], texts: list[bytes], counts: np.ndarray, links: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.text), len(self.text) + len(words))))
        self.text += texts
        ends = len(self.links) + np.cumsum(counts[:, 3])
        self.start = np.concatenate([self.start, ends - counts[:, 3]])
        self.counts = np.concatenate([self.counts, counts])
        self.links = np.concatenate([self.links, links])

    def links_of(self, at: np.ndarray) -> np.ndarray:
        """The links of the words with these numbers, one word after the other."""
        width = self.counts[at, 3]
        return self.links[np.repeat(self.start[at] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())]

    def encode(self, words: list[bytes]) -> None:
        """Number new words. Words begin and end at cuts, so those that are spelt are linked as one text."""
        if not words:
            return
        (a, a_len, a_of, a_ok), (b, b_len, b_of, b_ok) = self.tools.spelt(
            words, self.tools.a_ids(words), self.tools.b_ids(words))
        ok = a_ok & b_ok
        counts = np.stack([np.full(len(words), -1), np.bincount(a_of, minlength=len(words)),
                           np.bincount(b_of, minlength=len(words)), np.zeros(len(words), np.int64)], axis=1)
        texts, links = [b""] * len(words), NONE
        if ok.any():
            a_ok, b_ok = ok[a_of], ok[b_of]
            found = linked(Tokens(a[a_ok], np.cumsum(a_len[a_ok]), b[b_ok], np.cumsum(b_len[b_ok])))
            ends = np.cumsum([len(w) for w in compress(words, ok)])
            last = np.searchsorted(found.cuts, ends)
            counts[ok, 0] = np.diff(last, prepend=-1)
            counts[ok, 3] = np.diff(np.searchsorted(found.link_end, ends, "right"), prepend=0)
            begin = 0
            for i, end in zip(np.flatnonzero(ok).tolist(), found.text_end[last].tolist()):
                texts[i], begin = found.text[begin:end - 1], end
            links = found.links
        self.extend(words, texts, counts, links)

    def learn(self, words: set[bytes]) -> None:
        """Number the words that are new; letters with marks behind them are put together from both."""
        whole, cut, parts = set(), [], []
        for word in words.difference(self.number):
            bare = word[1:] if word[:1] == b" " else word
            if m := STEM.fullmatch(bare):
                stem = word[:len(word) - len(m[2])]
                cut.append(word)
                parts += stem, m[2]
            else:
                whole.add(word)
        self.encode(list(whole.union(parts).difference(self.number)))
        if cut:
            at = np.array([self.number[p] for p in parts], np.int64)
            counts = self.counts[at[::2]] + self.counts[at[1::2]]
            counts[(self.counts[at, 0].reshape(-1, 2) < 0).any(axis=1), 0] = -1
            texts = [b";".join((self.text[i], self.text[j])) for i, j in zip(at[::2].tolist(), at[1::2].tolist())]
            self.extend(cut, texts, counts, self.links_of(at))

    def composed(self, texts: list[list[bytes]]) -> list[Fragment]:
        """The fragment of each list of words."""
        if len(self.number) >= CACHE_WORDS:
            self.clear()
        self.learn(set().union(*texts) if texts else set())
        out = []
        for words in texts:
            at = [self.number[w] for w in words]
            places = np.array(at, np.int64)
            counts = self.counts[places]
            if (counts[:, 0] < 0).any():
                out.append(UNSPELT)
                continue
            groups, n_a, n_b, _ = counts.sum(axis=0).tolist()
            text = b";".join([self.text[i] for i in at])
            out.append(EDGE._replace(closed=Closed(text, groups, n_a, n_b, self.links_of(places))))
        return out


def split_words(text: bytes) -> list[bytes]:
    """``text``, which starts with a space, cut at its places."""
    if text.translate(None, KNOWN) or text[-1:].isspace() or any(gap in text for gap in GAPS):
        return PLACE.split(text)
    return [w if w[:1] == b"\n" else b" " + w for w in text[1:].replace(b"\n", b" \n").split(b" ")]


@lru_cache(maxsize=1)
def speller(a_path: str, b_path: str) -> Speller:
    return Speller(a_path, b_path)


def release() -> None:
    """Free the tokenizers that this worker process holds; called by passes that encode nothing."""
    speller.cache_clear()
    numerals.cache_clear()
    pa.default_memory_pool().release_unused()


def ranges(text: bytes, size: int) -> list[tuple]:
    """(first, end, base, bytes): ranges of about ``size`` bytes with the text around each, from place to place.

    ``base`` is where the bytes begin. Of the borders that lie between the same two places only the first is
    one, so no byte is in more than three ranges.
    """
    spaces = (m.start() for m in PLACE.finditer(text) if text[m.start()] == 0x20)
    places = np.array([0, *spaces, len(text)], np.int64)
    borders = np.arange(size, len(text), size)
    borders = borders[np.unique(np.searchsorted(places, borders), return_index=True)[1]].tolist()
    out = []
    for first, end in zip([0, *borders], [*borders, len(text)]):
        base, stop = places[np.searchsorted(places, first, "right") - 1], places[np.searchsorted(places, end)]
        out.append((first, end, int(base), text[base:stop]))
    return out


FINAL = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                   ("n_groups", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()),
                   ("key", pa.int64()), ("number", pa.int32()), ("ranges", pa.int32()),
                   ("first", pa.int64()), ("end", pa.int64()), ("base", pa.int64()), ("bytes", pa.binary())])
FINAL_DDL = ("doc_id long, text binary, n_a long, n_b long, n_groups long, pairs binary, times binary, key long, "
             "number int, ranges int, first long, end long, base long, bytes binary")
PARTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("number", pa.int32()), ("fragment", pa.binary())])
PARTS_DDL = "key long, doc_id long, number int, fragment binary"


def finished(doc_id, whole: Fragment) -> tuple:
    """A document's row: its groups, counts and distinct linked pairs with how often each is linked."""
    found = whole.closed if whole.spelt else NO_GROUPS
    pairs, times = np.unique(found.links, return_counts=True)
    return (doc_id, found.text, found.n_a, found.n_b, found.groups, pairs.tobytes(), times.astype(np.int32).tobytes(),
            *(None,) * 7)


def packed(f: Fragment) -> bytes:
    return pickle.dumps(tuple(f))


def unpacked(raw: bytes) -> Fragment:
    cut, prefix, groups, suffix, spelt = pickle.loads(raw)
    return Fragment(cut, Tokens(*prefix), Closed(*groups), Tokens(*suffix), spelt)


def groups(batches, size: int):
    """(doc_id, text) of ``size`` rows at a time; only these become Python values."""
    for batch in batches:
        for at in range(0, len(batch), size):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, size).columns)))


def first_pass(docs: DataFrame, a_path: str, b_path: str, size: int) -> DataFrame:
    """Finished rows of short texts, and the ranges of long ones (``key`` is not null), staged."""
    def run(batches):
        tools, part, n_long = speller(a_path, b_path), TaskContext.get().partitionId(), 0

        def found():
            nonlocal n_long
            for group in groups(batches, GROUP_DOCS):
                short = [(doc_id, b" " + text.encode()) for doc_id, text in group if text and len(text) < size]
                long = [d for d in short if len(d[1]) > size]
                long += [(doc_id, b" " + text.encode()) for doc_id, text in group if text and len(text) >= size]
                short = [d for d in short if len(d[1]) <= size]
                for (doc_id, _), whole in zip(short, tools.aligned([raw for _, raw in short])):
                    yield finished(doc_id, whole)
                yield from (finished(doc_id, EDGE) for doc_id, text in group if not text)
                for doc_id, raw in long:
                    key, dealt = part << 32 | n_long, ranges(raw, size)
                    n_long += 1
                    for number, cut in enumerate(dealt):
                        yield (doc_id, *(None,) * 6, key, number, len(dealt), *cut)
            tools.words.clear()  # an idle worker holds no words
            pa.default_memory_pool().release_unused()
        return batched(found(), FINAL, limit=BATCH_BYTES)

    with small_batches(docs.sparkSession, n_read=READ_ROWS):
        return stage(docs.select("doc_id", "text").mapInArrow(run, FINAL_DDL), "alignment-rows", ROW_GROUP)


def fragments(long: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, doc_id, number, fragment) of every range."""
    def run(batches):
        tools = speller(a_path, b_path)

        def found():
            for key, doc_id, number, first, end, base, cut in rows(
                    batches, "key", "doc_id", "number", "first", "end", "base", "bytes"):
                tokens, spelt = tools.tokens(cut)
                tokens = Tokens(tokens.a, tokens.a_end + base, tokens.b, tokens.b_end + base)
                yield key, doc_id, number, packed(fragment(tokens.part(first, end)) if spelt else UNSPELT)
        return batched(found(), PARTS)

    dealt = long.repartition("key", "number")
    return dealt.mapInArrow(run, PARTS_DDL)


def composed(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """One level of the tree: ``fan`` neighbouring fragments of a text become one."""
    def run(batches):
        def found():
            held, whole = None, EMPTY
            for key, doc_id, number, raw in rows(batches, "key", "doc_id", "number", "fragment"):
                place = key, doc_id, number // fan
                if held is not None and place != held:
                    yield *held, packed(whole)
                    whole = EMPTY
                held, whole = place, compose(whole, unpacked(raw))
            if held is not None:
                yield *held, packed(whole)
        return batched(found(), PARTS)

    grouped = parts.repartition("key", F.floor(F.col("number") / fan)).sortWithinPartitions("key", "number")
    return grouped.mapInArrow(run, PARTS_DDL)


def alignments(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """Per document: doc_id, text (its groups), n_a, n_b, n_groups, pairs (A id << 32 | B id) and times, staged."""
    columns = FINAL.names[:7]
    found = first_pass(docs, a_path, b_path, size)
    most = found.agg(F.max("ranges")).first()[0]
    done = found.where("key IS NULL").select(*columns)
    if most is None:
        return done
    parts = fragments(found.where("key IS NOT NULL"), a_path, b_path)
    while most > 1:
        parts, most = composed(parts, fan), -(-most // fan)

    def run(batches):
        return batched((finished(doc_id, compose(EDGE, unpacked(raw)))[:7] for doc_id, raw in
                        rows(batches, "doc_id", "fragment")), pa.schema(list(FINAL)[:7]))

    with small_batches(docs.sparkSession, n_read=READ_ROWS):
        return done.unionByName(stage(parts.mapInArrow(run, ", ".join(FINAL_DDL.split(", ")[:7])), "alignment-long", ROW_GROUP))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): the links of each id pair in all documents, staged."""
    def run(batches):
        held = []

        def flushed():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.concatenate([t for _, t in held]))
            return pairs, n

        release()
        size = 0
        for pairs, times in rows(batches, "pairs", "times"):
            held.append((np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int32)))
            size += len(held[-1][0])
            if size >= HELD_PAIRS:
                held = [flushed()]
                size = len(held[0][0])
                if 2 * size >= HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["pair", "n"])
                    size = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flushed()], names=["pair", "n"])

    partial = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long")
    with small_batches(aligned.sparkSession, n_read=READ_ROWS):
        return stage(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def frequent(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs have as many links."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect()
    total = 0
    for bits, n in sorted(((r["bits"], r["count"]) for r in sizes), reverse=True):
        total += n
        if total > limit:
            return 2 << bits
    return 1


def with_counts(aligned: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose pair is the most frequent of its B id) and count_sum, staged.

    Columns other than pairs and times are handed on.
    """
    counts = pair_counts(aligned)
    b_of = F.col("pair").bitwiseAND((1 << 32) - 1)
    best = counts.groupBy(b_of.alias("b")).agg(F.max("n").alias("best"))
    judged = stage(counts.withColumn("b", b_of).join(F.broadcast(best), "b").select(
        "pair", "n", (F.col("n") == F.col("best")).alias("is_best")), "judged-pairs")
    least = frequent(counts, limit)
    known = judged.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        [known.column(i).to_numpy() for i in range(2)] + [known.column(2).to_numpy().astype(np.int64)])
    added = pa.schema([("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
                       ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))])

    def run(batches):
        release()
        table_, n, is_best = shared.value
        for batch in batches:
            out = []
            for pairs, times in rows([batch], "pairs", "times"):
                pairs, times = np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(table_, pairs), max(len(table_) - 1, 0))
                held = table_[at] == pairs if len(table_) else np.zeros(len(pairs), bool)
                at, own = at[held], times[held]
                rest = [{"pair": p, "times": t} for p, t in zip(pairs[~held].tolist(), times[~held].tolist())]
                out.append((int(times.sum()), int((own * is_best[at]).sum()), int((own * n[at]).sum()), rest))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([],) * 4, added)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(keep + columns, names=[*kept, *added.names])

    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    new = {"n_links": "long", "n_best": "long", "count_sum": "long", "rest": "array<struct<pair: long, times: long>>"}
    schema = aligned.select(*kept, *[F.lit(None).cast(kind).alias(c) for c, kind in new.items()]).schema
    with small_batches(aligned.sparkSession, n_read=READ_ROWS):
        out = stage(aligned.mapInArrow(run, schema), "alignment-counted", ROW_GROUP)
    if least == 1:
        return out.drop("rest")
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    placed = out.select("*", place)
    rest = placed.where(F.size("rest") > 0).select("at", F.explode("rest").alias("r")).select("at", "r.*")
    sums = rest.join(judged.where(F.col("n") < least), "pair").groupBy("at").agg(
        F.sum(F.col("times") * F.col("is_best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    return placed.join(sums, "at", "left").select(
        *kept, "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    found = alignments(table(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))
    written = F.when(F.col("n_a") > 0, F.sha2("text", 256)).otherwise("").alias("groups_sha256")
    out = with_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "pairs", "times", written))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
