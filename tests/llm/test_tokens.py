"""Piecewise encoding equals encoding of the whole text."""

import weakref
from array import array
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larder.llm.tokens import release, word_ids

FILES = {"dropped": "word_bpe_49k.json", "leading": "byte_bpe_50k.json"}
TEXT = st.text(st.sampled_from("abSTréÉİŁø ß'.,!\n\t 19<|>́  ≠　ǅΣ\x1c\r*"), max_size=40)


@pytest.mark.parametrize("spaces", sorted(FILES))
@settings(max_examples=600, deadline=None)
@given(text=TEXT)
@example(text="")
@example(text="It's here.\nThe don't,  two\n\nlines ")
@example(text="end <|endoftext|> of")
@example(text="Übergröße ÉÇ ǅx İstanbul\nŁódź, déjà-vu!")
def test_same_ids_as_the_whole_text(spaces, text):
    words = word_ids(public_tokenizers.path(FILES[spaces]), spaces)
    whole = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert array("I", words.text(text)).tolist() == whole if not text else \
        memoryview(words.text(text)).cast("I").tolist() == whole


def test_generations_keep_the_ids(monkeypatch):
    from larder.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    words = tokens.WordIds(public_tokenizers.path(FILES["leading"]), "leading")
    text = "a few words, and a few more words\nand more " * 3
    assert memoryview(words.text(text)).cast("I").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(words) <= 4


def test_release_frees_the_words():
    words = word_ids(public_tokenizers.path(FILES["dropped"]), "dropped")
    words.text("a few words, ended by marks!")
    held = weakref.ref(words)
    del words
    release()
    assert held() is None and not word_ids.cache_info().currsize


PARTS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "end", "It's", "É", " ", "\n", "\t", ".", "<", "1"])


@pytest.mark.parametrize("spaces", sorted(FILES))
@settings(max_examples=600, deadline=None)
@given(parts=st.lists(PARTS, max_size=12))
@example(parts=["end", " ", "<|endoftext|>", " ", "of"])
@example(parts=["end", "\n", "<|endoftext|>", ".", "\n", "of", "<|startoftext|>", "x"])
def test_added_tokens_as_in_the_untouched_library(spaces, parts):
    path, text = public_tokenizers.path(FILES[spaces]), "".join(parts)
    want = untouched(path).encode(text, add_special_tokens=False).ids
    assert array("I", word_ids(path, spaces).text(text)).tolist() == want


@lru_cache
def untouched(path):
    return Tokenizer.from_file(path)


def test_id_of_the_added_token():
    for spaces, id_ in (("leading", 50256), ("dropped", 49407)):
        ids = word_ids(public_tokenizers.path(FILES[spaces]), spaces).text("end <|endoftext|> of")
        assert id_ in array("I", ids)


def ids_of_column(words, texts, kind=pa.string()):
    return [array("I", bytes(ids)).tolist() for ids in words.texts(pa.array(texts, kind))]


@pytest.mark.parametrize("held", [3, 400_000])
@pytest.mark.parametrize("spaces", sorted(FILES))
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | TEXT | st.lists(PARTS, max_size=8).map("".join), max_size=6))
@example(texts=["", None, " ", "\n", "a", " a", "a b", "a  b", "a\n\nb", "a\nb", "a\tb c", "a b\tc", "a b\u00a0c"])
@example(texts=["réé, é. Élan! Größe; ß? łó<|endoftext|> É<|endoftext|>, ab<|endoftext|>. don't! it's", "réé é Élan É"])
@example(texts=[None, ""])
def test_columns_as_in_the_untouched_library(spaces, held, texts):
    from larder.llm import tokens
    path = public_tokenizers.path(FILES[spaces])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "CACHE_WORDS", held)
        words = fresh(path, spaces, held)
        want = [untouched(path).encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids_of_column(words, texts) == want
        assert ids_of_column(words, texts, pa.large_string()) == want


@lru_cache
def fresh(path, spaces, held):
    from larder.llm import tokens
    return tokens.WordIds(path, spaces)


def test_added_tokens_of_marks_in_columns(tmp_path):
    from larder.llm import tokens
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES["leading"]))
    tokenizer.add_tokens(["!!", "."])
    tokenizer.save(str(tmp_path / "more.json"))
    words, texts = tokens.WordIds(str(tmp_path / "more.json"), "leading"), ["to end!! it. So, no", "end!!. it"]
    assert ids_of_column(words, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_piece_is_looked_up_once_for_a_column(monkeypatch):
    from larder.llm import tokens
    words, asked = fresh(public_tokenizers.path(FILES["leading"]), "leading", 400_000), []
    monkeypatch.setattr(tokens.WordIds, "looked_up", lambda self, pieces, of=tokens.WordIds.looked_up:
                        asked.extend(pieces) or of(self, pieces))
    list(words.texts(pa.array(["some words and more words", "two words and more"] * 50)))
    assert sorted(asked) == ["and", "more", "some", "two", "words"]


def test_letters_and_marks_are_looked_up_once_for_a_column(monkeypatch):
    from larder.llm import tokens
    words, asked = tokens.WordIds(public_tokenizers.path(FILES["dropped"]), "dropped"), []
    for name in ("get", "__getitem__"):
        monkeypatch.setattr(tokens.WordIds, name, lambda self, piece, of=getattr(dict, name): asked.append(piece) or of(self, piece),
                            raising=False)
    list(words.texts(pa.array(["Some words, and  more Words.", "two WORDS! and\nmore 1"] * 50)))
    assert sorted(asked) == ["", "!", ",", ".", "1", "and", "more", "some", "two", "words"]


@pytest.mark.parametrize("spaces", sorted(FILES))
def test_every_letter_in_columns(spaces):
    from larder.llm import tokens
    path = public_tokenizers.path(FILES[spaces])
    letters = [chr(n) for n in range(0x20, 0x400)] + ["\u1e9e", "\u212a", "\u212b", "\u2c7e"]
    texts = [t for c in letters for t in (c, f"a{c} {c}, B{c}b{c}!", f"{c}\u0301 {c}<\u0338 {c}'s. .{c}")]
    assert ids_of_column(fresh(path, spaces, 400_000), texts) == \
        [untouched(path).encode(t, add_special_tokens=False).ids for t in texts]
