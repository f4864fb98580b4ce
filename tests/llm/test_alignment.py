"""Alignment against links drawn from byte ranges, the laws of the fragments, and every way to cut a text."""

import hashlib
import re
import weakref
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import numpy as np
import pyarrow.parquet as pq

from larder.llm import alignment as op
from larder.session import stage

FOLDER = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path(op.A_FILE), public_tokenizers.path(op.B_FILE)


def byte_level():
    """The bytes of the characters of byte-level tokens, by the published rule."""
    keep = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0) and b != 0xAD]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


CHARS = byte_level()


def spans(ids, parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip(ids, [0, *ends], ends))


def brute(docs):
    a_tool, b_tool = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_tool.encode_special_tokens = True
    found, counts = [], Counter()
    for doc_id, text in docs:
        if not text:
            found.append((doc_id, [], [], [], ""))
            continue
        raw = (" " + text).encode()
        a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
        a_parts = [bytes(CHARS[c] for c in a_tool.id_to_token(i)) for i in a]
        pieces = [b_tool.id_to_piece(i) for i in b]
        b_parts = [bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(a_parts) != raw or b"".join(b_parts) != raw:
            found.append((doc_id, [], [], [], ""))
            continue
        a, b = spans(a, a_parts), spans(b, b_parts)
        links, j = [], 0
        for i, first, end in a:
            while b[j][2] <= first:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        cuts, groups = {e for *_, e in a} & {e for *_, e in b}, []
        for tokens in (a, b):
            own = [[]]
            for i, _, end in tokens:
                own[-1].append(i)
                if end in cuts:
                    own.append([])
            groups.append([",".join(map(str, g)) for g in own[:-1]])
        written = ";".join(f"{x}|{y}" for x, y in zip(*groups))
        found.append((doc_id, a, b, links, written))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(((d, len(a), len(b), w.count(";") + 1 if w else 0, len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(w.encode()).hexdigest() if w else "")
                   for d, a, b, links, w in found), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum,
                    hashlib.sha256(bytes(r.text)).hexdigest() if r.n_a else "") for r in df.collect()), key=repr)


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.op11_alignment(spark, FOLDER).collect()), key=repr) == brute(docs)


TEXTS = [None, "", " ", "a", " lead", "two  spaces   three", "line\nline\n\nend\n", "tab\t x\r\n y", "Straße Éa ñu « x »", "日本語 の 文 章", "a▁b", "x ▁",
         "<s> hi</s> <0x41> <|endoftext|> <unk>", "nul\x00 \x1c x", "a b   c 　d", "é ́x", "🙂🙂 🙂", "don't we'll 'S", "1234567 12 3",
         "word " * 300, "antidisestablishmentarianism" * 20, "*** $$$a b%%%", " x  y"]
ROWS = [*enumerate(TEXTS), (None, "no id here"), (3, "a"), (7, "repeated id, other text"), (1000, "long text of words, é and so on " * 1500)]


@pytest.mark.parametrize("size, fan, limit", [(op.RANGE, op.FAN, op.FREQUENT), (7, 2, 5), (64, 3, 0)])
def test_edge_rows(spark, size, fan, limit):
    rows = ROWS if size > 7 else ROWS[:-1]
    docs = spark.createDataFrame([(5, t, i, "x") for i, t in rows], "pairs int, text string, doc_id long, key string").repartition(3)
    out = op.with_counts(op.alignments(docs, *PATHS, size=size, fan=fan), limit)
    assert result(out) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.with_counts(op.alignments(docs, *PATHS)).collect() == []


ENDS = st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=25)


def random_tokens(widths):
    """Tokens of both kinds over the same bytes."""
    total = sum(w for w, _ in widths)
    a = np.cumsum([w for w, _ in widths])
    b = np.unique([min(e, total) for e in np.cumsum([w for _, w in widths]).tolist()] + [total])
    return op.Tokens(np.arange(len(a)), a, np.arange(len(b)) + 100, b), total


def plain(f):
    return repr([x.tolist() if hasattr(x, "tolist") else x for x in (f.cut, *f.prefix, *f.closed, *f.suffix, f.spelt)])


@settings(max_examples=200, deadline=None)
@given(ENDS, st.lists(st.integers(0, 100), max_size=6), st.randoms())
def test_any_tree_over_any_ranges_gives_the_whole(widths, borders, rng):
    tokens, total = random_tokens(widths)
    edges = sorted({0, total, *(b for b in borders if b < total)})
    parts = [op.fragment(tokens.part(a, b)) for a, b in zip(edges, edges[1:])]
    parts.insert(rng.randrange(len(parts) + 1), op.EMPTY)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [op.compose(parts[i], parts[i + 1])]
    assert plain(parts[0]) == plain(op.fragment(tokens))
    whole = op.compose(op.EDGE, parts[0])
    assert plain(whole) == plain(op.EDGE._replace(closed=op.closed(tokens)))
    assert plain(op.compose(op.UNSPELT, whole)) == plain(op.compose(whole, op.UNSPELT)) == plain(op.UNSPELT)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n'sÃ 　́\t1.▁日", max_size=60))
def test_words_and_ranges_have_the_tokens_of_the_whole(text):
    tools, raw = op.speller(*PATHS), b" " + text.encode()
    tokens, spelt = tools.tokens(raw)
    want = plain(op.EDGE._replace(closed=op.closed(tokens)) if spelt else op.UNSPELT)
    assert plain(tools.aligned([raw])[0]) == want
    whole = op.EDGE
    for first, end, base, cut in op.ranges(raw, 9):
        part, ok = tools.tokens(cut)
        part = op.Tokens(part.a, part.a_end + base, part.b, part.b_end + base)
        whole = op.compose(whole, op.fragment(part.part(first, end)) if ok else op.UNSPELT)
    assert plain(whole) == want


def test_no_byte_is_in_many_ranges():
    text = b" " + b"x" * 10_000 + b" y" * 50 + b" " + b"z" * 5_000
    found = op.ranges(text, 100)
    assert [f[0] for f in found[1:]] == [f[1] for f in found[:-1]] and found[-1][1] == len(text)
    assert sum(len(f[3]) for f in found) <= 3 * len(text)


def test_no_piece_has_a_space_behind_another_character():
    tool = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size()) if not tool.is_byte(i) and not tool.is_control(i) and not tool.is_unknown(i)]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]
    assert not [p for p in pieces if "\n" in p or re.search(r"[A-Za-zÀ-ÿ][!-/:-@\[-`{-~]", p)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["don", "'t", "'", "\"'tis", ".", "...", " ", "\n", "  ", "É", "×", "÷.", "word", "A1", "1.", "%%%", "à"]), max_size=14))
def test_pieces_of_words_have_the_tokens_of_the_whole(parts):
    test_words_and_ranges_have_the_tokens_of_the_whole.hypothesis.inner_test("".join(parts))


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(op, "CACHE_WORDS", 3)
    tools = op.Speller(*PATHS)
    texts = [b" one two, three", b" four five. six\nseven", b" one two. \n"]
    want = [plain(op.EDGE._replace(closed=op.closed(tools.tokens(t)[0]))) for t in texts]
    for _ in range(2):
        assert [plain(tools.aligned([t])[0]) for t in texts] == want


def test_texts_that_tokens_do_not_spell():
    """Neither a wrong length nor wrong bytes of the right length spoil the texts beside them; texts may have no tokens."""
    pieces = [b"", b"a", b"bc", b"xy"]
    sizes = np.array([len(p) for p in pieces])
    texts = [b"abc", b"abc", b"", b"a", b"bc", b"a"]
    ids = [[1, 2], [1, 3], [], [2], [3], [1]]
    flat, length, of, ok = op.spelt(texts, ids, pieces, sizes)
    assert flat.tolist() == [1, 2, 1, 3, 2, 3, 1] and length.tolist() == [1, 2, 1, 2, 2, 2, 1]
    assert of.tolist() == [0, 0, 1, 1, 3, 4, 5] and ok.tolist() == [True, False, True, False, False, True]
    assert [len(c) for c in op.spelt([], [], pieces, sizes)] == [0] * 4


def test_groups_and_links_of_neighbouring_words():
    """Two words as one text: the first has A and B crossing, the second one token of each."""
    tokens = op.Tokens(np.array([7, 12345, 3]), np.array([2, 5, 6]), np.array([10, 0, 99]), np.array([3, 5, 6]))
    found = op.linked(tokens)
    assert found.text == b"7,12345|10,0;3|99;" and found.cuts.tolist() == [5, 6] and found.text_end.tolist() == [13, 18]
    assert [(p >> 32, p & 0xFFFFFFFF) for p in found.links.tolist()] == [(7, 10), (12345, 10), (12345, 0), (3, 99)]
    assert found.link_end.tolist() == [2, 3, 5, 6]
    assert op.closed(tokens).text == b"7,12345|10,0;3|99" and op.closed(op.NO_TOKENS) == op.NO_GROUPS


def test_a_worker_frees_its_tokenizers():
    held = weakref.ref(op.speller(*PATHS))
    op.release()
    assert held() is None and not op.speller.cache_info().currsize


def test_staged_rows_have_small_row_groups(spark):
    rows = spark.range(0, 4000, numPartitions=1).selectExpr(
        "id", "concat_ws('', transform(sequence(1, 30), i -> sha2(concat(id, '-', i), 256))) text")
    found = stage(rows, "row-groups", 1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_row_groups for f in found.inputFiles()]
    assert groups[0] > 3 and found.count() == 4000


def test_every_pass_over_rows_takes_little_at_a_time(spark, monkeypatch):
    seen, names = {}, ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")

    def noted(df, label, *row_group):
        seen[label] = (*(spark.conf.get(name, None) for name in names), *row_group)
        return stage(df, label, *row_group)

    before = [spark.conf.get(name, None) for name in names]
    monkeypatch.setattr(op, "stage", noted)
    docs = spark.createDataFrame([(1, "a b"), (2, "long words " * 9)], "doc_id long, text string")
    assert op.with_counts(op.alignments(docs, *PATHS, size=20)).count() == 2
    few = str(op.BATCH_BYTES), str(op.READ_ROWS)
    assert {seen[k] for k in ("alignment-rows", "alignment-long", "alignment-counted")} == {(*few, op.ROW_GROUP)}
    assert seen["pair-counts"] == few and [spark.conf.get(name, None) for name in names] == before
