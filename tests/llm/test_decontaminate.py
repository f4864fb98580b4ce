"""The automaton and the contamination rule against brute force."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import decontaminate as op
from larder.llm.automaton import SuffixAutomaton

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = st.lists(st.integers(0, 2), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=5), WORDS)
def test_walk_finds_the_longest_match(items, words):
    automaton = SuffixAutomaton()
    for item in items:
        automaton.add(item)
    _, lengths = automaton.walk(words)
    subs = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for i in range(len(words)):
        want = max((n for n in range(1, i + 2) if tuple(words[i + 1 - n:i + 1]) in subs), default=0)
        assert lengths[i] == want


def brute_match(items, words, window):
    hit, found = [False] * len(words), set()
    for id_, item in items:
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == item[k:k + n]:
                    hit[i:i + n] = [True] * n
                    found.add(id_)
    return hit, found


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=6), WORDS, st.integers(2, 6))
def test_hits_and_items(items, words, window):
    items = [(str(i), [b"%d" % w for w in x]) for i, x in enumerate(items)]
    words = [b"%d" % w for w in words]
    hit, found = op.Matcher(items, window).match(words)
    assert (hit.tolist(), found) == brute_match(items, words, window)


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, bench):
    out, windows = [], {}
    for id_, text in bench:
        item = split(text)
        n = min(op.WINDOW, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            windows.setdefault(tuple(item[k:k + n]), set()).add(id_)
    sizes = sorted({len(w) for w in windows})
    for doc_id, text in docs:
        words, found = split(text), set()
        hit = [False] * len(words)
        for n in sizes:
            for i in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[i:i + n])):
                    hit[i:i + n] = [True] * n
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    sum(hit) > 0 and 20 * sum(hit) >= len(words)))
    return sorted(out, key=repr)


def test_query_on_whole_table(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(*c).collect()]
    got = sorted((tuple(r) for r in op.op8_decontamination(spark, FOLDER).collect()), key=repr)
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    assert got == want
    assert any(r[5] for r in got)


PASSAGE = " ".join(f"w{i}" for i in range(20))
DOCS = [(1, None), (2, ""), (3, PASSAGE.upper()), (4, "x " * 500 + PASSAGE), (None, PASSAGE), (5, "kurz é!"),
        (6, "pre kurz é post"), (6, "nothing"), (7, "long " * 50_000 + PASSAGE), (8, "w1 w2 w3")]
BENCH = [(10, PASSAGE), (2, PASSAGE + " more"), (3, "Kurz, É"), (4, None), (5, " ! "), (None, "w1 w2"), (10, PASSAGE)]


def test_edge_rows_and_blocks(spark):
    docs = spark.createDataFrame([(5, t, i) for i, t in DOCS], "n_words int, text string, doc_id long")
    bench = spark.createDataFrame([(t, i) for i, t in BENCH], "text string, item_id long")
    for block_words in (op.BLOCK_WORDS, 20):
        out = op.matched(docs, bench, block_words=block_words)
        assert out.columns == [*docs.columns, "match"]
        got = sorted(((r.doc_id, r.m.n_words, r.m.n_hit, len(r.m["items"]),
                       hashlib.sha256(",".join(r.m["items"]).encode()).hexdigest(), r.m.contaminated)
                      for r in out.withColumnRenamed("match", "m").collect()), key=repr)
        assert got == brute(DOCS, BENCH)
    kept = op.clean(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[5] for r in brute(DOCS, BENCH))


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 5 + PASSAGE + " b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    row = op.matched(docs, bench).first()["match"]
    assert [tuple(s) for s in row.spans] == [(5, 25)]
    assert op.matched(docs, bench.limit(0)).first()["match"].n_hit == 0
    assert op.matched(docs.limit(0), bench).collect() == []


def test_spans_are_cut_out(spark):
    rows = [(1, "a, " * 500 + PASSAGE.upper() + ". B"), (2, PASSAGE), (3, None), (4, "w0 w1"), (5, "a " * 500 + "É " + PASSAGE)]
    docs = spark.createDataFrame([(7, t, i) for i, t in rows], "match int, text string, doc_id long")
    bench = spark.createDataFrame([(1, PASSAGE), (2, "w0 w1")], "item_id long, text string")
    out = op.without_spans(docs, bench)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "a, " * 500 + "B", 3: None, 5: "a " * 500 + "É "}
    assert op.without_spans(docs, bench.limit(0)).count() == len(rows)


def test_batches_are_matched_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(op, "_LOADED", {})
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    out = op.matched(docs, bench, block_words=20, batch_bytes=1)
    want = op.matched(docs, bench)
    key = lambda df: sorted(map(repr, df.select("doc_id", "match").collect()))
    assert key(out) == key(want)
