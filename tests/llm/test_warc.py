"""Archives: exact round trips, framing and digest errors, revisits."""

import gzip
import hashlib
import io

import pytest

from larder.llm import warc


def archive(pages):
    return b"".join(warc.page_record(i, f"http://h/{i} é\r\nx", body, None, False) for i, body in pages)


BODIES = [(1, b""), (2, b"x" * 99), (3, bytes(range(256)) * 3000), (4, b"a\r\n\r\nb\r\n\r\n"), (None, b"WARC/1.1\r\n")]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_round_trip_in_pieces(piece):
    bodies = BODIES if piece > 1 else [b for b in BODIES if len(b[1]) < 1000]
    got = list(warc.pages_of(io.BytesIO(archive(bodies)), piece))
    assert [(r[0], r[5]) for r in got] == bodies
    assert all(r[4] == hashlib.sha256(r[5]).hexdigest() for r in got)
    assert " " not in got[0][3] and "\r" not in got[0][3]


def test_a_record_is_a_member():
    data = archive(BODIES[:2])
    assert data.count(b"\x1f\x8b\x08") >= 2
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 2


def packed(data):
    return gzip.compress(data)


GOOD = gzip.decompress(warc.page_record(1, None, b"payload", None, False))


@pytest.mark.parametrize("broken", [
    archive(BODIES)[:-5], packed(GOOD.replace(b"payload", b"pAyload")), packed(GOOD[:-1]), packed(GOOD + b"x"),
    packed(GOOD.replace(b"WARC/1.1", b"WORC/1.1")), packed(GOOD.replace(b"\r\nContent-Length: ", b"\r\nNo: ", 1)),
    packed(b"WARC/1.1\r\n"), b"no archive"])
def test_broken_archives_are_refused(broken):
    with pytest.raises(warc.WarcError):
        list(warc.pages_of(io.BytesIO(broken)))


def brute(pages):
    out = []
    for page_id, html in pages:
        body = (html or "").encode()
        ids = [i for i, h in pages if (h or "") == (html or "") and i is not None]
        revisit = len(body) >= 100 and bool(ids) and page_id != min(ids)
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(),
                    "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(out, key=repr)


def test_edge_rows(spark):
    big = "é" * 60
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (9, big), (7, big), (8, big), (None, big), (7, big),
            (None, "n" * 200), (10, "long " * 300_000), (11, "long " * 300_000), (12, "x" * 100), (13, "x" * 100)]
    pages = spark.createDataFrame([(h, None if i == 3 else f"http://a b/{i}", 5, i) for i, h in rows],
                                  "html string, url string, first int, page_id long")
    found = warc.resolved(warc.read_archives(warc.write_archives(pages)))
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
    empty = warc.write_archives(pages.limit(0))
    assert warc.resolved(warc.read_archives(empty)).collect() == []
