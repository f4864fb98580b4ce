"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

Payloads of at least ``LEAST`` bytes that are equal (SHA-256) are stored once, in the response record of
the smallest page id; the others become revisit records that refer to it. A task writes its records to
one file, under a fresh name for each attempt; only files named in the manifest are read, so a lost or
repeated task leaves no wrong data.

The reader inflates a file piece by piece, takes one member at a time, frames each block by its
Content-Length and verifies the digests of blocks and payloads. A revisit is resolved against the
response it names.

Defined results: a null html is an empty payload; a null page id is written as an empty one and revisits
when a page with an id has the same payload; rows that repeat the smallest id of a payload are all
responses; null urls have no target; an empty table gives no file and an empty result; other columns are
not read.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.base import batched, query, rows, table, to_batch
from larder.llm.files import opened_input, opened_output
from larder.session import new_path, stage

LEAST = 100
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))

MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("uri", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary())])


class WarcError(ValueError):
    """An archive that breaks the format or its digests."""


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def page_urn(page_id: int | None) -> str:
    return f"<{PAGE}{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    text = urn.removeprefix(f"<{PAGE}").removesuffix(">")
    return int(text) if text else None


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [*headers, ("WARC-Block-Digest", sha256(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)),
               ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", sha256(payload))]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=PRINTABLE)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", page_urn(refers_to))]
    return member(headers, http if revisit else http + payload)


def inflated(source, piece: int = PIECE) -> Iterator[Iterator[bytes]]:
    """Per gzip member, its content in pieces; a member must be read to its end before the next."""
    data = source.read(piece)
    while data:
        unpack = zlib.decompressobj(31)

        def content():
            nonlocal data
            while not unpack.eof:
                if not data and not unpack.unconsumed_tail:
                    raise WarcError("the archive ends within a record")
                try:
                    out = unpack.decompress(unpack.unconsumed_tail or data, piece)
                except zlib.error as broken:
                    raise WarcError(str(broken)) from broken
                if not unpack.unconsumed_tail and not unpack.eof:
                    data = source.read(piece)
                if out:
                    yield out
            data = unpack.unused_data or source.read(piece)
        yield content()
        if not unpack.eof:
            raise WarcError("a record was not read to its end")


def records(source, piece: int = PIECE) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, framed by Content-Length, with the block digest verified."""
    for content in inflated(source, piece):
        held = bytearray()
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(content, None)
            if more is None:
                raise WarcError("a record without an end of its headers")
            held += more
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        if not headers.get("content-length", "").isdecimal():
            raise WarcError("a record without a Content-Length")
        size = int(headers["content-length"])
        body = held[end + 4:]
        for more in content:
            body += more
            if len(body) > size + 4:
                raise WarcError("a record is longer than its Content-Length")
        if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
            raise WarcError("a record differs from its Content-Length")
        block = bytes(body[:size])
        if headers.get("warc-block-digest", sha256(block)) != sha256(block):
            raise WarcError("a block differs from its digest")
        yield headers, block


def pages_of(source, piece: int = PIECE) -> Iterator[tuple]:
    """The page records of an archive: RECORDS columns, with payload digests of responses verified."""
    for headers, block in records(source, piece):
        kind = headers.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        _, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"]
        if kind == "response" and digest != sha256(payload):
            raise WarcError("a payload differs from its digest")
        yield (page_of(headers["warc-record-id"]), kind,
               page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
               headers.get("warc-target-uri"), digest.removeprefix("sha256:"), payload if kind == "response" else None)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write every page; the manifest (path, n_records), staged."""
    folder = folder or new_path(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    read = pages.select("page_id", "url", payload.alias("payload"))
    keyed = read.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    first = (keyed.where("digest IS NOT NULL").groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    first = stage(first, "warc-first")  # so that a join with very many copies can be split
    # A short or unique payload joins nothing and is a response.
    placed = keyed.join(first, "digest", "left")

    def run(batches):
        path, sink, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for page_id, url, body, least_id in rows(batches, "page_id", "url", "payload", "first"):
            if sink is None:
                sink = opened_output(path)
                info = b"software: larder\r\nformat: WARC File Format 1.1\r\n"
                sink.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
                                   ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
            revisit = least_id is not None and page_id != least_id
            sink.write(page_record(page_id, url, body, least_id, revisit))
            n += 1
        if sink is not None:
            sink.close()
            yield to_batch([(path, n)], MANIFEST)

    columns = placed.select("page_id", "url", "payload", "first")
    return stage(columns.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The page records of all archives of a manifest; the payload of a revisit is null."""
    def run(batches):
        def found() -> Iterable[tuple]:
            for (path,) in rows(batches, "path"):
                with opened_input(path) as source:
                    yield from pages_of(source)
        return batched(found(), RECORDS)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(
        run, "page_id long, record_type string, refers_to long, uri string, payload_digest string, payload binary")


def resolved(found: DataFrame) -> DataFrame:
    """Page records with the payload size of each; a revisit has that of the response it refers to."""
    lite = stage(found.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "uri"),
                 "warc-records")
    responses = lite.where("record_type = 'response'")
    named = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    stored = stage(named, "warc-responses")  # so that a join with very many revisits can be split
    revisits = lite.where("record_type = 'revisit'").drop("payload_bytes").join(
        stored, ["refers_to", "payload_digest"], "left")
    return responses.unionByName(revisits)


@query("op5_warc", oracle="""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f""")
def op5_warc(spark, sf_dir):
    found = resolved(read_archives(write_archives(table(spark, sf_dir, "pages"))))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
