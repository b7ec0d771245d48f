"""Operator 5, WARC archives: written in segments, read back by segment reassembly.

:func:`write_archives` turns pages into WARC/1.1 records in gzip-compressed files: a ``response`` holds an HTTP message whose body
is in chunked transfer framing; of records with equal payloads the one with the largest page_id is the response and the
others are ``revisit`` records. Blocks longer than ``segment`` bytes are cut: the first segment keeps the record's type and
the rest are ``continuation`` records that name its id, their segment number and, the last, the total length.

:func:`read_archives` parses the files by Content-Length, groups segments by origin id (a shuffle of the segmented records
only), orders them by segment number, verifies that none is missing and that the total length holds, decodes the chunked
framing where the HTTP head names it and verifies the payload's digest. Each page comes back with its URL, its payload and
``status`` ok or what failed. A revisit gets the payload of a verified response: found by its payload digest or, where it
has none, by the record it refers to. Payloads wanted by many revisits are copied, one for ``SHARE`` of them, so no task is
handed them all. No private header is read; a page_id is a part of the record id, and null in archives from elsewhere.
Content-Encoding is left as it is. Records that are no pages (warcinfo, request and the like) give no row.

Equal payloads are found by grouping digests, combined before the shuffle; no html is shuffled while at most
``MAX_BROADCAST`` payloads occur more than once (counted first), beyond that the repeated digests are joined by shuffle.

Defined results: null html is the empty payload; null url gives no target URI; rows with the same page_id and payload are
each a response if that page_id is the largest; a null page_id counts as smaller than any and, where no page of a payload has
an id, all its records are responses; very long payloads are written in segments; an empty table gives no rows; columns
other than page_id, url and html, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, shared_dir
from .tokens import batches

SEGMENT = 8192
CHUNK = 4096
FILE_ROWS = 20_000
MAX_BROADCAST = 500_000
SHARE = 200
FRAME = 8 << 20
_END = b"\r\n\r\n"


def _chunked(body: bytes, size: int) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _unchunked(data: bytes) -> bytes:
    """The body of chunked framing; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk length")
        out.append(data[at : at + size])
        at += size + 2


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(**fields) -> bytes:
    lines = ["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join(lines).encode() + _END


def _records(page_id, url, payload: bytes, refers, revisit: bool, name: str, segment: int) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that close it."""
    own, uri, digest = f"<urn:tracewell:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else None, f"sha1:{_digest(payload)}"
    common = {"WARC_Record_ID": own, "WARC_Date": "2020-01-01T00:00:00Z", "WARC_Target_URI": uri, "WARC_Payload_Digest": digest}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        block = head
        yield _head(WARC_Type="revisit", **common, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http; msgtype=response", Content_Length=len(block)) + block
        return
    block = head + _chunked(payload, CHUNK)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = {"WARC_Segment_Number": 1} if len(parts) > 1 else {}
    yield _head(WARC_Type="response", **common, **first, Content_Type="application/http; msgtype=response", Content_Length=len(parts[0])) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
        again = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{k}')}>"
        yield _head(WARC_Type="continuation", WARC_Record_ID=again, WARC_Date=common["WARC_Date"], WARC_Segment_Number=k, WARC_Segment_Origin_ID=own, **total, Content_Length=len(part)) + part


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.withColumn("_sha", F.sha1("html"))
    same = own.groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = F.broadcast(same) if same.count() <= MAX_BROADCAST else same
    joined = own.join(same, "_sha", "left").select("page_id", "url", F.encode("html", "utf-8").alias("payload"), "_first")

    def run(frames):
        task, k = TaskContext.get().partitionId(), 0
        for frame in batches(frames, 256):
            out = []
            for page, url, payload, first in zip(frame["page_id"], frame["url"], frame["payload"], frame["_first"], strict=True):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                out += _records(page, url, bytes(payload), first, first is not None and page != first, f"{page}/{task}/{k}", segment)
                k += 1
            yield pd.DataFrame({"record": out})

    records = joined.mapInPandas(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


_ROW = "record_id string, page_id long, url string, payload binary, digest string, record_type string, refers string, status string"
_PAGES = ("response", "revisit", "resource")
_OWN = re.compile(r"<urn:tracewell:page:(-?\d+):")


def _named(digest: str | None) -> str | None:
    """algorithm:VALUE of a digest header."""
    name, _, value = (digest or "").partition(":")
    return f"{name.strip().lower()}:{value.strip().upper()}" if value else None


def _wrong(payload: bytes, digest: str | None) -> str | None:
    """What is wrong with a payload's digest, in base 32 or hex; nothing where there is none."""
    if not digest:
        return None
    name, value = digest.split(":", 1)
    try:
        raw = hashlib.new(name.replace("-", ""), payload).digest()
    except (ValueError, TypeError):
        return "digest of unknown kind"
    return None if value in (base64.b32encode(raw).decode(), binascii.hexlify(raw).decode().upper()) else "digest differs"


def _payload(fields: dict, block: bytes) -> bytes:
    """What the block of a response or resource holds; ValueError where it can't be told."""
    if fields["warc-type"] != "response" or not fields.get("content-type", "application/http").lower().startswith("application/http"):
        return block
    end = block.index(_END) + 4
    chunked = re.search(rb"\r\ntransfer-encoding:[^\r]*\bchunked\b", block[:end], re.I)
    return _unchunked(block[end:]) if chunked else block[end:]


def _page(fields: dict, block: bytes, origin: str | None = None, bad: str | None = None) -> list[tuple]:
    """One page's row from its whole block, none if the record is no page. fields: empty where the first segment is missing."""
    kind, own, digest, payload = fields.get("warc-type"), fields.get("warc-record-id", origin), _named(fields.get("warc-payload-digest")), None
    if fields and kind not in _PAGES:
        return []
    if kind in ("response", "resource") and not bad:
        try:
            payload = _payload(fields, block)
            bad = _wrong(payload, digest)
        except ValueError:
            bad = "broken framing"
    page, url = _OWN.match(own or ""), fields.get("warc-target-uri")
    return [(own, page and int(page[1]), url and url.strip("<>"), payload, digest, kind, fields.get("warc-refers-to"), bad or "ok")]


def _parse(content: bytes) -> Iterator[tuple[dict, bytes, str | None]]:
    """Fields, block and what is wrong with its length, of each record of a file."""
    raw = io.BytesIO(content)
    with gzip.open(raw) if content[:2] == b"\x1f\x8b" else raw as f:
        while line := f.readline():
            if not line.strip():
                continue
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            block = f.read(length := int(fields.get("content-length", 0)))
            yield fields, block, None if len(block) == length else "truncated"


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows as frames of about FRAME bytes."""
    names, held, size = [c.split()[0] for c in _ROW.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += 500 + len(row[3] or b"")
        if size > FRAME:
            yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64"})
            held, size = [], 0
    yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64"})


def _found(spark: SparkSession, path: str) -> DataFrame:
    """A row of ``_ROW`` for each page's record, revisits without payload."""

    def whole(frames):
        yield from _frames(row for frame in frames for content in frame["content"] for fields, block, bad in _parse(content) if "warc-segment-number" not in fields for row in _page(fields, block, None, bad))

    def segments(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = []
                for fields, block, _ in _parse(content):
                    if "warc-segment-number" in fields:
                        rows.append((fields.get("warc-segment-origin-id", fields.get("warc-record-id")), int(fields["warc-segment-number"]), fields, block))
                yield pd.DataFrame(rows, columns=["origin", "number", "fields", "block"])

    def assembled(frames):
        origin, parts, fields, total = None, [], {}, None

        def done():
            block = b"".join(p for _, p in parts)
            bad = "segment missing" if [n for n, _ in parts] != list(range(1, len(parts) + 1)) or total is None else "length differs" if int(total) != len(block) else None
            return _page(fields, block, origin, bad)

        for frame in frames:
            for at, number, more, part in zip(frame["origin"], frame["number"], frame["fields"], frame["block"], strict=True):
                if parts and at != origin:
                    yield from done()
                    parts, fields, total = [], {}, None
                origin, more = at, dict(more)
                parts.append((number, part))
                fields = more if number == 1 else fields
                total = more.get("warc-segment-total-length", total)
        if parts:
            yield from done()

    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = "origin string, number int, fields map<string,string>, block binary"
    dealt = files.mapInPandas(segments, kinds).repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInPandas(whole, _ROW).unionByName(dealt.mapInPandas(lambda frames: _frames(assembled(frames)), _ROW))


def _base32(raw: Column) -> Column:
    """Base 32 of the SHA-1 of ``raw``."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(F.sha1(raw), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, url, payload, record_type, refers_to, status of the pages of an archive; refers_to: the page_id
    of the response that a revisit's payload is from."""
    kept = shared_dir(spark, "warc-pages")
    _found(spark, path).write.option("compression", "zstd").parquet(kept)
    found = spark.read.schema(_ROW).parquet(kept)
    again = (F.col("record_type") == "revisit") & (F.col("status") == "ok")
    key = F.coalesce("digest", "refers")
    offered = found.where("record_type = 'response' AND status = 'ok'")
    keys = F.array_compact(F.array_distinct(F.array("digest", F.concat(F.lit("sha1:"), _base32(F.col("payload"))), "record_id")))
    wanted = found.where(again).groupBy(key.alias("_key")).agg(F.count("*").alias("_n"))
    best = offered.select(F.explode(keys).alias("_key"), "page_id", "record_id").join(wanted, "_key")
    best = best.groupBy("_key").agg(F.max(F.struct("page_id", "record_id")).alias("_b"), F.max("_n").alias("_n"))
    best = cut(best.select("_key", F.col("_b.page_id").alias("_page"), F.col("_b.record_id").alias("_record"), F.expr(f"cast((_n + {SHARE - 1}) div {SHARE} as int)").alias("_copies")))
    small = F.broadcast if best.count() <= MAX_BROADCAST else lambda x: x
    given = offered.join(small(best), offered["record_id"] == best["_record"]).select("_key", F.explode(F.expr("sequence(0, _copies - 1)")).alias("_copy"), F.col("payload").alias("_given"))
    taken = found.where(again).drop("payload").withColumn("_key", key).join(small(best.drop("_record")), "_key", "left")
    taken = taken.withColumn("_copy", F.pmod(F.xxhash64("record_id"), F.col("_copies")).cast("int")).join(given.dropDuplicates(["_key", "_copy"]), ["_key", "_copy"], "left")
    own = ("record_id", "page_id", "url")
    known = taken.select(*own, F.col("_given").alias("payload"), "record_type", F.col("_page").alias("refers_to"), F.when(F.col("_copies").isNull(), "response missing").otherwise("ok").alias("status"))
    return found.where(~F.coalesce(again, F.lit(False))).select(*own, "payload", "record_type", F.lit(None).cast("long").alias("refers_to"), "status").unionByName(known)


def digests(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status, from the payloads that were read."""
    return read.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), _base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to", "status")


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Pages written as archives into the shared folder and read back, as digests of their payloads."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, segment)
    return digests(read_archives(pages.sparkSession, path))
