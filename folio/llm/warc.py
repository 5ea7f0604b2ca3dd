"""WARC archives: written a record a page, read back with their segments put together.

A payload is the body of an HTTP response in chunked transfer framing. Blocks beyond
``SEGMENT`` bytes are cut: the first part is a response record of segment number 1, the
others are continuation records that name it as their origin, and the last one gives the
total length. A page whose payload another page of larger id also has becomes a revisit
record without a block. Each record is a gzip member of its own; Spark's text writer
puts an empty member between two of them, so the files are plain .warc.gz.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialize, work_dir

SEGMENT, CHUNK, LEAST_REVISIT = 64_000, 16_000, 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PREFIX = "urn:page:"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(kind: str, record_id: str, block: bytes, **fields) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    head = "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _written(batches):
    for pdf in batches:
        out = []
        for page, url, payload, digest, refers in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers"], strict=True):
            own, uri = f"{PREFIX}{page}", None if url is None else " ".join(url.split())
            if refers is not None:
                out.append(_record("revisit", own, b"", Target_URI=uri, Payload_Digest=f"sha1:{digest}", Refers_To=f"<{PREFIX}{refers}>", Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                continue
            block = HTTP + chunked(bytes(payload))
            parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
            more = len(parts) > 1
            out.append(_record("response", own, parts[0], Target_URI=uri, Payload_Digest=f"sha1:{digest}", Segment_Number=1 if more else None))
            for k, part in enumerate(parts[1:], 2):
                total = len(block) if k == len(parts) else None
                out.append(_record("continuation", f"{own}:{k}", part, Segment_Number=k, Segment_Origin_ID=f"<{own}>", Segment_Total_Length=total))
        yield pd.DataFrame({"record": out})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of pages to .gz archives under ``path``.

    A null html is an empty payload; null urls are left out of the record. Of rows with
    equal payloads of at least ``LEAST_REVISIT`` bytes those of the largest id are
    responses and the others revisits of it; a null id counts as the smallest.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("page"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.length("payload") >= LEAST_REVISIT).select("id", "digest")
    kept = large.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    revisits = large.join(kept, "digest").where(F.coalesce(F.col("id") < F.col("first"), F.lit(True))).select(F.coalesce(F.col("id"), F.lit(-1)).alias("rid"), F.col("digest").alias("rdigest"), F.col("first").cast("string").alias("refers")).distinct()
    rows = rows.join(revisits, (F.coalesce(F.col("id"), F.lit(-1)) == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    records = rows.select("page", "url", "payload", "digest", "refers").mapInPandas(_written, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).text(path)


def _members(content: bytes):
    """(bytes, error) of each gzip member that isn't empty. After a broken one the next start of a member is looked for."""
    at = 0
    while at < len(content):
        unzip, data, begin = zlib.decompressobj(31), [], at
        try:
            while not unzip.eof and at < len(content):
                data.append(unzip.decompress(content[at : at + (1 << 20)]))
                at += min(1 << 20, len(content) - at)
            at -= len(unzip.unused_data)
            if not unzip.eof:
                yield b"", "cut member"
            elif any(data):
                yield b"".join(data), None
        except zlib.error:
            yield b"", "broken member"
            following = content.find(b"\x1f\x8b\x08", begin + 1)
            at = following if following > 0 else len(content)


def _fields(record: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Header fields, block, and what is wrong with the record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v.strip() for k, _, v in pairs}
    numbers = [fields.get("content-length", ""), fields.get("warc-segment-number", "1"), fields.get("warc-segment-total-length", "0")]
    if not all(n.isascii() and n.isdigit() for n in numbers):
        return fields, b"", "bad header"
    size = int(numbers[0])
    return fields, rest[:size], None if len(rest) >= size else "cut record"


def _decoded(block: bytes, total: int) -> tuple[bytes | None, str | None]:
    """The payload of a response block, or what is wrong with it; ``total`` is the length it should have, or 0."""
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        if total and total != len(block):
            raise ValueError(f"{len(block)} of {total} bytes")
        return (unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body), None
    except ValueError as e:
        return None, str(e)


def _found(kind: str, block: bytes, total: int) -> tuple:
    payload, error = (None, None) if kind == "revisit" else _decoded(block, total)
    return payload, error, None if payload is None else hashlib.sha1(payload).hexdigest()


def _read(cut: bool):
    """Records that are segments, with their blocks, or all others, with their payloads."""

    def rows(batches):
        bare = lambda x: x[1:-1] if x else None
        columns = HEAD + (["segment", "total", "block"] if cut else ["payload", "error", "found"])
        for pdf in batches:
            for content in pdf["content"]:
                out, held = [], 0
                for record, error in _members(bytes(content)):
                    f, block, wrong = _fields(record) if error is None else ({}, b"", error)
                    get = f.get
                    if wrong is not None:
                        if not cut:
                            out.append(("unreadable", bare(get("warc-record-id")), get("warc-target-uri"), None, None, None, wrong, None))
                        continue
                    if cut != ("warc-segment-number" in f) or get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    rest = (int(get("warc-segment-number")), int(get("warc-segment-total-length", 0)), block) if cut else _found(get("warc-type"), block, 0)
                    own = bare(get("warc-segment-origin-id")) or bare(get("warc-record-id"))
                    out.append((get("warc-type"), own, get("warc-target-uri"), get("warc-payload-digest"), bare(get("warc-refers-to")), *rest))
                    held += len(block)
                    if held > 8_000_000:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
                yield pd.DataFrame(out, columns=columns)

    return rows


HEAD = ["kind", "record_id", "uri", "digest", "refers_to"]
_HEAD = ", ".join(f"{c} string" for c in HEAD)


def _joined(batches):
    for pdf in batches:
        found = [_found(k, bytes(b), t) for k, b, t in zip(pdf["kind"], pdf["block"], pdf["total"], strict=True)]
        yield pdf[HEAD].assign(payload=[x[0] for x in found], error=[x[1] for x in found], found=[x[2] for x in found])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """kind, record_id, uri, digest, refers_to, payload, found (the payload's SHA-1) and error of each response and revisit.

    Continuation records are grouped by their origin, ordered by segment number and held
    against the total length; a missing segment or broken chunk gives a null payload and
    an error, and a null kind if the first one is missing. Cut or broken members and records without a right length have kind unreadable
    and an error. Archives are read twice: whole records need no shuffle, segments do. A file is read whole by one task, as Spark's binaryFile reader does, so
    archives should be cut to some hundred MB.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    read = f"{_HEAD}, payload binary, error string, found string"
    whole = files.mapInPandas(_read(False), read)
    cut = files.mapInPandas(_read(True), f"{_HEAD}, segment int, total long, block binary")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    cut = cut.groupBy("record_id").agg(first("kind"), first("uri"), first("digest"), first("refers_to"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.aggregate(F.transform("parts", lambda x: x["block"]), F.lit(b""), lambda a, b: F.concat(a, b))
    cut = cut.select(*HEAD, F.when(F.col("total") > 0, F.col("total")).otherwise(F.lit(-1)).alias("total"), block.alias("block"))
    return whole.unionByName(cut.mapInPandas(_joined, read))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and say what was found: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size is that of the record it refers to, its digest its own. Null html is
    an empty payload; payloads of any length are written whole. A null id comes back as null; rows that repeat an id come back as often;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    path = work_dir(pages.sparkSession)
    write_archives(pages, path, id_col, url_col, html_col)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(PREFIX) + 1}) as long)")
    read = read_archives(pages.sparkSession, path)
    read = read.select("kind", number("record_id").alias("id"), number("refers_to").alias("refers"), F.length("payload").cast("long").alias("n"), F.coalesce("found", F.substring("digest", 6, 40)).alias("digest"))
    read = materialize(read)
    full = read.where(F.col("kind") == "response").groupBy(F.col("id").alias("tid"), F.col("digest").alias("tdigest")).agg(F.max("n").alias("full"))
    out = read.join(full, (F.col("refers") == F.col("tid")) & (F.col("digest") == F.col("tdigest")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", "full").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
