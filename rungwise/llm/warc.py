"""WARC writing, and reading with segment reassembly.

Writing: a page becomes a ``response`` record whose HTTP body is chunked; a record block over the
segment size is split into a first record and ``continuation`` records (ISO 28500: segment number,
origin id, total length on the last).  Of pages with equal payloads the one with the smallest id is
written in full, the others as ``revisit`` records that refer to it.  Records go out through Spark's
text sink with the blank lines that end a record as its line separator, so that files are committed
by Spark and lie in the shared folder; a bound on rows a file keeps each readable as one value.

Reading: files, plain or of one or many gzip members, are inflated and parsed by Content-Length piece by
piece; continuation records are grouped by their origin id, ordered by segment number and checked
against the total length; then chunked framing, where the header names it, is decoded and a SHA-1 digest,
where there is one, checked.  A file is read as one value, so it must stay under 2 GB compressed.

Defined results: null html is an empty payload; of equal payloads with equal ids, or none with an id,
the record id decides; null ids are larger than all others; equal rows are records of their own;
payloads of any length are segmented; a record that is incomplete or fails a check raises an error;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwise.llm.common import materialise, shared_path, small_batches, table

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
#: Records in a file at most, so at most this many segments of 64 KB.
FILE_RECORDS = 400
MIN_REVISIT_BYTES = 0
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The chunked transfer framing of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";", 1)[0], 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + size])
        at += size + 2


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records(record_id: str, page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The WARC records of a page, without the blank lines that end each."""
    fields = [("WARC-Target-URI", _one_line(url or "")), ("X-Page-ID", "" if page_id is None else str(int(page_id))), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to:
        more = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield _record("revisit", record_id, http, fields + more)
        return
    block = http + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record("response", record_id, block, fields)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record("response", record_id, parts[0], [*fields, ("WARC-Segment-Number", "1")])
    for number, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(number))]
        if number == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record("continuation", f"{record_id}:{number}", part, more)


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content piece by piece; of gzipped content that of all its members, the last of which must be whole."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, member = memoryview(content), 0, None
    while at < len(content):
        if member is None:
            if not bytes(view[at : at + step]).strip(b"\0"):  # padding
                at += step
                continue
            member = zlib.decompressobj(31)
        yield member.decompress(view[at : at + step])
        at += min(step, len(content) - at)
        if member.eof:
            at -= len(member.unused_data)
            member = None
    if member is not None:
        raise ValueError("a gzip member ends early")


def parse(pieces: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive, found by length alone."""
    held, at, need = bytearray(), 0, 0  # need: bytes without which nothing more can be read
    for piece in [pieces] if isinstance(pieces, bytes) else pieces:
        held += piece
        while len(held) >= need and held:
            stop = held.find(_END)
            if stop < 0:
                need = len(held) + 1
                break
            lines = held[:stop].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            begin = stop + len(_END)
            end = begin + int(fields["content-length"])
            need = end + len(_END)
            if len(held) < need:
                break
            if held[end:need] != _END:
                raise ValueError(f"the record at byte {at} has another length than it says")
            yield fields, bytes(held[begin:end])
            del held[:need]
            at, need = at + need, 0
    if held:
        raise ValueError(f"the record at byte {at} ends early")


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) to gzipped WARC files in ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Written once: a record's id must be the same wherever it is named.
    keyed = materialise(
        pages.select("page_id", "url", "html").withColumns({"sha": F.sha1(payload.cast("binary")), "size": F.octet_length(payload).cast("long")}).withColumn("ordinal", F.monotonically_increasing_id()),
        "warc-pages",
    )
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("ordinal").alias("ordinal"))
    first = keyed.filter(F.col("size") >= min_revisit).groupBy("sha").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = keyed.select("sha", "size", "ordinal").join(first, "sha").filter(f"size >= {int(min_revisit)} AND ordinal <> first.ordinal").select("ordinal", F.col("first.ordinal").alias("origin"))
    # Ids only, and written, so that Spark knows their size: pages are shuffled only if they can't be broadcast.
    revisits = materialise(revisits, "warc-revisits")
    linked = keyed.join(revisits, "ordinal", "left").select("page_id", "url", F.when(F.col("origin").isNull(), F.col("html")).alias("html"), "sha", "ordinal", "origin")

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made, size = [], 0
            for page_id, url, html, sha, ordinal, origin in batch.itertuples(index=False, name=None):
                refers = None if pd.isna(origin) else _name(origin)
                body = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                for r in records(_name(ordinal), None if pd.isna(page_id) else page_id, url, body, digest, refers, segment_bytes):
                    made.append(r)
                    size += len(r)
                    if size > 8 << 20:
                        yield pd.DataFrame({"record": made})
                        made, size = [], 0
            if made:
                yield pd.DataFrame({"record": made})

    strings = small_batches(linked).withColumns({c: F.col(c).cast("string") for c in ("page_id", "ordinal", "origin")}).mapInPandas(out, "record binary")
    strings.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _name(ordinal) -> str:
    return f"urn:rungwise:record:{int(ordinal)}"


#: Names of archives in a folder: those that are written here, and the usual ones.
FILES = "{part-*,*.warc,*.warc.gz}"
_COLUMNS = {"record_id": "string", "kind": "string", "page_id": "long", "url": "string", "digest": "string", "refers_to": "string", "origin": "string", "segment": "int", "total": "long", "block": "binary", "size": "long"}
_PARSED = ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())
#: Bytes of blocks in a frame that goes back to Spark, about.
_FRAME_BYTES = 8 << 20


def _payload(block: bytes, digest: str | None) -> bytes:
    """The body of a whole response block, without chunked framing if its header names that.

    A SHA-1 digest of the record must be that of the body, framed or not; anything else is an error.
    """
    head, found, raw = block.partition(_END) if block[:5] == b"HTTP/" else (b"", b"", block)
    fields = [x.partition(b":") for x in head.lower().split(b"\r\n")]
    body = dechunked(raw) if any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in fields) else raw
    if digest and digest not in (digest_of(body), digest_of(raw)):
        raise ValueError("a payload has another digest than its record")
    return body


def scan(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``.

    Responses in one piece are decoded and checked here: block is their payload (null if it isn't
    wanted) and size its length. Segments keep their raw block.
    """

    def row(f: dict[str, str], block: bytes) -> tuple:
        page, segment, digest = f.get("x-page-id", ""), int(f.get("warc-segment-number", 0)), f.get("warc-payload-digest", "")
        digest = digest[5:].upper() if digest[:5].lower() == "sha1:" else None
        size = None
        if f["warc-type"] == "response" and not segment:
            block = _payload(block, digest)
            size, digest = len(block), digest or digest_of(block)
        keep = segment or (with_payload and size is not None)
        named = lambda k: f.get(k, "").strip("<>") or None
        total = f.get("warc-segment-total-length")
        return (named("warc-record-id"), f["warc-type"], int(page) if page else None, f.get("warc-target-uri"), digest, named("warc-refers-to"), named("warc-segment-origin-id"), segment, int(total) if total else None, block if keep else None, size)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                made, size = [], 0
                for f, block in parse(inflated(content)):
                    made.append(row(f, block))
                    size += len(made[-1][9] or b"") + 200
                    if size > _FRAME_BYTES:
                        yield _frame(made)
                        made, size = [], 0
                if made:
                    yield _frame(made)

    files = small_batches(spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(path).select("content"))
    return files.mapInPandas(rows, _PARSED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(_COLUMNS), dtype=object)


_HEAD = ("record_id", "kind", "page_id", "url", "digest", "refers_to")


def reassemble(parsed: DataFrame) -> DataFrame:
    """The blocks of segmented records, joined in order and checked for their total length.

    The records of one origin are the segments of one page, so a group is as large as a page.
    """
    parts = parsed.filter("segment > 0").withColumn("of", F.coalesce("origin", "record_id"))
    grouped = parts.groupBy("of").agg(
        F.min_by(F.struct(*_HEAD), "segment").alias("head"),
        F.max("total").alias("total"),
        F.max("segment").alias("n"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    # Joined as hexadecimal digits, since Spark's concat of an array's binary elements is for strings.
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    complete = (F.size("parts") == F.col("n")) & (F.octet_length("block") == F.col("total"))
    checked = F.when(complete, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing from "), "of")).cast("binary"))
    return grouped.withColumn("block", joined).withColumn("block", checked).select("head.*", "block")


def responses(parsed: DataFrame) -> DataFrame:
    """record_id, page_id, url, payload_bytes, payload_digest, payload of every response, whole or segmented."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [_payload(b, d) for b, d in zip(batch["block"], batch["digest"])]
            digests = [d or digest_of(b) for b, d in zip(bodies, batch["digest"])]
            yield batch[["record_id", "page_id", "url"]].assign(digest=digests, size=[len(b) for b in bodies], block=bodies)

    columns = ["record_id", "page_id", "url", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("block").alias("payload")]
    whole = parsed.filter("segment = 0 AND kind = 'response'").select(*columns)
    segmented = reassemble(parsed).mapInPandas(decode, "record_id string, page_id long, url string, digest string, size long, block binary")
    return whole.unionByName(segmented.select(*columns))


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload
    (null for revisits, or if it isn't wanted).

    The archives are parsed once, into a table of headers, segments and wanted payloads. A revisit has
    its origin's figures, joined by the origin's id: many revisits of one origin are rows of a skewed
    join side, which Spark splits, against one narrow row. An origin that is missing or of another
    digest is an error.
    """
    parsed = materialise(scan(spark, path, with_payload), "warc-parsed")
    got = responses(parsed)
    if not with_payload:
        got = materialise(got.drop("payload"), "warc-figures").withColumn("payload", F.lit(None).cast("binary"))
    revisit = parsed.filter("kind = 'revisit'").select("page_id", "url", "digest", "refers_to", "record_id")
    origin = got.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("origin_page"), "payload_bytes", "payload_digest")
    bad = F.col("payload_digest").isNull() | (F.col("payload_digest") != F.col("digest"))
    size = F.when(bad, F.raise_error(F.concat(F.lit("no origin for "), "record_id")).cast("long")).otherwise(F.col("payload_bytes"))
    found = revisit.join(origin, "refers_to", "left").select("page_id", "url", size.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("origin_page").alias("refers_to"), F.lit(None).cast("binary").alias("payload"))
    kinds = {"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}
    return got.withColumns(kinds).select(*found.columns).unionByName(found)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# A base32 digit is five bits: four of them are five hexadecimal digits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {shift}) & 31 AS INT), 1)" for i in range(8) for shift in (15, 10, 5, 0))
OP5_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first OR payload_bytes < {MIN_REVISIT_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first AND payload_bytes >= {MIN_REVISIT_BYTES} THEN first END AS refers_to FROM f
"""
