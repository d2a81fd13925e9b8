"""WARC archives: captures written as request, response and metadata records, and put together again by their concurrent-to identifiers (operator 13)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import discard, materialize, shared_dir, ship, table

#: Payloads of fewer bytes are always stored whole.
LEAST = 1000
#: Compressed bytes after which a task starts its next archive, and the date of records whose table has none.
ARCHIVE, DATE = 1 << 30, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Types of records that stand for a capture; all others belong to one of these.
ANCHORS = ("response", "revisit", "resource")
#: Bytes of blocks after which the reader hands a batch on.
BATCH_BYTES = 4_000_000
RECORD = "file string, place long, record_id string, type string, concurrent array<string>, refers_to string, uri string, date string, digest string, head string, payload_bytes long, payload_digest string, payload binary"
FIELDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]


def store_of(path: str) -> tuple[FileSystem, str]:
    """The store and the path within it, of a local path or the address of any store that Arrow knows."""
    path = re.sub(r"^file:/+", "/", path)
    return FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def urn(*parts: str | None) -> str:
    """A record's identifier: the same for the same parts, so a task that runs again names its records as before."""
    said = "\0".join("-" if p is None else f"+{p}" for p in parts)
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(said.encode('utf-8', 'surrogatepass')).digest(), version=3)}>"


def framed(kind: str, name: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress(b"".join(("\r\n".join(lines).encode("utf-8", "replace"), block, b"\r\n\r\n")), 1, mtime=0)


def capture(page: str | None, url: str | None, payload: bytes, digest: str, date: str, original: tuple[str | None, str | None] | None) -> Iterator[bytes]:
    """The three records of one capture; ``original``: page and url of the response that it revisits.

    The response names its request, and the metadata record names the response, as crawlers do.
    """
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    host, path = re.match(r"(?:[^:/?#]*://)?([^/?#]*)([^#]*)", uri or "").groups()
    kind = "revisit" if original else "response"
    request, name = urn("request", page, url, digest), urn(kind, page, url, digest)
    about = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    http = "application/http; msgtype="
    yield framed("request", request, [*about, ("Content-Type", f"{http}request")], f"GET {path if path.startswith('/') else '/' + path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "replace"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    said = [*about, ("WARC-Concurrent-To", request), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", f"{http}response")]
    if original:
        yield framed(kind, name, [*said, ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn("response", *original, digest))], head)
    else:
        yield framed(kind, name, said, head + payload)
    yield framed("metadata", urn("metadata", page, url, digest), [*about, ("WARC-Concurrent-To", name), ("Content-Type", "application/warc-fields")], b"" if page is None else f"page_id: {page}\r\n".encode())


def _write(batches: Iterator[pa.RecordBatch], at: str, most: int, date: str) -> Iterator[pa.RecordBatch]:
    store, folder = store_of(at)
    store.create_dir(folder, recursive=True)
    out, name, made, done = None, "", 0, []
    for batch in batches:
        for page, url, payload, digest, again, to_page, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                name, made = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20)
            for x in capture(page, url, payload, digest, date, (to_page, to_url) if again else None):
                out.write(x)
                made += 1
            if out.tell() >= most:
                out.close()
                out = done.append((f"{at}/{name}", made))
    if out is not None:
        out.close()
        done.append((f"{at}/{name}", made))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])


def write_archives(pages: DataFrame, at: str, least: int = LEAST, archive: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """``path, records`` of the gzip-compressed archives that now hold a capture for each row of ``page_id, url, html``, in the folder ``at``.

    Of rows with equal payloads (SHA-1, a second hash and length agree) of at least ``least`` bytes, that
    with the largest page_id, then url, is a response and the others revisit it; rows that repeat
    page_id, url and payload are copies of one record and share its identifiers. Nulls come before all
    values; a null html is an empty payload, a null url no target; blanks and controls of a url are
    percent-encoded. Other columns are not read. An empty table writes no archive. Each task writes its own archives; only those of tasks
    that ended well are listed, so lost and repeated tasks leave no doubled records.

    Only keys are shuffled to find equal payloads, and only payloads that occur again are met by a join, which
    Spark broadcasts if its size allows.
    """
    spark = pages.sparkSession
    ship(spark)
    src = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").alias("order"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keys = src.withColumns({"digest": F.sha1("payload"), "second": F.xxhash64("payload"), "size": F.octet_length("payload")})
    # a page of another url or id is what revisits; copies of the response itself stay responses
    groups = keys.where(F.col("size") >= least).groupBy("digest", "second", "size").agg(F.max(F.struct("order", "url", "page")).alias("to"), F.min(F.struct("order", "url", "page")).alias("from")).where(~F.col("to").eqNullSafe(F.col("from")))
    groups = materialize(groups.select(*(F.col(c).alias(f"g_{c}") for c in ("digest", "second", "size")), F.lit(True).alias("again"), F.col("to.page").alias("to_page"), F.col("to.url").alias("to_url")), "payloads")
    met = keys.join(groups, [F.col(c) == F.col(f"g_{c}") for c in ("digest", "second", "size")], "left")
    again = F.coalesce("again", F.lit(False)) & ~(F.col("page").eqNullSafe(F.col("to_page")) & F.col("url").eqNullSafe(F.col("to_url")))
    rows = met.select("page", "url", "payload", "digest", again.alias("again"), "to_page", "to_url")
    return materialize(rows.mapInArrow(partial(_write, at=at, most=archive, date=date), "path string, records long"), "archives")


def parsed(stream: io.BufferedIOBase, name: str) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Named fields (lower case) and block of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: {line[:40]!r} where a record should begin")
        fields: dict[str, list[str]] = {}
        last = ""
        while (line := stream.readline()).strip():
            said = line.decode("utf-8", "replace").rstrip("\r\n")
            if said[0] in " \t" and last:  # a folded line
                fields[last][-1] = f"{fields[last][-1]} {said.strip()}".strip()
            else:
                last, _, value = said.partition(":")
                fields.setdefault(last := last.strip().lower(), []).append(value.strip())
        size = int(fields.get("content-length", ["-1"])[0])
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) < size:
            raise ValueError(f"{name}: a record of type {fields.get('warc-type')} is cut short")
        yield fields, block


def hex_digest(said: str | None) -> str | None:
    """``sha1:`` and 32 base-32 or 40 hexadecimal digits as bare lower-case hex; others are null."""
    if said is None or not said.lower().startswith("sha1:"):
        return None
    digits = said[5:].strip()
    return base64.b32decode(digits.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", digits) else digits.lower() if re.fullmatch(r"[0-9A-Fa-f]{40}", digits) else None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = store_of(path)
            rows, held = [], 0
            with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as raw:
                file = io.BufferedReader(raw, 1 << 20)
                packed = file.peek(2)[:2] == b"\x1f\x8b"
                stream = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 18) if packed else file
                for place, (fields, block) in enumerate(parsed(stream, path)):
                    one = lambda k, f=fields: f.get(k, [None])[0]
                    kind, head, payload = one("warc-type"), None, None
                    if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    elif kind in ("response", "resource", "conversion"):
                        payload = block
                    else:
                        head = block
                    if kind == "revisit":
                        payload = None
                    size, digest = (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())
                    rows.append((path, place, one("warc-record-id"), kind, fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), hex_digest(one("warc-payload-digest")), None if head is None else head.decode("utf-8", "replace"), size, digest, payload if payloads else None))
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind_) for i, kind_ in enumerate(FIELDS)], names)
                        rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind_) for i, kind_ in enumerate(FIELDS)], names)


def read_records(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in column ``path``, read as streams, gzip-compressed or plain; see ``RECORD``.

    ``head`` is the HTTP head of a response or revisit, or the block of a record that has no payload; ``payload`` (null if not asked for) is
    a response's body or the whole block of other content, with its length and SHA-1 as read, ``digest`` what the
    record says. A file that breaks off or holds something else is an error that names it. No files give no rows.
    """
    ship(files.sparkSession)
    n = files.count()
    dealt = files.select("path").repartitionByRange(max(1, n), "path")
    return dealt.mapInArrow(partial(_read, payloads=payloads), RECORD)


def archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path`` of the archives that a path or glob names, for ``read_records``."""
    return spark.read.format("binaryFile").load(path).select("path")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response, revisit or resource record with the request and metadata records tied to it by concurrent-to.

    Identifiers tie records in either direction, directly or through one record between (metadata
    that names the request). A record tied to several captures goes to the one of least identifier. ``request`` and
    ``metadata`` are a capture's records of least identifier; every other record of the table,
    tied to nothing or beyond these, is a row of its own without response, so each record is in exactly one row. Copies of one identifier
    are one request or metadata record; copies of a response are captures of their own. Records without an identifier are tied to nothing.
    """
    is_anchor = F.coalesce(F.col("type").isin(*ANCHORS), F.lit(False))
    light = records.select("record_id", is_anchor.alias("anchor"), "concurrent")
    said = light.select("record_id", F.explode("concurrent").alias("other")).where("record_id is not null")
    ties = said.unionByName(said.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    captures = light.where("anchor and record_id is not null").select(F.col("record_id").alias("capture")).distinct()
    rest = light.where("not anchor and record_id is not null").select("record_id").distinct()
    ties = materialize(ties.join(rest, "record_id"), "ties")  # from records that want a capture
    direct = ties.join(captures, F.col("other") == F.col("capture")).groupBy("record_id").agg(F.min("capture").alias("capture"))
    direct = materialize(direct, "direct")
    far = ties.join(direct.select("record_id").withColumnRenamed("record_id", "has"), F.col("record_id") == F.col("has"), "left_anti")
    far = far.join(direct.select(F.col("record_id").alias("via"), "capture"), F.col("other") == F.col("via")).groupBy("record_id").agg(F.min("capture").alias("capture"))
    owned = direct.unionByName(far)
    others = records.where(~is_anchor)
    first = others.join(owned, "record_id").groupBy("capture", "type").agg(F.min(F.struct("record_id", "head")).alias("x"), F.count_distinct("record_id").alias("n"))
    first = materialize(first, "firsts")
    part = lambda kind: first.where(F.col("type") == kind).select(F.col("capture").alias(f"{kind}_of"), F.col("x").alias(kind), F.col("n").alias(f"n_{kind}"))
    own = records.where(is_anchor)
    tied = own.join(part("request"), F.col("record_id") == F.col("request_of"), "left").join(part("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
    cols = [F.col("record_id"), F.col("type"), "uri", "date", "refers_to", "file", "place"]
    response = F.struct("head", "digest", "payload_bytes", "payload_digest", "payload").alias("response")
    whole = tied.select(*cols, response, "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))
    used = first.where(F.col("type").isin("request", "metadata")).select(F.col("x.record_id").alias("used"))
    alone = others.join(used, F.col("record_id") == F.col("used"), "left_anti")
    mine = lambda kind: F.when(F.col("type") == kind, F.struct("record_id", "head")).alias(kind)
    loose = alone.select(*cols, F.lit(None).cast(whole.schema["response"].dataType).alias("response"), mine("request"), mine("metadata"), (F.col("type") == "request").cast("long").alias("n_requests"), (F.col("type") == "metadata").cast("long").alias("n_metadata"))
    return whole.unionByName(loose)


def resolved(captures: DataFrame) -> DataFrame:
    """Captures with ``original``: record_id, payload_bytes, payload_digest and metadata of the response that a revisit refers to; null if it isn't there.

    Any number of revisits may refer to one response: only its few values travel, and a join too large to broadcast is split at hot identifiers.
    """
    wanted = captures.where("type = 'revisit'").select(F.col("refers_to").alias("wanted")).distinct()
    found = captures.where("type = 'response'").join(wanted, F.col("record_id") == F.col("wanted"), "left_semi")
    originals = found.groupBy(F.col("record_id").alias("original_id")).agg(F.min(F.struct("record_id", "response.payload_bytes", "response.payload_digest", "metadata")).alias("original"))
    originals = materialize(originals, "originals")
    return captures.join(originals, (F.col("type") == "revisit") & (F.col("refers_to") == F.col("original_id")), "left").drop("original_id")


def field(of: str, name: str) -> F.Column:
    """The value of a field of a warc-fields block; null if it isn't there."""
    found = F.regexp_extract(F.col(of), rf"(?m)^{re.escape(name)}:[ \t]*(.*?)\r?$", 1)
    return F.when(F.col(of).rlike(rf"(?m)^{re.escape(name)}:"), found)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``page_id, url, html``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, as read back from archives written for it.

    See ``write_archives`` for which row is a response and for nulls, ties, repeated rows and clashing columns. Very long payloads
    are read one at a time. An empty table gives no rows. Archives are deleted once their records are known.
    """
    spark = pages.sparkSession
    at = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, at, least)
    records = materialize(read_records(files, payloads=False), "records")
    files.stored_at = at
    discard(files)
    whole = resolved(materialize(assemble(records), "captures"))
    kind = pages.schema["page_id"].dataType
    return whole.where(F.col("type").isin("response", "revisit")).select(
        field("metadata.head", "page_id").cast(kind).alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        field("original.metadata.head", "page_id").cast(kind).alias("refers_to"),
    )


def op13_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all pages, read back from archives written for them."""
    return round_trip(table(spark, sf_dir, "pages"))


OP13_SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
g as (select html, max(page_id) as last from p where n >= 1000 group by html)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type,
  case when last <> page_id then last end as refers_to
from p left join g on p.html = g.html and n >= 1000
"""
