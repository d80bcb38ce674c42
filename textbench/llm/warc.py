"""WARC archives of pages: one gzip stream for a whole file, normalised to one member for each record with an offset index (operator 7)."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbench.llm.shared import bounded, new_path, row_key, spread_join, staged

#: Records of a new archive file until its payloads reach so many bytes; bytes that are read at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 20
_LAST = (1 << 63) - 1
_NAME = "archive string, records long, bytes long"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response, or a revisit without the payload, whose HTTP head keeps the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", page_name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, chunk by chunk."""
    z, open_ = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            open_ = True
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z, open_ = zlib.decompressobj(31), False
    if open_:
        raise ValueError("the gzip stream ends inside a member")


def records(stream) -> Iterator[bytes]:
    """Each whole record of a gzipped WARC stream, holding one record at a time."""
    held = bytearray()
    need = None
    for data in inflated(stream):
        held += data
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("no WARC record where one should start")
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the last record is cut short")


def _report(names: list[tuple[str, int, int]]) -> pa.RecordBatch:
    a, n, b = zip(*names) if names else ((), (), ())
    return pa.record_batch({"archive": pa.array(a, pa.string()), "records": pa.array(n, pa.int64()), "bytes": pa.array(b, pa.int64())})


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, revisit and refers_to into .warc.gz files, each one gzip stream; (archive, records, bytes).

    A task names its files anew, and only those of tasks that ended are reported, so a task can run again at any time.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        names, out, z, n, size = [], None, None, 0, 0
        path = ""

        def close():
            if out:
                out.write(z.flush())
                names.append((path, n, size))
                out.close()

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= ARCHIVE_BYTES:
                    close()
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = store.open_output_stream(path, compression=None), zlib.compressobj(6, wbits=31), 0, 0
                payload = (html or "").encode()
                out.write(z.compress(record(page_id, url, payload, digest(payload), refers_to, revisit)))
                n, size = n + 1, size + len(payload)
        close()
        yield _report(names)

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return staged(pages.select("page_id", "url", "html", "revisit", "refers_to").mapInArrow(write, _NAME))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflates each archive once from end to end and writes it anew with a gzip member for each record, and beside it
    <archive>.idx: a line of offset, length, type and record ID for each member. Returns (archive, records, bytes)."""

    def rewrite(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = []
            for archive in batch.column(0).to_pylist():
                path, at, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                source, target, index = store.open_input_stream(archive, compression=None), store.open_output_stream(path, compression=None), store.open_output_stream(path + ".idx", compression=None)
                with source, target, index:
                    for whole in records(source):
                        h = headers(whole[: whole.index(b"\r\n\r\n")])
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(whole) + z.flush()
                        target.write(member)
                        index.write(f"{at}\t{len(member)}\t{h['warc-type']}\t{h['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                names.append((path, n, at))
            yield _report(names)

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return staged(archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(rewrite, _NAME))


def _parsed(whole: bytes) -> tuple:
    end = whole.index(b"\r\n\r\n")
    h, block = headers(whole[:end]), whole[end + 4 : -4]
    cut = block.index(b"\r\n\r\n")
    length, body, sha = int(headers(block[:cut])["content-length"]), block[cut + 4 :], h["warc-payload-digest"].partition(":")[2]
    if h["warc-type"] == "response" and (len(body) != length or digest(body) != sha):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    number = lambda name: int(x) if (x := re.fullmatch(r"<urn:page:(-?\d*)>", name)[1]) else None
    refers = number(h["warc-refers-to"]) if "warc-refers-to" in h else None
    return number(h["warc-record-id"]), h.get("warc-target-uri"), length, sha, h["warc-type"], refers, body.decode() if h["warc-type"] == "response" else None


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record, each read by its own entry of the offset index; digests of responses are verified."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(archive + ".idx", compression=None) as f:
                    index = f.read().decode().splitlines()
                with store.open_input_file(archive) as f:
                    for lo in range(0, len(index), 256):
                        rows = []
                        for line in index[lo : lo + 256]:
                            at, length, *_ = line.split("\t")
                            f.seek(int(at))
                            rows.append(_parsed(zlib.decompress(f.read(int(length)), 31)))
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    return archives.select("archive").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages written as WARC archives, normalised and read back: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and html (null for revisits).

    Of records with equal payloads of `least_bytes` bytes or more, that with the smallest page_id is a response, the others
    revisit it; smaller ones are all responses. Equal payloads are found by SHA-1 and length in a partial aggregate; only the
    revisits' keys are joined back to the pages.

    Defined cases: null html is an empty payload; a null page_id counts as larger than any and reads back as null; rows that
    repeat the smallest page_id and payload are all responses; a null url is left out; white space in a url is escaped; an
    empty table gives no archive and no row; other columns are left behind.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("k", row_key("page_id", "url", "html"))
    html, last = F.coalesce("html", F.lit("")), F.coalesce("page_id", F.lit(_LAST))
    marks = rows.select("k", last.alias("p"), F.sha1(html.cast("binary")).alias("s"), F.octet_length(html).alias("n")).filter(F.col("n") >= least_bytes)
    first = staged(marks.groupBy("s", "n").agg(F.min("p").alias("refers_to"), F.count("*").alias("m")).filter("m > 1"))
    again = staged(spread_join(marks, first.drop("m"), first, ["s", "n"], ["k"]).filter("p > refers_to").select("k", "refers_to").distinct())
    rows = rows.join(bounded(again), "k", "left").withColumn("revisit", F.col("refers_to").isNotNull())
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(normalise(write_archives(rows, f"{folder}/whole"), f"{folder}/members"), f"{folder}/members")
