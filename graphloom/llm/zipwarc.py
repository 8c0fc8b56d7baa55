"""WARC records in ZIP packages: writing, and reading by byte ranges without extraction.

A package is a ZIP file of stored (uncompressed) members, ``archive/data.warc.gz``
(one gzip member per record) and ``indexes/index.cdxj`` (one line per record: id,
offset, length).  The reader takes the end-of-central-directory record, the ZIP64
locator and record where they are present, and the central directory from the tail of
the file, then reads the index member and the ranges of the records that it wants.

Defined cases: a null payload is empty; a null or odd URL is percent-escaped; ids may be
null (such a record is a response unless its payload repeats that of a record with an
id); rows that repeat an id and its payload are all responses; a payload of any length is
one record (it must fit into a task's memory); an empty table gives no package and no
records; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import n_partitions, open_fs, scratch, small_side, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of package that one read of adjacent records fetches at most (a larger record is read alone).
READ_BYTES = 8 << 20
#: Bytes from which a package is closed and the next one begun.
PACKAGE_BYTES = 256 << 20
#: Bytes of package that one reading task takes.
SPLIT_BYTES = 32 << 20


# --- ZIP directories ---------------------------------------------------------------------------


def zip_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the bytes, length) of the stored members of an open package."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    here = tail_at + end - 20
    if here >= 0 and (locator := at(here, 20))[:4] == b"PK\6\7":
        (record_at,) = struct.unpack("<Q", locator[8:16])
        record = at(record_at, 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points nowhere")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, p, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("the central directory is broken")
        method, packed, plain, n, extra_n, comment_n = struct.unpack("<10xH8xIIHHH", directory[p : p + 34])
        (offset,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n].decode()
        extra, q = directory[p + 46 + n : p + 46 + n + extra_n], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[q + 4 : q + 4 + width // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            q += 4 + width
        p += 46 + n + extra_n + comment_n
        if method == 0 and packed == plain:
            local = at(offset, 30)
            if local[:4] != b"PK\3\4":
                raise ValueError(f"no local header of {name}")
            name_n, local_extra = struct.unpack("<HH", local[26:30])
            out[name] = (offset + 30 + name_n + local_extra, plain)
    return out


# --- records -----------------------------------------------------------------------------------


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    name = lambda i: f"<urn:page:{'none' if i is None else int(i)}>"
    http = b"" if refers_to is not None else (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    )
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http)}",
    ]
    if refers_to is not None:
        head[7:7] = [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2] if body else b""


def number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


# --- operator ----------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, html`` with ``digest`` and ``refers_to`` (null: this record is a response).

    Only ids and digests are shuffled, and aggregated before; the payloads that repeat come to
    the pages by broadcast where their count allows it, else by a join on the digest, whose
    hot partitions Spark splits.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    first = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    first = staged(first, "first")
    return rows.join(small_side(first, first.count()), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    )


class Package:
    """A package that is being written."""

    def __init__(self, fs, base: str):
        fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}.wacz"
        self.out = fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.at = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}).encode())
        self.at += len(packed)

    def close(self) -> pd.DataFrame:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as m:
            m.write(b"\n".join(self.index))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return pd.DataFrame({"path": [self.path], "bytes": [size], "records": [len(self.index)]})


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``mark_revisits`` rows, packages of about ``PACKAGE_BYTES`` by task, and returns the manifest ``(path, bytes, records)``.

    A repeated task writes under another name; only names in the manifest, which Spark commits, count.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        package = None
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                package = package or Package(fs, base)
                page_id = None if pd.isna(page_id) else int(page_id)
                record = warc_record(page_id, url, html.encode("utf-8", "replace"), digest, None if pd.isna(refers) else int(refers))
                package.add(page_id, record)
                if package.at >= PACKAGE_BYTES:
                    yield package.close()
                    package = None
        if package:
            yield package.close()

    return staged(rows.mapInPandas(work, "path string, bytes long, records long"), "manifest")


def read_index(manifest: DataFrame, folder: str) -> DataFrame:
    """``(path, offset, length)`` of every record, ``offset`` within the package file."""

    def work(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            for path, size in zip(batch["path"], batch["bytes"], strict=True):
                with fs.open_input_file(path) as f:
                    members = zip_members(f, int(size))
                    start, length = members[INDEX]
                    f.seek(start)
                    lines = [json.loads(x) for x in f.read(length).split(b"\n") if x]
                    base = members[DATA][0]
                yield pd.DataFrame({"path": path, "offset": [base + x["offset"] for x in lines], "length": [x["length"] for x in lines]})

    return manifest.mapInPandas(work, "path string, offset long, length long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Range-reads the records of ``index``: headers, size and digest of the payload that was read.

    Adjacent records come in one read of at most ``READ_BYTES``.
    """

    def work(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            rows = []
            for path, own in batch.sort_values(["path", "offset"]).groupby("path", sort=False):
                with fs.open_input_file(path) as f:
                    spans = list(zip(own["offset"], own["length"], strict=True))
                    i = 0
                    while i < len(spans):
                        j, end = i, spans[i][0]
                        while j < len(spans) and spans[j][0] == end and (j == i or end + spans[j][1] - spans[i][0] <= READ_BYTES):
                            end += spans[j][1]
                            j += 1
                        f.seek(spans[i][0])
                        chunk = f.read(end - spans[i][0])
                        for offset, length in spans[i:j]:
                            raw = gzip.decompress(chunk[offset - spans[i][0] :][:length])
                            h, payload = parse_record(raw)
                            revisit = h["warc-type"] == "revisit"
                            digest = h["warc-payload-digest"].partition(":")[2]
                            if not revisit:
                                found = hashlib.sha256(payload).hexdigest()
                                if found != digest:
                                    raise ValueError(f"{path}: the payload at {offset} does not match its digest")
                            rows.append(
                                (number(h["warc-record-id"]), int(h["warc-payload-length"]) if revisit else len(payload), digest,
                                 h["warc-type"], number(h.get("warc-refers-to")), path, int(offset))
                            )
                        i = j
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "package", "offset"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, offset long"
    dealt = index.repartition(n_partitions(index.sparkSession), "path", F.expr(f"offset div {SPLIT_BYTES}"))
    return dealt.mapInPandas(work, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to packages in ``folder`` and reads every record back."""
    folder = folder or scratch(pages.sparkSession, "wacz")
    manifest = write_packages(mark_revisits(pages), folder)
    return read_records(read_index(manifest, folder), folder)
