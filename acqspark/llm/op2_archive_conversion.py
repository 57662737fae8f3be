"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block whose third line names the fields of
the record header lines; version 1 has five, version 2 ten. Each record is a
header line, then as many bytes as the line declares. The converter reads the
version, parses the lines by the named fields, and writes WARC records with
identifiers, timestamps, types and digests made from what ARC holds. Records
with equal payloads become one response and revisits of it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, new_folder, staged
from .filesystem import create, open_read

#: An ARC file is closed at so many records or bytes of content.
ARC_RECORDS, ARC_BYTES = 1_000, 32 << 20
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = datetime(2000, 1, 1, tzinfo=timezone.utc)


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_uri(url: str | None) -> str:
    """The address as one field of a header line (null: a lone hyphen)."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|") if url else "-"


class ArcWriter:
    def __init__(self, folder: str, stem: str, version: int):
        self.path, self.out = create(folder, stem, ".arc.gz")
        self.version, self.records, self.bytes = version, 0, 0
        self.name = self.path.rsplit("/", 1)[1]
        body = f"{version} 0 crawl\n{FIELDS[version]}\n\n".encode()
        self._record(f"filedesc://{self.name}", "0.0.0.0", "20000101000000", "text/plain", body)
        self.records = 0

    def _record(self, uri: str, ip: str, date: str, kind: str, body: bytes) -> None:
        named = {"URL": uri, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-",
                 "Location": "-", "Offset": str(self.bytes), "Filename": self.name, "Archive-length": str(len(body))}
        line = " ".join(named[f] for f in FIELDS[self.version].split())
        self.out.write(_member(line.encode() + b"\n" + body + b"\n"))
        self.records += 1
        self.bytes += len(body)

    def add(self, page_id: int | None, url: str | None, payload: bytes) -> None:
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "")
        head += f"Content-Length: {len(payload)}\r\n\r\n"
        date = (_START + timedelta(seconds=(page_id or 0) % 1_000_000_000)).strftime("%Y%m%d%H%M%S")
        self._record(arc_uri(url), "0.0.0.0", date, "text/html", head.encode() + payload)

    def full(self) -> bool:
        return self.records >= ARC_RECORDS or self.bytes >= ARC_BYTES


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head, its fields by lower-case name, and payload of an HTTP response. A
    record of another protocol has no head, all of it is payload."""
    end = block.find(b"\r\n\r\n") + 4
    if not block.startswith(b"HTTP/") or end < 4:
        return b"", {}, block
    fields = dict(line.split(":", 1) for line in block[:end].decode("latin-1").split("\r\n")[1:] if ":" in line)
    return block[:end], {k.strip().lower(): v.strip() for k, v in fields.items()}, block[end:]


def warc_date(archive_date: str) -> str:
    """An ARC date (14 digits; older files have fewer) as a WARC date. What is
    missing or impossible becomes the start of the span that is known."""
    digits = re.match(r"\d{0,14}", archive_date.strip())[0]
    for n in (n for n in (14, 12, 10, 8, 6, 4) if n <= len(digits)):
        try:
            return datetime.strptime(digits[:n] + "00000101000000"[n:], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            continue
    return "1970-01-01T00:00:00Z"


def read_arc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record behind the version block."""
    with gzip.GzipFile(fileobj=open_read(path)) as f:
        line = f.readline().decode().rstrip("\n")
        length = int(line.rsplit(" ", 1)[1])
        block = f.read(length).decode().split("\n")
        version, names = int(block[0].split(" ")[0]), block[1].split(" ")
        if names != FIELDS.get(version, "").split():
            raise ValueError(f"{path}: unknown ARC version {block[0]}")
        while True:
            f.read(1)  # the line end behind a record
            line = f.readline().decode().rstrip("\n")
            if not line:
                return
            fields = dict(zip(names, line.rsplit(" ", len(names) - 1)))
            content = f.read(int(fields["Archive-length"]))
            if len(content) != int(fields["Archive-length"]):
                raise ValueError(f"{path}: a record is cut short")
            yield fields, content


def _page_id(fields: dict[str, str]) -> int | None:
    return int(fields["x-page-id"]) if "x-page-id" in fields else None


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Legacy archives of page_id, url, html; the paths of the files. Tasks
    write version 1 and 2 in turn."""
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("records", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part, made, now = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if now is None:
                    now = ArcWriter(folder, f"part-{part:06d}-{made:04d}", 1 + (part + made) % 2)
                    made += 1
                now.add(page_id, url, (html or "").encode())
                if now.full():
                    now.out.close()
                    yield batch(schema, [part], [now.path], [now.records])
                    now = None
        if now is not None:
            now.out.close()
            yield batch(schema, [part], [now.path], [now.records])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return staged(rows.mapInArrow(write, "part int, path string, records long"), "arc-files")


def _spread(files: DataFrame, key: str) -> DataFrame:
    """Files dealt out evenly, a few per task."""
    return files.repartitionByRange(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def index_arcs(arcs: DataFrame) -> DataFrame:
    """path, nth, page_id and the payload's SHA-256 of every ARC record."""
    schema = pa.schema([("path", pa.string()), ("nth", pa.int32()), ("page_id", pa.int64()), ("payload", pa.binary())])

    def index(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for nth, (_, content) in enumerate(read_arc(path)):
                    _, fields, payload = http_parts(content)
                    rows.append((path, nth, _page_id(fields), hashlib.sha256(payload).digest()))
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    return staged(_spread(arcs.select("path"), "path").mapInArrow(index, "path string, nth int, page_id long, payload binary"), "arc-index")


def revisits(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """path, nth, revisit and refers_to: of records with equal payloads the
    one with the largest page_id (ties: the last by file and place) is the
    response. Written between, the two sides meet in a join that can be split
    where one payload has many records."""
    winner = F.max(F.struct("page_id", "path", "nth"))
    winners = staged(index.groupBy("payload").agg(winner.alias("w"), F.count("*").alias("n")).where("n > 1").select("payload", "w"), "arc-responses")
    own = (F.col("w.path") == F.col("path")) & (F.col("w.nth") == F.col("nth"))
    return (index.join(winners, "payload", "left")
            .select("path", "nth", F.coalesce(~own, F.lit(False)).alias("revisit"), F.when(~own, F.col("w.page_id")).alias("refers_to")))


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return _member(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_digest}')}>"


def convert_file(path: str, verdicts: dict[int, tuple[bool, int | None]], folder: str) -> tuple[str, int]:
    """One ARC file as a WARC file; its path and records."""
    made, out = create(folder, path.rsplit("/", 1)[1].removesuffix(".arc.gz"), ".warc.gz")
    records = 0
    with out:
        info = f"software: arc-to-warc\r\nformat: WARC File Format 1.1\r\nconverted-from: {path.rsplit('/', 1)[1]}\r\n".encode()
        out.write(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, made)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info))
        for nth, (fields, content) in enumerate(read_arc(path)):
            head, http, payload = http_parts(content)
            page_id, digest = _page_id(http), base32_sha1(payload)
            revisit, refers_to = verdicts[nth]
            block = head if revisit else content
            date = warc_date(fields["Archive-date"])
            headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
                       ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])]
            if revisit:
                headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
                headers += [("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []
            out.write(warc_record("revisit" if revisit else "response" if head else "resource", headers, block))
            records += 1
    return made, records


def convert(verdicts: DataFrame, folder: str) -> DataFrame:
    """Converts each ARC file (its at most ARC_RECORDS verdicts come together
    in one group); the paths of the WARC files. The count of partitions is
    given, as adaptive execution would merge these few small rows into one task."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        by = dict(zip(table["nth"].to_pylist(), zip(table["revisit"].to_pylist(), table["refers_to"].to_pylist())))
        path, n = convert_file(table["path"][0].as_py(), by, folder)
        return pa.table([[path], [n]], schema=schema)

    n = int(verdicts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(verdicts.repartition(n, "path").groupBy("path").applyInArrow(run, "path string, records long"), "warc-files")


def read_warc(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=open_read(path)) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: not a WARC record")
            fields = {}
            while (line := f.readline().decode()) not in ("\r\n", ""):
                k, v = line.split(":", 1)
                fields[k.lower()] = v.strip()
            block = f.read(int(fields["content-length"]))
            f.read(4)
            yield fields, block


def read_warcs(warcs: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id
    and url of every response and revisit; digests are checked against the
    blocks. A revisit's payload length is the Content-Length of its HTTP head."""
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string"
    schema = pa.schema([(k.split()[0], pa.int64() if k.endswith("long") else pa.string()) for k in kinds.split(", ")])

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for fields, block in read_warc(path):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    kind = fields["warc-type"]
                    _, http, payload = (b"", {}, block) if kind == "resource" else http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or (kind != "revisit" and digest != base32_sha1(payload)):
                        raise ValueError(f"{path}: a digest is wrong")
                    size = len(payload) if kind != "revisit" else int(http.get("content-length", 0))
                    refers = fields.get("x-refers-to-page-id")
                    rows.append((_page_id(http), size, digest, kind, int(refers) if refers else None, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                if rows:
                    yield batch(schema, *map(list, zip(*rows)))

    return _spread(warcs.select("path"), "path").mapInArrow(read, kinds)


def archive_conversion(pages: DataFrame) -> DataFrame:
    """Writes the pages as ARC archives, converts them to WARC, and reads the
    WARC archives back.

    pages: page_id, url, html (further columns are ignored). One row comes out
    per row: a null html is an empty payload; a null url is written as a
    hyphen; a null page_id stays null and loses to any other; of repeated rows
    one is the response at most; no rows give no archives."""
    spark = pages.sparkSession
    arcs = write_arcs(pages, new_folder(spark, "arc"))
    warcs = convert(revisits(index_arcs(arcs)), new_folder(spark, "warc"))
    return read_warcs(warcs)
