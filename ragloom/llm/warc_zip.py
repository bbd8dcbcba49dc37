"""WARC in ZIP packages: writer, and a reader that extracts nothing.

A package holds ``archive/data.warc.gz`` (each record its own gzip member) and
``indexes/index.cdx`` (page, offset, length, type), both stored, not deflated.
The reader finds the end record at the file's tail, follows the ZIP64 locator
where sizes or offsets need it, parses the central directory, and turns each
stored archive member into byte ranges: by its index ranges of whole records,
without an index the member as one range, which is streamed. Ranges are read with seeks, so one
huge package is read by many tasks; memory is one record and ``RANGE_BYTES`` of
rows at a time. Payloads stay where they are read up to ``BROADCAST_DIGESTS``
repeated digests; beyond, they are dealt once, by digest and salt.

Files are opened with ``pyarrow.fs`` by URI (file, hdfs, s3, gs). A writing
task names its file after its attempt; the manifest, committed by Spark, holds
the files that count, so a lost or repeated task leaves none of its records
twice.

Payload rule: of records with equal payloads of ``MIN_REVISIT`` bytes or more
the one with the smallest page_id is the response, the others revisit it.
Defined cases: null html is an empty payload; null url gives no target; a
null page_id comes back null and never is what others refer to; rows that
repeat the response's page_id are responses as well; a very long payload is one
record, held whole by the task that writes or reads it; no rows, no records;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.scratch import materialize, new_path
from ragloom.llm.skew import attach

MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
RANGE_BYTES = 2 << 20
BROADCAST_DIGESTS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page) -> str:
    return f"<urn:x-page:{'none' if pd.isna(page) else int(page)}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page, url, payload: bytes, digest: str, kind: str, refers) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if isinstance(url, str):
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_urn(refers)}", f"WARC-Profile: {PROFILE}"]
    raw = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member; one record is held at a time."""
    parts: list[bytes] = []
    z = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            parts.append(z.decompress(chunk))
            chunk = z.unused_data
            if z.eof:
                yield _parsed(b"".join(parts))
                parts, z = [], zlib.decompressobj(31)
    if parts:
        raise ValueError("record cut off")


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _chunks(f, offset: int, length: int) -> Iterator[bytes]:
    f.seek(offset)
    while length:
        chunk = f.read(min(length, 1 << 20))
        if not chunk:
            raise ValueError("file cut off")
        length -= len(chunk)
        yield chunk


def _open(uri: str, mode: str):
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        files.create_dir(path.rpartition("/")[0], recursive=True)
        return files.open_output_stream(path)
    return files.open_input_file(path)


class _Counted(io.RawIOBase):
    """A write-only stream that knows its position, all that zipfile needs for stored members of known order."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(bytes(b))
        self.at += len(b)
        return len(b)

    def flush(self) -> None:
        pass


def write_package(uri: str, rows: Iterable[tuple], force_zip64: bool = True) -> tuple[int, int]:
    """rows: page, url, payload, digest, type, refers. Streams to the file; returns records and bytes."""
    index, at = [], 0
    with _open(uri, "w") as out:
        counted = _Counted(out)
        with zipfile.ZipFile(counted, "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=force_zip64) as member:
                for row in rows:
                    raw = record(*row)
                    member.write(raw)
                    index.append(f"{_urn(row[0])} {at} {len(raw)} {row[4]}\n")
                    at += len(raw)
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=force_zip64) as member:
                for line in index:
                    member.write(line.encode())
        return len(index), counted.at


def members(f) -> dict[str, tuple[int, int]]:
    """Stored members of an open package: name -> (offset of its bytes, their number)."""
    size = f.size()
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        f.seek(at)
        zip64 = f.read(56)
        if zip64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack("<QQQ", zip64[32:56])
    f.seek(start)
    directory, found, p = f.read(length), {}, 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, whole = (*struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<II", directory[p + 20 : p + 28]))
        n_name, n_extra, n_note = struct.unpack("<HHH", directory[p + 28 : p + 34])
        (local,) = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                whole = values.pop(0) if whole == 0xFFFFFFFF else whole
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + k :]
        p += 46 + n_name + n_extra + n_note
        if method == 0 and packed == whole:
            found[name] = (local, whole)
    for name, (local, whole) in found.items():
        f.seek(local)
        head = f.read(30)
        found[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), whole)
    return found


def ranges(uri: str, most: int = RANGE_BYTES) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of whole records of the stored archive members."""
    with _open(uri, "r") as f:
        found = members(f)
        for name, (start, length) in found.items():
            if not name.endswith(".warc.gz") or not length:
                continue
            if name != DATA or INDEX not in found:
                yield start, length
                continue
            at, size = found[INDEX]
            first = run = 0
            rest = b""
            for piece in range(0, size, 1 << 20):
                f.seek(at + piece)
                *lines, rest = (rest + f.read(min(1 << 20, size - piece))).split(b"\n")
                for line in lines:
                    _, offset, n, _ = line.split(b" ")
                    if run and run + int(n) > most:
                        yield start + first, run
                        first, run = int(offset), 0
                    run += int(n)
            if run:
                yield start + first, run


def read_range(uri: str, offset: int, length: int) -> Iterator[tuple]:
    """page, url, payload bytes, digest, type, refers, payload (null for revisits)."""
    with _open(uri, "r") as f:
        for headers, block in records(_chunks(f, offset, length)):
            http, _, payload = block.partition(b"\r\n\r\n")
            said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            url = headers.get("WARC-Target-URI")
            url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
            if headers["WARC-Type"] == "revisit":
                n = int(http.decode().rpartition("Content-Length: ")[2])
                yield _page(headers["WARC-Record-ID"]), url, n, said, "revisit", _page(headers["WARC-Refers-To"]), None
            else:
                if hashlib.sha256(payload).hexdigest() != said:
                    raise ValueError(f"{headers['WARC-Record-ID']}: payload does not have the digest it is filed under")
                yield _page(headers["WARC-Record-ID"]), url, len(payload), said, "response", None, payload


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as packages, one a partition; the manifest."""
    from pyspark import TaskContext

    folder = folder or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    groups = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").select("digest", "_first")
    groups = materialize(groups, "warc-equal")
    planned = attach(rows, groups, ["digest"], groups.count(), BROADCAST_DIGESTS, ["page_id", "digest"])
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    planned = planned.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("_first")).cast("string").alias("refers"))  # pandas keeps text whole beside nulls

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.zip"
        rows = (r for b in batches for r in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["kind"], b["refers"], strict=True))
        n, size = write_package(uri, rows)
        yield pd.DataFrame({"path": [uri], "records": [n], "bytes": [size]})

    return materialize(planned.mapInPandas(run, MANIFEST), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in manifest (path)."""

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)
        return out.assign(**{c: pd.array(out[c].tolist(), dtype="Int64") for c in ("page_id", "refers_to")})

    def locate(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri in b["path"]:
                yield pd.DataFrame([(uri, *r) for r in ranges(uri)], columns=["path", "offset", "length"])

    def fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in zip(b["path"], b["offset"], b["length"], strict=True):
                held, size = [], 0
                for row in read_range(*r):
                    held.append(row if payloads else (*row[:-1], None))
                    size += len(row[-1] or b"") * payloads + 256
                    if size >= RANGE_BYTES:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").mapInPandas(locate, "path string, offset long, length long").repartition(n).mapInPandas(fetch, OUT)
