"""WARC archives compressed record by record with a dictionary of their own (.warc.zst)."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from slideloom.plans.scale import checkpoint_root, settle

# Fixed values of the format: the skippable frame that holds the dictionary, and that of a trained dictionary.
SKIPPABLE = 0x184D2A5D
TRAINED = 0xEC30A437
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def field(value: str) -> str:
    """A header value without control characters, which would end the header."""
    return "".join(c if " " <= c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page, url, payload: bytes, sha: str, first=None) -> bytes:
    """One record: the response, or a revisit of ``first`` that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(body)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {field(url)}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields (lower case), http headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block doesn't have its digest")
    return {"fields": fields, "http": http.decode(), "payload": payload}


def build_dictionary(records: list[bytes], size: int = 65_536, sample: int = 4_000_000) -> bytes:
    """A dictionary from records spread over the archive, of at most ``sample`` bytes in all.

    Too few records to train on give a plain dictionary: the start of the first record.
    """
    step = max(1, sum(map(len, records)) // sample)
    try:
        return zstandard.train_dictionary(size, records[::step], k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return records[0][:2048]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == struct.pack("<I", TRAINED)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes], level: int = 3) -> int:
    """The dictionary in a leading skippable frame, then one frame for each record."""
    data = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    frames = zstandard.ZstdCompressor(level=level, dict_data=dictionary(data), write_checksum=True)
    size = 8 + len(packed)
    for r in records:
        frame = frames.compress(r)
        out.write(frame)
        size += len(frame)
    return size


def read_archive(source, chunk: int = 1 << 20):
    """The records of an archive one after the other; memory holds a record and a chunk."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary in front")
    data = source.read(n)
    if data[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        data = zstandard.ZstdDecompressor().decompress(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary(data))
    frame, held, rest = reader.decompressobj(), [], b""
    while True:
        got = rest or source.read(chunk)
        if not got:
            break
        held.append(frame.decompress(got))
        rest = b""
        if frame.eof:
            yield b"".join(held)
            rest, frame, held = frame.unused_data, reader.decompressobj(), []
    if any(held):
        raise ValueError("the archive ends inside a record")


def first_copies(pages: DataFrame, ident: str, payload: str, least: int) -> DataFrame:
    """Ids (with digest) whose payload occurs under a smaller id: _id, _sha, refers_to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = settle(pages.select(F.col(ident).alias("_id"), F.sha1(body.cast("binary")).alias("_sha"), F.octet_length(body).alias("_size")))
    groups = rows.where(F.col("_size") >= least).groupBy("_sha").agg(F.min("_id").alias("refers_to"), F.count(F.lit(1)).alias("_n"))
    groups = groups.where("_n > 1").drop("_n")
    copies = rows.join(groups, "_sha").where(~F.col("_id").eqNullSafe(F.col("refers_to")))
    return copies.select(F.col("_id").alias("_copy"), F.col("_sha").alias("_same"), "refers_to").distinct()


def write_warc(
    pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html",
    least: int = 0, level: int = 3, archive_bytes: int = 24_000_000,
) -> DataFrame:
    """Write a record for every row into archives under ``folder``; returns path, records, bytes of each archive.

    Payloads (UTF-8; null as empty) of at least ``least`` bytes are written once: the row
    with the smallest id is the response, the others revisit it. Rows that share that
    id and payload are all responses, null ids come last. A task fills archives of about
    ``archive_bytes`` before compression and builds each one's dictionary from its records. Names carry a random part and the
    list names only files of tasks that succeeded, so a task run again
    leaves no double records. ``folder`` must be a place that all executors share, given
    as a path or a URI that Arrow's file systems know. An empty table writes nothing.
    """
    copies = first_copies(pages, ident, payload, least)
    kind = pages.schema[ident].dataType.simpleString()
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(ident).alias("_id"), F.col(url).cast("string").alias("_url"), body.alias("_html"), F.sha1(body.cast("binary")).alias("_sha"))
    # ids spread rows of equal payload over tasks
    rows = rows.join(copies, F.col("_id").eqNullSafe(F.col("_copy")) & (F.col("_sha") == F.col("_same")), "left")
    rows = rows.select("_id", "_url", "_html", F.col("refers_to").alias("_first"))

    def run(batches):
        held, size = [], 0

        def close():
            system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            system.create_dir(base, recursive=True)
            path = posixpath.join(base, f"{uuid.uuid4().hex}.warc.zst")
            with system.open_output_stream(path, compression=None) as out:
                n = write_archive(out, held, level)
            return pa.RecordBatch.from_pylist([{"path": path, "records": len(held), "bytes": n}])

        for b in batches:
            for i, u, h, f in zip(*b.columns):
                raw = h.as_py().encode()
                held.append(record(i.as_py(), u.as_py(), raw, digest(raw), f.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held.clear()
                    size = 0
        if held:
            yield close()

    assert kind in ("bigint", "int", "smallint", "tinyint"), "ids are whole numbers"
    return settle(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the archives listed (column path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Digests of blocks and of the payloads of responses are checked. A revisit's size is that of the full payload; its payload is null.
    """
    def number(uri):
        n = uri.strip("<>").removeprefix("urn:page:")
        return None if n == "None" else int(n)

    def run(batches):
        system = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        r = parse(raw)
                        f = r["fields"]
                        new = f["warc-type"] == "response"
                        sha = f["warc-payload-digest"].removeprefix("sha1:")
                        if new and digest(r["payload"]) != sha:
                            raise ValueError("the payload doesn't have its digest")
                        length = next(int(x.split(":")[1]) for x in r["http"].split("\r\n") if x.lower().startswith("content-length:"))
                        rows.append({
                            "page_id": number(f["warc-record-id"]), "url": f.get("warc-target-uri"), "payload_bytes": length,
                            "payload_digest": sha, "record_type": f["warc-type"],
                            "refers_to": None if new else number(f["warc-refers-to"]), "payload": r["payload"] if new else None,
                        })
                        size += len(raw)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    # an archive is one task's work: deal the list out by name
    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(run, kinds)


def shared_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
