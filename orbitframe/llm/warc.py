"""WARC archives compressed record by record with a shared Zstandard dictionary (operator 2)."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize

#: The leading frame's magic number, from the public WARC/Zstandard specification.
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of the shared folder, as executors open it."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "null" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit that names the response and holds headers only."""
    digest, revisit = base32_sha1(payload), refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, id_col: str = "page_id", size: int = 65_536, sample_rows: int = 1_600, sample_bytes: int = 4 << 20) -> bytes:
    """A dictionary from a bounded sample of whole records: those with the least hash of id and address in the whole table,
    at most ``sample_rows`` of them and ``sample_bytes`` in all.

    Records over a sixteenth of ``sample_bytes`` gain nothing from a dictionary and are no samples. Where the records are too
    few to train on, they are themselves the dictionary's content, which Zstandard takes as well. Empty only for a table
    that has no such record.
    """
    rows = pages.select(id_col, "url", "html", F.xxhash64(F.lit(2), id_col, "url").alias("hash"))
    sizes = rows.select("hash", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")).where(F.col("n") <= sample_bytes // 16)
    least = sizes.groupBy("hash").agg(F.min("n").alias("n")).orderBy("hash").limit(sample_rows).collect()
    held, chosen = 0, []
    for r in least:
        held += r["n"] + 512
        if chosen and held > sample_bytes:
            break
        chosen.append(r["hash"])
    picked = rows.where(F.col("hash").isin(chosen) & (F.coalesce(F.octet_length("html"), F.lit(0)) <= sample_bytes // 16)).dropDuplicates(["hash"]).orderBy("hash").collect()
    samples = [record(r[0], r["url"], (r["html"] or "").encode("utf-8", "replace"), None) for r in picked]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few
        return b"".join(samples)[-size:]


def _writer(folder: str, dictionary: bytes, archive_bytes: int, level: int):
    def run(batches):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True, write_checksum=True)
        task, made, out, name, n, size = TaskContext.get(), 0, None, "", 0, 0
        done = []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n, size))
                out = None

        for batch in batches:
            ids, urls, bodies, refers = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if out is None:
                    # a name of its own for each attempt: what a lost or repeated task leaves is never read
                    name, n, size = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{made}.warc.zst", 0, 0
                    made += 1
                    out = fs.open_output_stream(filesystem(name)[1])
                    if dictionary:
                        size += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary) or 0
                payload = (bodies[i].as_py() or "").encode("utf-8", "replace")
                frame = zip_.compress(record(ids[i].as_py(), urls[i].as_py(), payload, refers[i].as_py()))
                out.write(frame)
                n += 1
                size += len(frame)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", min_payload: int = 0, archive_bytes: int = 1 << 30, level: int = 3, dictionary: bytes | None = None) -> DataFrame:
    """Write one record per row of pages (id, url, html) and return the manifest (path, records, bytes), itself a table.

    Of records with equal payloads of at least ``min_payload`` bytes that with the smallest id is a response and the others
    are revisits of it; smaller ones are all responses. Each task writes its own archives, rolled over at
    ``archive_bytes``; only files named in the manifest count.

    Null html is an empty payload; null url leaves out the target address. Rows with null id are always responses, and so
    are rows that repeat the smallest id with the same payload. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), "url", "html")
    prints = materialize(rows.select("id", F.unhex(F.sha1(body.cast("binary"))).alias("print"), F.octet_length(body).alias("n")), "prints")
    first = prints.where((F.col("n") >= min_payload) & F.col("id").isNotNull()).groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("print", "first")
    again = prints.join(first, "print").where("id > first").select(F.col("id").alias("rid"), F.col("print").alias("rprint"), "first").distinct()
    joined = rows.join(again, (F.col("id") == F.col("rid")) & (F.unhex(F.sha1(body.cast("binary"))) == F.col("rprint")), "left").select("id", "url", "html", "first")
    if dictionary is None:
        dictionary = train_dictionary(pages, id_col)
    return materialize(joined.mapInArrow(_writer(folder, dictionary, archive_bytes, level), "path string, records long, bytes long"), "manifest")


def read_records(stream) -> object:
    """(headers, block) of each record of one archive, read as a stream; the dictionary comes from the leading frame."""
    head = stream.read(8)
    if not head:
        return
    data, lead = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        data, lead = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""

    class Rest:
        def read(self, n=-1):
            nonlocal lead
            out, lead = (lead, b"") if lead else (stream.read(n), lead)
            return out

    reader = zstandard.ZstdDecompressor(dict_data=data).stream_reader(Rest(), read_across_frames=True, read_size=1 << 18)
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        got = reader.read(1 << 20)
        if at:
            held, at = held[at:], 0
        held += got
        return bool(got)

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(held) > at:
                    raise ValueError("the archive ends within a record")
                return
        lines = bytes(held[at:end]).decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        at, size = end + 4, int(headers["Content-Length"])
        while len(held) - at < size + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield headers, bytes(held[at : at + size])
        at += size + 4


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest, one task per archive: page_id, url, payload (null in revisits),
    payload_bytes, payload_digest, record_type, refers_to. A response whose payload does not have its digest is an error."""

    def run(batches):
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        rows, held = [], 0

        def flush():
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, own = filesystem(path)
                with fs.open_input_stream(own) as stream:
                    for headers, block in read_records(stream):
                        top, _, payload = block.partition(b"\r\n\r\n")
                        http = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
                        digest, revisit = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"] == "revisit"
                        if not revisit and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                        refers = page_of(headers["WARC-Refers-To"]) if revisit else None
                        rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), None if revisit else payload, int(http["Content-Length"]), digest, headers["WARC-Type"], refers))
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield flush()
                            rows, held = [], 0
        yield flush()

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op2(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
