"""WARC archives compressed record by record with a dictionary of their own.

Layout of an archive: one skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed,
then one Zstandard frame per record, each compressed with that dictionary. A reader can therefore seek to
any record. A task trains the dictionary of an archive on its first ``TRAIN`` records (bounded in bytes);
an archive is closed at ``MOST_BYTES`` and the next one begins.

Of records with equal payloads (of at least ``min_revisit`` bytes) the one with the smallest id is a
response; the others are revisits that refer to it and carry no payload.

Files go to a folder on a file system that driver and executors share, by ``pyarrow.fs`` (local, HDFS or
object store URIs). A task writes under a name that is unique to the attempt; only the names that
successful tasks return (the manifest, a table) belong to the result, so retries and lost executors leave
at most unreferenced files.

Rules: null html is an empty payload; rows that share the smallest id of a payload are all responses;
null ids sort last; empty tables give no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import shared_dir, ship, stored

#: Fixed values of the file formats.
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
TRAIN = 400
TRAIN_BYTES = 4 << 20
MOST_BYTES = 256 << 20
_MANIFEST = "path string, records long, bytes long"
_END = b"\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = "none" if page_id is None else str(page_id)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"),
              ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/octet-stream"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = b"" if revisit else payload
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _dictionary(samples: list[bytes]):
    import zstandard

    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:                # too few or too uniform samples to train on: raw content serves
        made = b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"
    return made


def archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", page: str = "html",
             min_revisit: int = 0) -> DataFrame:
    """Write the archives; the manifest (path, records, bytes), one row per archive."""
    spark = pages.sparkSession
    ship(pages.sparkSession)
    folder = f"{folder or shared_dir(spark) + '/warc'}/{uuid.uuid4().hex}"
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(page), F.lit("")).alias("html"))
    thin = rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"), F.octet_length("html").alias("n"))
    first = thin.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where(F.col("copies") > 1).select(F.col("digest").alias("d_"), "first")
    again = thin.join(first, F.col("digest") == F.col("d_")).where(
        F.col("n") >= min_revisit).where(F.col("first") != F.coalesce(F.col("page_id"), F.col("first") + 1))
    again = again.select(F.col("page_id").alias("p_"), F.col("digest").alias("d_"), F.col("first").alias("refers_to")).distinct()
    full = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).join(
        again, F.col("page_id").eqNullSafe(F.col("p_")) & (F.col("digest") == F.col("d_")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        attempt, done = uuid.uuid4().hex, []
        out = pack = path = None
        held, held_bytes, count, size = [], 0, 0, 0

        def begin() -> None:
            nonlocal out, pack, path, count, size, held, held_bytes
            path = f"{attempt}-{len(done)}.warc.zst"
            made = _dictionary(held)
            inner = zstandard.ZstdCompressor().compress(made)
            out = system.open_output_stream(f"{base}/{path}")
            out.write(struct.pack("<II", SKIPPABLE, len(inner)) + inner)
            pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made))
            count, size, rest = 0, 8 + len(inner), held
            held, held_bytes = [], 0
            for raw in rest:
                put(raw)

        def put(raw: bytes) -> None:
            nonlocal count, size
            frame = pack.compress(raw)
            out.write(frame)
            count, size = count + 1, size + len(frame)

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", count, size))
                out = None

        for batch in batches:
            for number, where, body, refers in zip(*(batch.column(i) for i in range(4))):
                payload, refers = body.as_py().encode(), refers.as_py()
                raw = record(number.as_py(), where.as_py(), payload, _digest(payload), refers, refers is not None)
                if out is not None:
                    put(raw)
                    if size >= MOST_BYTES:
                        finish()
                else:
                    held.append(raw)
                    held_bytes += len(raw)
                    if len(held) >= TRAIN or held_bytes >= TRAIN_BYTES:
                        begin()
        if held:
            begin()
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], ["path", "records", "bytes"])

    return stored(full.select("page_id", "url", "html", "refers_to").mapInArrow(write, _MANIFEST), "warc-manifest")


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, one at a time."""
    import zstandard
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name) as src:
        magic, n = struct.unpack("<II", src.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no dictionary frame")
        made = zstandard.ZstdDecompressor().decompress(src.read(n))
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(made))
        with unpack.stream_reader(src, read_across_frames=True) as plain:
            buffer = b""
            while True:
                while _END not in buffer and (more := plain.read(1 << 18)):
                    buffer += more
                if not buffer:
                    return
                head, _, buffer = buffer.partition(_END)
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                n = int(fields["Content-Length"])
                parts, have = [buffer], len(buffer)
                while have < n + len(_END) and (more := plain.read(1 << 18)):
                    parts.append(more)
                    have += len(more)
                buffer = b"".join(parts)
                yield fields, buffer[:n]
                buffer = buffer[n + len(_END):]


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives of a manifest: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (and the payload). The digest of a response is computed from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for fields, payload in records(path):
                    kind, number = fields["WARC-Type"], fields["WARC-Record-ID"][10:-1]
                    noted, length = fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"])
                    if kind == "response" and (_digest(payload) != noted or len(payload) != length):
                        raise ValueError(f"{path}: record {number} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((None if number == "none" else int(number), fields.get("WARC-Target-URI"), length, noted, kind,
                                 int(refers[10:-1]) if refers else None, *([payload] if with_payload else [])))
                    held += len(payload) if with_payload else 200
                    if held >= 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    ship(manifest.sparkSession)
    n = manifest.count()
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(max(1, n)).mapInArrow(run, ddl + (", payload binary" if with_payload else ""))
