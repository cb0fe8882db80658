"""WARC archives of project documents in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few records, closed by a seek table in a
skippable frame, so any record is read by decompressing one frame. The index maps records to
bundle, frame and offset within the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of records in a frame before it is closed; of frames in a bundle, compressed and plain (its reader holds them).
FRAME_BYTES, BUNDLE_BYTES, PLAIN_BYTES = 256 * 1024, 64 * 1024 * 1024, 192 * 1024 * 1024
# fixed values of the seekable format and of WARC
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = [("project_id", None), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]


def write_archive(projects: DataFrame, folder: str, project_id: str = "project_id", uri: str = "uri", document: str = "document") -> DataFrame:
    """Writes one record per row below ``folder`` and returns the index: ``project_id``, ``record_type``, ``bundle``
    (file), ``frame`` (int), ``offset``, ``length`` (bigint: bytes within the decompressed frame).

    The payload is the document in UTF-8 (null: empty). Of rows with equal payloads the one with the largest id is a
    ``response``, the others are ``revisit`` records that refer to it; rows without an equal are responses. Null
    ids yield to any other; repeated rows of an id get a record each, of the same type. Null URIs are written
    as ``urn:none``; line breaks in a URI are escaped. Ids are whole numbers or strings. An empty table gives an empty index.

    ``folder`` must be reachable by all executors (a URI or shared path) and new. Every task attempt writes files of
    its own; the index names only those of attempts that finished, and is written last, as Parquet, so a
    lost executor costs only its own tasks.
    """
    key = projects.schema[project_id].dataType
    rows = projects.select(F.col(project_id).alias("project_id"), F.col(uri).alias("uri"), F.coalesce(F.col(document), F.lit("")).alias("document"))
    marked = rows.withColumn("_sha", F.sha1(F.col("document")))
    # equal payloads meet as digests only, and as maxima before they are shuffled
    heads = marked.groupBy("_sha").agg(F.max("project_id").alias("_head"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    roles = marked.select("project_id", "_sha").distinct().join(heads.drop("_copies"), "_sha")
    roles = roles.filter(~F.col("project_id").eqNullSafe(F.col("_head"))).select(F.col("project_id").alias("_id"), F.col("_sha").alias("_same"), F.col("_head").alias("refers_to"))
    planned = marked.join(roles, F.col("project_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_same")), "left").select("project_id", "uri", "document", "refers_to")
    schema = f"project_id {key.simpleString()}, record_type string, bundle string, frame int, offset long, length long"
    index = planned.mapInArrow(_writer(folder), schema)
    index.write.parquet(f"{folder}/index")
    return projects.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def read_archive(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, read back: ``project_id``, ``uri``, ``record_type``, ``payload_bytes`` (bigint) and
    ``payload_digest`` (bare base32 SHA-1) of the full payload, ``refers_to`` (the id of the record that a revisit refers
    to, else null) and ``payload`` (binary; null for a revisit). A frame is decompressed once for all its records;
    a payload that does not match its digest is an error."""
    key = index.schema["project_id"].dataType.simpleString()
    fields = f"project_id {key}, uri string, record_type string, payload_bytes long, payload_digest string, refers_to {key}, payload binary"
    # a task for each bundle: the index is small, what it names is not, so the size of its rows tells nothing
    bundles = max(1, index.agg(F.count_distinct("bundle")).first()[0])
    return index.repartition(bundles, "bundle").groupBy("bundle").applyInArrow(_reader(), fields)


def record_urn(project_id) -> str:
    """Record id of a project: the same in every run."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'project:{project_id!r}')}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(project_id, uri: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_urn(project_id)}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(uri or 'urn:none').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    body = b"" if refers_to is not None else payload
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return names, rest[: int(names["Content-Length"])]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_starts(file) -> list[tuple[int, int, int]]:
    """``(start, compressed size, plain size)`` of every frame, from the seek table at the end of ``file``."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes, at, found = struct.iter_unpack("<II", file.read(8 * count)), 0, []
    for packed, plain in sizes:
        found.append((at, packed, plain))
        at += packed
    return found


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Bundle:
    """One file in the making; a frame closes when it is full, the file when it is asked to."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        filesystem, path = _filesystem(self.name)
        filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream = filesystem.open_output_stream(path, compression=None)
        self.sizes, self.buffer, self.held, self.written, self.plain, self.rows = [], [], 0, 0, 0, []

    def add(self, project_id, kind: str, raw: bytes) -> None:
        self.rows.append((project_id, kind, self.name, len(self.sizes), self.held, len(raw)))
        self.buffer.append(raw)
        self.held += len(raw)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(self.buffer))
            self.stream.write(frame)
            self.sizes.append((len(frame), self.held))
            self.written += len(frame)
            self.plain += self.held
            self.buffer, self.held = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.stream.write(seek_table(self.sizes))
        self.stream.close()
        return self.rows


def _writer(folder: str):
    def write(batches):
        bundle = None
        for batch in batches:
            kind = batch.schema.field("project_id").type
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    bundle = bundle or _Bundle(folder)
                    raw = record(row["project_id"], row["uri"], row["document"].encode(), row["refers_to"])
                    bundle.add(row["project_id"], "response" if row["refers_to"] is None else "revisit", raw)
                    if bundle.written >= BUNDLE_BYTES or bundle.plain >= PLAIN_BYTES:
                        yield _index_batch(bundle.close(), kind)
                        bundle = None
        if bundle:
            yield _index_batch(bundle.close(), kind)

    return write


def _index_batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t or key) for c, (_, t) in zip(columns, _INDEX)], [n for n, _ in _INDEX])


def _reader():
    names = ["project_id", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def read(table: pa.Table) -> pa.Table:
        key = table.schema.field("project_id").type
        bundle = table.column("bundle")[0].as_py()
        filesystem, path = _filesystem(bundle)
        wanted: dict[int, list[dict]] = {}
        for row in table.to_pylist():
            wanted.setdefault(row["frame"], []).append(row)
        out = []
        with filesystem.open_input_file(path) as file:
            starts = frame_starts(file)
            for frame, rows in sorted(wanted.items()):
                at, size, plain = starts[frame]
                file.seek(at)
                raw = zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=plain)
                for row in rows:
                    head, body = parse(raw[row["offset"] : row["offset"] + row["length"]])
                    kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Record-ID"] != f"<{record_urn(row['project_id'])}>" or kind == "response" and said != digest(body):
                        raise ValueError(f"{bundle}: record of {row['project_id']} is damaged")
                    to = head.get("X-Refers-To")
                    to = to if to is None or pa.types.is_string(key) else int(to)
                    out.append((row["project_id"], head["WARC-Target-URI"], kind, int(head["X-Payload-Length"]), said, to, body if kind == "response" else None))
        kinds = [key, pa.string(), pa.string(), pa.int64(), pa.string(), key, pa.binary()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out), kinds)})

    return read
