"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id and payload digest, so shard k holds the k-th range; the number of
shards follows the payloads' bytes, not the cluster (SHARD_BYTES each, up to MOST_SHARDS, beyond
which shards grow, as tasks stream them). Each task
writes its range as gzip members, one a record, and rolls to the next file once the compressed
size passes ``roll_bytes``. Headers are regenerated from the row alone (record ids are name-based
UUIDs; the date is a parameter) and digests from the payload, so a retried task writes the same
bytes. Files appear under temporary names and are renamed when complete; the task's rows name
them, and the driver commits by writing a manifest of those names, sizes and record counts,
itself renamed into place. Readers open only what a manifest names, so leftovers of lost tasks
are never read.

Every row is a record. Of records with equal payloads of at least ``min_revisit`` bytes the one of
smallest id is a response; others are revisits that refer to it.

Defined cases: a null payload is empty; a null URL is ``urn:page:<id>``; control and blank
characters of a URL are percent-encoded; very long payloads are written and read whole, one in
memory at a time; repeated rows are records of their own, told apart by a number in their record
id, and all rows of the smallest id and one payload (a tie) are responses; rows with a null id are
records without a page number, which revisit a response of equal payload with an id, or else are
responses, whose URL if null is ``urn:page:none``; an empty table gives an empty archive with a
manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, staged

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("7b1f6a2e-1f5f-4b6e-9a4b-0e4a5d1c9c11")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "MANIFEST.json"
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(record_id: int | None, payload_digest: str, copy: int = 0) -> str:
    """The name of the copy-th record of this id and payload."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{record_id}:{payload_digest}:{copy}')}>"


def record(record_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC/1.1 record, without compression."""
    http = HTTP.format(len(payload)).encode()
    block = http + payload if refers_to is None else http
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'none' if record_id is None else record_id}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(record_id, payload_digest, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, payload_digest)}", f"X-Refers-To-Page: {refers_to}"]
    if record_id is not None:
        lines.append(f"X-Page: {record_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Writes members to shard files of at most about ``roll_bytes``."""

    def __init__(self, root: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.attempt, self.roll = shard, attempt, roll_bytes
        self.out, self.files, self.size, self.count, self.sum = None, [], 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{len(self.files):05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.count, self.sum = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.files.append((self.name, self.size, self.count, self.sum.hexdigest()))
            self.out = None


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, roll_bytes: int = 64 << 20, shards: int | None = None) -> dict:
    """Write the archive below ``root`` (a URI all executors can open) and return its manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    keyed = staged(rows.select("id", "sha1", F.length("payload").cast("long").alias("n")), "payload-digests")
    if shards is None:
        total = keyed.agg(F.sum("n")).first()[0] or 0
        shards = min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES)))
    first = keyed.where((F.col("n") >= min_revisit) & F.col("id").isNotNull()).groupBy("sha1").agg(F.min("id").alias("first"))
    revisits = staged(keyed.where(F.col("n") >= min_revisit).join(first, "sha1").where("id is null or id <> first").select("id", "sha1", "first").distinct(), "revisits").select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "first")
    found = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    sorted_rows = found.repartitionByRange(shards, "id", "sha1").sortWithinPartitions("id", "sha1", "url")
    filesystem, base = fs.FileSystem.from_uri(root)
    filesystem.create_dir(base)

    def run(batches):
        from pyspark import TaskContext

        task, last, copy = TaskContext.get(), None, 0
        out = _Roller(root, task.partitionId(), task.taskAttemptId(), roll_bytes)
        for batch in batches:
            for i, url, payload, first_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = digest(payload)
                last, copy = (i, got), copy + 1 if (i, got) == last else 0
                out.add(member(record(i, url, payload, got, first_id, copy)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out.files, strict=True) if out.files else ([],) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "bytes", "records", "sha256"])

    files = staged(sorted_rows.select("id", "url", "payload", "first").mapInArrow(run, "name string, bytes long, records long, sha256 string"), "archive-files")
    manifest = {"files": [r.asDict() for r in files.orderBy("name").collect()], "date": DATE}
    with filesystem.open_output_stream(f"{base}/.{MANIFEST}.tmp") as out:
        out.write(json.dumps(manifest).encode())
    filesystem.move(f"{base}/.{MANIFEST}.tmp", f"{base}/{MANIFEST}")
    return manifest


def parse(stream):
    """(headers, block) of every record of a decompressed stream; headers by lower-case name."""
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
        block = stream.read(int(headers["content-length"]))
        yield headers, block


def _read_files(root: str):
    filesystem, base = fs.FileSystem.from_uri(root)

    def read(blocks):
        import gzip

        for block in blocks:
            for name in block["name"]:
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")}
                with filesystem.open_input_file(f"{base}/{name}") as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, body in parse(stream):
                        kind, payload = h["warc-type"], body.partition(b"\r\n\r\n")[2]
                        full = kind == "response"
                        named = h["warc-payload-digest"].removeprefix("sha1:")
                        out["page_id"].append(int(h["x-page"]) if "x-page" in h else None)
                        out["payload_bytes"].append(len(payload) if full else int(h["x-payload-length"]))
                        out["payload_digest"].append(digest(payload) if full else named)
                        out["record_type"].append(kind)
                        out["refers_to"].append(None if full else int(h["x-refers-to-page"]))
                        out["url"].append(h["warc-target-uri"])
                        out["intact"].append(h["warc-block-digest"] == f"sha1:{digest(body)}" and (not full or digest(payload) == named))
                        if len(out["page_id"]) >= 4096:
                            yield out
                            out = {k: [] for k in out}
                yield out

    return read


def read(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact) of every record
    of the files that the manifest names. If ``strict``, a record whose digests fail is an error."""
    filesystem, base = fs.FileSystem.from_uri(root)
    with filesystem.open_input_stream(f"{base}/{MANIFEST}") as f:
        names = [(x["name"],) for x in json.loads(f.read())["files"]]
    files = spark.createDataFrame(names, "name string").repartition(max(1, len(names)))
    out = map_arrow(files, ["name"], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean", _read_files(root))
    return out.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a digest fails: page "), F.col("page_id"))))) if strict else out
