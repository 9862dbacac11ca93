"""WARC archives compressed record by record with a Zstandard dictionary."""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.llm.common import arrow, cut, shared_dir

#: Skippable frame that holds the dictionary at the head of an archive.
DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: Payloads from this size on are deduplicated.
LEAST_REVISIT = 100
#: The dictionary, and the first records of an archive that it is made from.
DICT_SIZE, SAMPLE_BYTES, LEAST_SAMPLES = 16_384, 400_000, 16
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f1c2f0a-5a0e-4a39-9d6b-0d8f6f6f0c11")


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, ordinal: int) -> bytes:
    """One record. Control characters in a url are escaped, so that no header can
    be forged."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{ordinal}')}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {safe}"] * bool(safe) + [f"X-Page-ID: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers_to}/1')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary from archived records; too few to train on: their bytes."""
    if len(samples) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(DICT_SIZE, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    raw = b"".join(x[:1024] for x in samples)[-DICT_SIZE:]
    return raw if len(raw) >= 8 else b""


class Writer:
    """Writes one archive: the dictionary in a skippable frame, then a frame for
    each record. Records wait until there are enough to make the dictionary from."""

    def __init__(self, out) -> None:
        self.out, self.waiting, self.held, self.packer, self.bytes = out, [], 0, None, 0

    def _start(self) -> None:
        d = train(self.waiting)
        self._put(DICT_MAGIC + len(d).to_bytes(4, "little") + d)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=True)
        for r in self.waiting:
            self._put(self.packer.compress(r))
        self.waiting = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def write(self, raw: bytes) -> None:
        if self.packer:
            self._put(self.packer.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held > SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self.packer:
            self._start()
        self.out.close()


def read(stream: io.RawIOBase) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head = stream.read(8)
    if head[:4] != DICT_MAGIC:
        raise ValueError("no dictionary frame at the head")
    d = stream.read(int.from_bytes(head[4:], "little"))
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
    left = b""
    while True:
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            data, left = left or stream.read(1 << 20), b""
            if not data:
                break
            parts.append(one.decompress(data))
        if not one.eof:
            if any(parts):
                raise ValueError("an archive ends within a record")
            return
        left = one.unused_data
        yield b"".join(parts)


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(key, ord, refers_to)``, the revisits among the rows of ``pages(key, ord,
    page_id, url, digest, size)``: of equal payloads of ``least`` bytes or more that with
    the smallest page_id (nulls last) is the response. Only these narrow rows are
    grouped, and the smallest id is pre-aggregated, so a payload that a third of
    all pages share is one row on the joining side."""
    one = pages.where(F.col("size") >= least)
    first = one.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    dup = one.join(first, "digest")
    # rows that share the smallest id: one of them is the response
    lead = dup.where(F.col("page_id").eqNullSafe(F.col("first")))
    lead = lead.withColumn("turn", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("ord", "url")))
    rest = dup.where(~F.col("page_id").eqNullSafe(F.col("first"))).withColumn("turn", F.lit(2))
    return lead.unionByName(rest).where("turn > 1").select("key", "ord", F.col("first").alias("refers_to"))


def _writer(base: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        ctx = TaskContext.get()
        tag = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}" if ctx else uuid.uuid4().hex
        w, path, count, made = None, "", 0, []
        for b in batches:
            for r in b.to_pylist():
                if w is None:
                    path, count = f"{root}/{tag}-{len(made):04d}.warc.zst", 0
                    w = Writer(fs.open_output_stream(path, compression=None))
                kind = "revisit" if r["revisit"] else "response"
                w.write(record(kind, r["page_id"], r["url"], r["digest"], r["payload"], r["refers_to"], r["ord"]))
                count += 1
                if w.bytes > archive_bytes:
                    w.close()
                    made.append((path, count, w.bytes))
                    w = None
        if w is not None:
            w.close()
            made.append((path, count, w.bytes))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, base: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows of ``pages(page_id, url, html)`` as archives under the folder
    ``base`` (a uri that all executors share) and returns their manifest ``(path,
    records, bytes)``. A retried task writes files of other names, and only those
    of the attempt that succeeded are in the manifest, so lost executors leave
    whole archives. Null html is an empty payload; a null page_id or url has no
    such header; repeated rows are records of their own, the first by digest and url of
    those that tie for the smallest page_id being the response. A record, and so a
    very long html, is held whole by one worker. An empty table gives an empty
    manifest. Only the three columns named are read, so others may have any name."""
    fs, root = pafs.FileSystem.from_uri(base)
    fs.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.select("*", F.sha2("payload", 256).alias("digest"), F.coalesce("page_id", F.xxhash64("url", "payload")).alias("key"))
    # (key, ord) is a row, also where page_id repeats; the html is shuffled once, by page
    numbered = own.withColumn("ord", F.row_number().over(Window.partitionBy("key").orderBy("digest", "url")))
    small = cut(own.select("page_id", "url", "digest", F.length("payload").alias("size"), "key").withColumn("ord", F.row_number().over(Window.partitionBy("key").orderBy("digest", "url"))))
    again = decide(small).select(F.col("key").alias("_key"), F.col("ord").alias("_ord"), "refers_to", F.lit(True).alias("revisit"))
    joined = numbered.join(again, (F.col("key") == F.col("_key")) & (F.col("ord") - F.col("_ord") == 0), "left")
    rows = joined.select("page_id", "url", "payload", "digest", "ord", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to")
    return cut(rows.transform(arrow, _writer(base, archive_bytes), "path string, records long, bytes long"))


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    rows: list[tuple] = []
                    for raw in read(f):
                        rows.append(_row(raw))
                        if len(rows) == 5000:
                            yield _table(rows)
                            rows = []
                    yield _table(rows)

    return run


def _row(raw: bytes) -> tuple:
    fields, http, payload = parse(raw)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return (None if page is None else int(page), int(http["Content-Length"]), digest, kind, None if refers is None else int(refers))


_COLUMNS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])


def read_archives(manifest: DataFrame, base: str) -> DataFrame:
    """The records of the archives in ``manifest(path)``: ``(page_id, payload_bytes,
    payload_digest, record_type, refers_to)``. Payloads are checked against their
    digest; a damaged archive is an error."""
    n = max(1, manifest.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(n, "path").transform(arrow, _reader(base), schema)


def op8_warc(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back; odd rows as in
    ``write_archives``. The archives stay for the result's readers: they are the
    operator's output."""
    base = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    base = base if "://" in base else f"file://{base}"
    return read_archives(write_archives(pages, base), base)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
