"""WARC archives: writing, the monolithic-gzip normaliser with its sidecar index, and indexed reading.

``write_archives`` writes one whole-file gzip stream for each task (rolled at ``roll_bytes``), as some
crawlers do; such a file can only be read from its start. ``normalise`` inflates each stream once, rewrites
every record as a gzip member of its own and writes a sidecar index (offset, length, type and record id of
each member), so that single records can be fetched. ``read_archives`` reads records back through the index
and verifies their payload digests. Files are named by task attempt and only those of attempts that Spark
committed are listed in the manifest, so a lost executor leaves no half file in use; streams are inflated and
parsed piece by piece, so memory holds a record at a time.

Records with equal payloads of at least ``min_bytes`` are stored once: that with the largest page id is the
response, the others are revisits that refer to it. The digests are grouped by Spark (partial aggregation
first), and only payloads that occur more than once are looked up while writing.

Edge cases: null html is an empty payload; a null url writes no target URI; control characters in urls are
percent-encoded; a null page id can't be referred to, so it is a revisit where another record of its group has
an id, and else a response; of repeated rows of the largest page id each is a response; an empty table writes
empty archives and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import drop_path, frugal, lookup_join, materialize, shared_path
from varloom.session import ship

MIN_BYTES = 1000
PIECE = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CTRL = re.compile(r"[\x00-\x20\x7f]")


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + (uri[5:] if uri.startswith("file:") else uri))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(rid: str) -> int | None:
    tail = rid.rsplit(":", 1)[-1].rstrip(">")
    return None if tail in ("", "null") else int(tail)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header block and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CTRL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(stream, piece: int = PIECE) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members."""
    d = zlib.decompressobj(31)
    while raw := stream.read(piece):
        while raw:
            out = d.decompress(raw, 4 * piece)
            if out:
                yield out
            if d.eof:
                raw, d = d.unused_data, zlib.decompressobj(31)
            else:
                raw = d.unconsumed_tail
    rest = d.flush()
    if rest:
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (head, block and the closing blank lines) of an inflated WARC stream."""
    buf = bytearray()

    def more() -> bool:
        nxt = next(pieces, None)
        if nxt is None:
            return False
        buf.extend(nxt)
        return True

    while True:
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends inside a record head")
                return
        size = cut + 4 + int(parse_head(bytes(buf[:cut]))["content-length"]) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(buf[:size])
        del buf[:size]


# which records are stored
def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit("").cast("binary"))


def stored_once(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, response: for payloads of at least min_bytes that occur more than once."""
    p = _payload(F.col("html"))
    d = pages.select("page_id", F.sha1(p).alias("digest"), F.octet_length(p).alias("n")).where(F.col("n") >= min_bytes)
    return d.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("k")).where("k > 1 and response is not null").select("digest", "response")


# writing
def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, level: int = 4, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 1 << 30) -> DataFrame:
    """Write pages(page_id, url, html) as monolithic archives; the manifest: path, records."""
    ship(pages.sparkSession)
    once = materialize(stored_once(pages, min_bytes), "warc-once")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    rows = lookup_join(rows, once, ["digest"], max_rows=300_000, salt=F.struct("page_id", "url"))
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []
        out = gz = None
        size = n = 0

        def close() -> None:
            nonlocal out, gz, size, n
            out.write(gz.flush())
            out.close()
            made[-1] = (made[-1][0], n)
            out, gz, size, n = None, None, 0, 0

        for b in batches:
            for pid, url, payload, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    made.append((f"{root}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{len(made)}.warc.gz", 0))
                    out, gz = fs.open_output_stream(made[-1][0], compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                rec = make_record(pid, url, payload, ref, date, ref is not None)
                if c := gz.compress(rec):
                    out.write(c)
                size, n = size + len(rec), n + 1
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["path", "records"])

    return materialize(rows.mapInArrow(frugal(run), "path string, records long"), "warc-manifest")


# normalising
def normalise_file(fs: pafs.FileSystem, path: str, target: str, level: int = 4) -> int:
    """Rewrite an archive with one gzip member a record, and its sidecar index ``target`` + '.idx'."""
    n = at = 0
    with fs.open_input_stream(path, compression=None) as src, fs.open_output_stream(target, compression=None) as dst, fs.open_output_stream(target + ".idx", compression=None) as idx:
        for rec in records(inflate(src)):
            head = parse_head(rec[: rec.index(b"\r\n\r\n")])
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            dst.write(member)
            idx.write(f"{at} {len(member)} {head['warc-type']} {head['warc-record-id']}\n".encode())
            at += len(member)
            n += 1
    return n


def normalise(manifest: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Normalise the archives of a manifest; the new manifest: path (its index is path + '.idx'), records."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        paths, counts = [], []
        for b in batches:
            for path, expect in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{root}/{path.rsplit('/', 1)[-1].removesuffix('.warc.gz')}-{ctx.taskAttemptId()}.warc.gz"
                n = normalise_file(fs, path, target, level)
                if n != expect:
                    raise ValueError(f"{path}: {n} records, {expect} written")
                paths.append(target)
                counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialize(_spread(manifest).mapInArrow(frugal(run), "path string, records long"), "warc-index")


def _spread(manifest: DataFrame) -> DataFrame:
    """Archives over the tasks, a few each."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 100_000)), F.xxhash64("path"))


# reading
def read_record(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    cut = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload doesn't fit its digest")
    return {
        "page_id": _page_id(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": head["warc-type"],
        "refers_to": _page_id(head["warc-refers-to"]) if revisit else None,
    }


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records of normalised archives, fetched member by member through the sidecar index."""
    ship(index.sparkSession)
    types = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payload:
        del types["payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = _fs(path)
                with fs.open_input_stream(p + ".idx", compression=None) as f:
                    entries = [x.split(b" ") for x in f.read().splitlines()]
                with fs.open_input_file(p) as f:
                    for a in range(0, len(entries), 500):
                        part = entries[a : a + 500]
                        got = [read_record(zlib.decompress(f.read_at(int(e[1]), int(e[0])), 31)) for e in part]
                        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in types.items()], list(types))

    names = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    return _spread(index).mapInArrow(frugal(run), ", ".join(f"{k} {names[k]}" for k in types))


def round_trip(pages: DataFrame, spark: SparkSession, min_bytes: int = MIN_BYTES, payload: bool = False) -> DataFrame:
    """Write pages, normalise the archives and read them back."""
    folder = shared_path(spark, "warc-mono")
    index = normalise(write_archives(pages, folder, min_bytes), shared_path(spark, "warc"))
    drop_path(spark, folder)  # the normalised archives are written whole: nothing reads these again
    return read_archives(index, payload)
