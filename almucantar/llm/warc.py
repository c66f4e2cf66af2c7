"""Deterministic sharded WARC 1.1 writer and reader.

Pages are range-sorted by page_id into shards whose bounds come from a sample chosen by hash, so the same
table always gives the same files. Each record is a gzip member of its own; a file is closed when its
compressed size reaches the limit. Headers and digests are made anew from the payload. Files are written
under temporary names and renamed; the manifest, renamed into place last, makes them count.

Of records with equal payloads of at least ``min_dedup_bytes`` the one with the smallest page_id is a
response and the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.llm import shared

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The sample that the shards' bounds are taken from has about this many keys, whatever the table's size, and there are at most so many shards.
SAMPLE, SHARDS = 200_000, 20_000


def record_id(page_id: int | None, digest: str) -> str:
    """The same page always has the same record id."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record, not compressed."""
    if is_revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    """The record that each file begins with."""
    block = b"software: almucantar\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time in it."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its header")
    return headers, rest[:n]


def members(source, chunk: int = 1 << 20):
    """The gzip members of a file one by one, decompressed."""
    data, out, d = b"", [], zlib.decompressobj(31)
    while True:
        if not data:
            data = source.read(chunk)
            if not data:
                break
        out.append(d.decompress(data))
        data = b""
        if d.eof:
            yield b"".join(out)
            data, out, d = d.unused_data, [], zlib.decompressobj(31)
    if any(out):
        raise ValueError("a file is cut short")


def plan(keys: DataFrame, min_dedup_bytes: int) -> DataFrame:
    """The pages that revisit another: page_id, digest, refers_to. No payload is shuffled for it."""
    keys = keys.where(F.col("_bytes") >= min_dedup_bytes).select("page_id", "_digest")
    firsts = keys.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    return keys.join(firsts, "_digest").where("page_id is null or page_id > _first").select("page_id", "_digest", "_first").distinct()


def write(pages: DataFrame, folder: str, min_dedup_bytes: int = 100, shard_bytes: int = 64 << 20, file_bytes: int = 1 << 30, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> list[dict]:
    """Writes one record for each row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest.

    Null html is an empty payload, null urls leave out the target URI, null ids sort first and are never
    what others refer to. Rows that repeat the smallest page_id of a payload are all responses. Pages of any
    length are one record. An empty table gives a manifest without files; further columns, whatever their names,
    are not read. ``shard_bytes`` (html bytes) sets how many shards there are, ``SHARDS`` at most, each a range of
    page_id and digest, so rows that repeat a page_id may be several shards; ``file_bytes`` rolls files within a shard.
    """
    spark = pages.sparkSession
    shared.small_arrow_batches(spark)
    shared.make_dir(folder)
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    keys = shared.written(rows.select("page_id", "_digest", F.octet_length("_payload").alias("_bytes")), "digests")  # so payloads are read twice, not more
    size = keys.agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).first()
    shards = max(1, min(SHARDS, -(-(size["b"] or 0) // shard_bytes)))
    shards = max(shards, min(64, (size["b"] or 0) >> 22))  # tables of some MB still use all cores
    step = max(1, size["n"] // SAMPLE)
    some = keys.where(f"page_id is not null and pmod(xxhash64(page_id, _digest), {step}) = 0").groupBy("page_id", "_digest").agg(F.count("*").alias("n"))
    sample = sorted((r["page_id"], r["_digest"], r["n"]) for r in some.collect())  # about SAMPLE keys
    total = sum(r[2] for r in sample)
    seen, bounds = 0, []
    for page, digest, n in sample:
        if shards * seen // max(1, total) > len(bounds) and (not bounds or bounds[-1] < (page, digest)):
            bounds.append((page, digest))
        seen += n
    revisits = plan(keys, min_dedup_bytes)
    shard = F.coalesce(F.expr(_search(bounds)), F.lit(0)).cast("int")
    both = rows.select("page_id", "url", "_payload", "_digest", F.lit(None).cast("long").alias("_first"), F.lit(1).alias("_kind"))
    both = both.unionByName(revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("_payload"), "_digest", "_first", F.lit(0).alias("_kind")))
    # A page's revisit row comes just before the page itself, so payloads are shuffled once.
    ordered = both.withColumn("_shard", shard).repartitionById(len(bounds) + 1, F.col("_shard")).sortWithinPartitions("page_id", "_digest", "_kind", "url")

    def run(batches):
        fs, base = shared.filesystem(folder)
        task = TaskContext.get()
        made, out, records, size, refers = [], None, 0, 0, None

        def finish():
            out.close()
            shared.publish(fs, temporary, f"{base}/{name}")
            made.append((name, records, size))

        for batch in batches:
            for page, url, payload, digest, first, kind in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == 0:
                    refers = (page, digest, first)
                    continue
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{len(made):04d}.warc.gz"
                    temporary = f"{base}/.{name}.{task.taskAttemptId()}.tmp"
                    out, records, head = fs.open_output_stream(temporary, compression=None), 0, member(warcinfo(name, date), level)
                    size = out.write(head)
                revisit = refers is not None and refers[:2] == (page, digest)
                size += out.write(member(record(page, url, payload, digest, refers[2] if revisit else None, revisit, date), level))
                records += 1
                if size >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"name": pa.array([m[0] for m in made], pa.string()), "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    made = ordered.select("page_id", "url", "_payload", "_digest", "_first", "_kind").mapInArrow(run, "name string, records long, bytes long").collect()  # a row for each file
    files = sorted(({"name": r["name"], "records": r["records"], "bytes": r["bytes"]} for r in made), key=lambda f: f["name"])
    fs, base = shared.filesystem(folder)
    with fs.open_output_stream(f"{base}/.manifest.tmp") as out:
        out.write(json.dumps({"files": files}).encode())
    shared.publish(fs, f"{base}/.manifest.tmp", f"{base}/manifest.json")
    shared.sweep(fs, base)
    return files


def _search(bounds: list[tuple[int, str]]) -> str:
    """SQL for how many bounds are at most (page_id, _digest), by halving; null ids have null."""
    if not bounds:
        return "0"
    pages, digests = "array(" + ", ".join(f"{p}L" for p, _ in bounds) + ")", "array(" + ", ".join(f"'{d}'" for _, d in bounds) + ")"
    at = "cast((s.lo + s.hi) div 2 as int)"
    under = f"({pages}[{at}] < page_id or {pages}[{at}] = page_id and {digests}[{at}] <= _digest)"
    halve = f"if(s.lo >= s.hi, s, if({under}, struct(cast({at} + 1 as int) as lo, s.hi as hi), struct(s.lo as lo, {at} as hi)))"
    return f"if(page_id is null, null, aggregate(sequence(1, {len(bounds).bit_length()}), struct(0 as lo, {len(bounds)} as hi), (s, _) -> {halve}).lo)"


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest lists.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload, null for revisits).
    Digests are checked against what is stored.
    """
    fs, base = shared.filesystem(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as source:
        files = json.loads(source.read())["files"]
    names = shared.spread(spark, [f["name"] for f in files])
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())][: 6 + with_payload])

    def run(batches):
        fs, base = shared.filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for data in members(source):
                        head, block = parse(data)
                        if head["warc-type"] == "warcinfo":
                            continue
                        digest, n = head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: a block does not fit its digest")
                        payload = None
                        if head["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: a payload does not fit its digest")
                        url = head.get("warc-target-uri")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        rows.append((page and int(page), n, digest, head["warc-type"], refers and int(refers), url, payload)[: len(schema)])
                        held += len(payload or b"") * with_payload
                        if len(rows) >= 2000 or held >= 4 << 20:
                            yield shared.record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)
                            rows, held = [], 0
                if rows:
                    yield shared.record_batch(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return names.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload)
