"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of whole documents, one after another, in blocks of 512. A block stores its minimum,
the differences from it in as many bits as the chosen percentile of them needs, and the outliers in an
exception list (place and full difference). At the file's end stand the documents' ids and lengths and
where each block starts, so any document can be read without the rest.

Layout (little-endian): magic ``PFOR0001``; blocks; footer: doc ids int64 (null: the smallest int64),
lengths uint32, block starts uint64 (one more than blocks); tail: documents, tokens, blocks, block size,
footer start, each uint64; magic.
A block: minimum uint32, width uint8, exceptions uint16, places uint16 each, differences uint32 each,
packed 64-bit words.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.llm import shared, tokens

MAGIC = b"PFOR0001"
BLOCK = 512
NO_ID = -(2**63)
_LANES = 64


def _widths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values under 2**width as rows of 64-bit words."""
    rows = len(values)
    lanes = np.ascontiguousarray(values.reshape(rows * (BLOCK // _LANES), _LANES).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(_LANES if width else 0):
        word, shift = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(rows, -1)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack_bits``."""
    rows = len(words)
    if not width:
        return np.zeros((rows, BLOCK), np.uint64)
    words = np.ascontiguousarray(words.reshape(rows * (BLOCK // _LANES), width).T)
    lanes, mask = np.empty((_LANES, words.shape[1]), np.uint64), np.uint64(2**width - 1)
    for j in range(_LANES):
        word, shift = divmod(j * width, 64)
        lane = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lane |= words[word + 1] << np.uint64(64 - shift)
        lanes[j] = lane & mask
    return np.ascontiguousarray(lanes.T).reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 0.95) -> list[bytes]:
    """Blocks of ``BLOCK`` ids each; ``ids`` must fill them, but for the last, which its own last id fills up."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    values = np.concatenate([ids, np.repeat(ids[-1:], short)]).astype(np.uint64).reshape(-1, BLOCK)
    least = values.min(1)
    values = values - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = _widths(np.partition(values, at, axis=1)[:, at])
    limit = np.uint64(1) << width.astype(np.uint64)
    over = values >= limit[:, None]
    out: list[bytes] = [b""] * len(values)
    for w in np.unique(width):
        here = np.flatnonzero(width == w)
        packed = pack_bits(np.where(over[here], np.uint64(0), values[here]), int(w))
        for k, i in enumerate(here):
            places = np.flatnonzero(over[i])
            head = struct.pack("<IBH", int(least[i]), int(w), len(places))
            out[i] = head + places.astype("<u2").tobytes() + values[i][places].astype("<u4").tobytes() + packed[k].astype("<u8").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of whole blocks, those that fill up the last included."""
    out = np.empty((len(blocks), BLOCK), np.uint64)
    by_width: dict[int, list[int]] = {}
    heads = [struct.unpack_from("<IBH", b) for b in blocks]
    for i, (_, w, _) in enumerate(heads):
        by_width.setdefault(w, []).append(i)
    for w, here in by_width.items():
        words = np.stack([np.frombuffer(blocks[i], "<u8", offset=7 + 6 * heads[i][2]) for i in here]) if w else np.zeros((len(here), 0), np.uint64)
        out[here] = unpack_bits(words, w)
    for i, (least, _, n) in enumerate(heads):
        if n:
            out[i, np.frombuffer(blocks[i], "<u2", n, 7)] = np.frombuffer(blocks[i], "<u4", n, 7 + 2 * n)
        out[i] += np.uint64(least)
    return out.reshape(-1).astype(np.uint32)


class Writer:
    """Writes one file; ids may come in any portions."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.docs, self.lengths, self.starts = [], [], [len(MAGIC)]
        self.rest, self.tokens = np.zeros(0, np.uint32), 0
        out.write(MAGIC)

    def _put(self, blocks: list[bytes]) -> None:
        self.out.write(b"".join(blocks))
        ends = self.at + np.cumsum([len(b) for b in blocks], dtype=np.int64)
        self.starts += ends.tolist()
        self.at = self.starts[-1]

    def add(self, docs: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs += [NO_ID if d is None else d for d in docs]
        self.lengths.append(lengths)
        self.tokens += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        self._put(encode_blocks(self.rest[:whole]))
        self.rest = self.rest[whole:].copy()

    def close(self) -> None:
        self._put(encode_blocks(self.rest))
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0)
        self.out.write(np.array(self.docs, "<i8").tobytes() + lengths.astype("<u4").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(struct.pack("<5Q", len(self.docs), self.tokens, len(self.starts) - 1, BLOCK, self.at) + MAGIC)


class Reader:
    """Reads a file written by ``Writer``, all of it or one document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(48, size - 48)
        if tail[40:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file, or cut short")
        n, self.tokens, blocks, _, at = struct.unpack("<5Q", tail[:40])
        footer = source.read_at(size - 48 - at, at)
        self.docs = np.frombuffer(footer, "<i8", n)
        self.lengths = np.frombuffer(footer, "<u4", n, 8 * n).astype(np.int64)
        self.starts = np.frombuffer(footer, "<u8", blocks + 1, 12 * n).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids a <= i < b of the file."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // BLOCK, -(-b // BLOCK)
        raw = self.source.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i]))
        cuts = self.starts[i : j + 1] - self.starts[i]
        return decode_blocks([raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])[a - i * BLOCK : b - i * BLOCK]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = 32 << 20) -> list[dict]:
    """Writes the ids of all documents below ``folder`` in ascending doc_id order; returns the manifest.

    Null texts count as empty and still have ``end_id``; rows that repeat a doc_id follow one another by
    text; null ids come first. Each task writes under temporary names and renames what it has finished;
    ``manifest.json``, written last, lists the files in order and makes them count. File names tell the
    order, so a repeated task makes its own files with the same bytes. Texts of any length are whole documents of
    one file; an empty table gives a manifest without files; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    shared.small_arrow_batches(spark)
    shared.make_dir(folder)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        fs, base = shared.filesystem(folder)
        encode = tokens.encoder(tokenizer, keeps_space=False)
        task = TaskContext.get()
        made, writer, out = [], None, None

        def finish():
            writer.close()
            out.close()
            name = f"part-{task.partitionId():06d}-{len(made):04d}.ids"
            shared.publish(fs, temporary, f"{base}/{name}")
            made.append((name, len(writer.docs), writer.tokens))

        for batch in shared.text_batches(batches, tokens.BATCH):
            if writer is None:
                temporary = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}-{len(made)}.tmp"
                out = fs.open_output_stream(temporary)
                writer = Writer(out)
            ids, bounds = encode.encode(batch.column(1))
            writer.add(batch.column(0).to_pylist(), np.diff(bounds) + 1, np.insert(ids, bounds[1:], end_id).astype(np.uint32))
            if writer.tokens >= file_tokens:
                finish()
                writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"name": pa.array([m[0] for m in made], pa.string()), "docs": pa.array([m[1] for m in made], pa.int64()), "tokens": pa.array([m[2] for m in made], pa.int64())})

    rows = ordered.mapInArrow(run, "name string, docs long, tokens long").collect()  # a row for each file
    files, start = [], 0
    for r in sorted(rows, key=lambda r: r["name"]):
        files.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    fs, base = shared.filesystem(folder)
    with fs.open_output_stream(f"{base}/.manifest.tmp") as out:
        out.write(json.dumps({"files": files, "end_id": end_id}).encode())
    shared.publish(fs, f"{base}/.manifest.tmp", f"{base}/manifest.json")
    shared.sweep(fs, base)
    return files


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the files that the manifest lists: doc_id, start, n_tokens, ids_crc32."""
    fs, base = shared.filesystem(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as source:
        files = json.loads(source.read())["files"]
    names = shared.spread(spark, [f"{f['start']}:{f['name']}" for f in files])

    def run(batches):
        fs, base = shared.filesystem(folder)
        for batch in batches:
            for item in batch.column(0).to_pylist():
                start, name = item.split(":", 1)
                with fs.open_input_file(f"{base}/{name}") as source:
                    file = Reader(source)
                    k = 0
                    while k < len(file.docs):
                        j = max(k + 1, int(np.searchsorted(file.first, file.first[k] + (1 << 20), "right")) - 1)
                        a, cuts = int(file.first[k]), file.first[k : j + 1] - file.first[k]
                        ids = file.ids(a, int(file.first[j]))
                        crcs = [tokens.crc32(ids[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                        docs = pa.array(file.docs[k:j], pa.int64(), mask=file.docs[k:j] == NO_ID)
                        yield pa.RecordBatch.from_arrays([docs, pa.array(int(start) + a + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        k = j

    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
