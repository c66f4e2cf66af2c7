"""Exact removal of repeated byte strings across documents, by suffix arrays over content-dealt pieces.

Every string of ``length`` bytes belongs to one anchor, the least ``GRAM``-byte hash in it, so equal strings
have equal anchors wherever they stand. Grams that a sample of the texts shows to be very common are anchors
only of strings that have no other gram, so the surroundings of a common line are dealt by what is their own
and no anchor gathers them all. Stretches of strings with one anchor are dealt to buckets by it, aggregated
first within a unit (a row group of the working copy). Equal stretches are merged first: they are known by
128 bits, a hash of the anchor and an independent one of all their bytes. Where stretches of one anchor
differ, each different one is fetched once and a suffix array over them (linear grouping construction, see
``suffixes``) finds the strings they share, byte by byte, and each one's smallest doc_id. Groups that are too
large for one array get several, whose different strings are then merged by their bytes. The decisions
return to the units, which mark and remove bytes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.llm import shared
from almucantar.llm.suffixes import suffix_array
from almucantar.llm.words import _bytes_of, mix

GRAM = 24
NO_ID = 2**63 - 1
#: Text bytes whose anchors make up one bucket, about.
BUCKET_BYTES = 8 << 20
#: Suffix arrays are built over about this many bytes at once; larger groups of one anchor are split first.
ARRAY_BYTES = 256 << 10
#: Small groups of several anchors share arrays of about this many bytes; smaller arrays stay in a processor's cache.
CHUNK_BYTES = 32 << 10
#: Bytes that are hashed at once.
SLICE = 1 << 17
#: Very common grams are looked for in this many units, and are those seen this often there; at most so many are kept.
SAMPLE_UNITS, COMMON, MOST_COMMON = 16, 32, 1 << 20
#: Stretches that a task gathers before it deals them out.
GATHERED = 400_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA5A5B3C1F0E1D2C3, 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9)]
_U8 = "<u8"


def _windows_hash(words: np.ndarray, at: np.ndarray | slice, n: int) -> np.ndarray:
    """Hashes of n bytes from each place; ``words`` are the 8 bytes from each place on."""
    out = None
    for j, o in enumerate([*range(0, n - 7, 8)] + [n - 8] * (n % 8 > 0)):
        part = (words[at + o] if isinstance(at, np.ndarray) else words[at.start + o : at.stop + o]) * _ODD[j % 7]
        out = mix(part if out is None else out + part)
    return out


class Common:
    """Hashes of very common grams."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.shift = np.uint64(64 - min(22, max(16, len(hashes).bit_length() + 4)))
        self.flags = np.zeros(1 << (64 - int(self.shift)), bool)
        self.flags[(self.hashes >> self.shift).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are among them."""
        out = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.flatnonzero(self.flags[(h >> self.shift).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at[self.hashes[k] == h[at]]] = True
        return out


NONE = Common(np.zeros(0, np.uint64))


def grams(data: np.ndarray) -> np.ndarray:
    """The hash of the gram from each byte on."""
    data = np.ascontiguousarray(data)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    return _windows_hash(np.ndarray((len(data) - 7,), _U8, data, strides=(1,)), slice(0, len(data) - GRAM + 1), GRAM)


def stretches(data: np.ndarray, at: np.ndarray, length: int, common: Common = NONE) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch id, first and last string start, and the anchor's place, for each stretch of ``data``.

    ``at`` has the bounds of the documents in ``data``; strings do not cross them. Work goes by slices of
    about ``SLICE`` bytes; a stretch that a slice's end cuts becomes two.
    """
    parts, k = [], 0
    while k < len(at) - 1:
        a = int(at[k])
        j = int(np.searchsorted(at, a + SLICE, "right")) - 1
        if j > k:  # whole documents
            parts.append((a, _stretches(data[a : at[j]], at[k : j + 1] - a, length, common)))
            k = j
            continue
        end = int(at[k + 1])
        for lo in range(a, end, SLICE):
            hi = min(end, lo + SLICE + length - 1)
            parts.append((lo, _stretches(data[lo:hi], np.array([0, hi - lo]), length, common)))
        k += 1
    if not parts:
        return _stretches(data[:0], at[:1], length, common)
    h, sid, first, last, anchor = (np.concatenate([p[i] + (lo if i > 1 else p[i].dtype.type(0)) for lo, p in parts]) for i in range(5))
    return h, sid, first, last, anchor


def _least(low: np.ndarray, width: int) -> np.ndarray:
    """The place, in the lower half of the values, of the least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _stretches(data: np.ndarray, at: np.ndarray, length: int, common: Common) -> tuple[np.ndarray, ...]:
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    data = np.ascontiguousarray(data)
    words = np.ndarray((n - 7,), _U8, data, strides=(1,))
    n_grams = n - GRAM + 1
    h = _windows_hash(words, slice(0, n_grams), GRAM)
    low = ((h >> np.uint64(1)) & np.uint64(0x7FFFFFFF00000000)) | np.arange(n_grams, dtype=np.uint64)
    width, strings = length - GRAM + 1, n - length + 1
    anchor = _least(low, width)
    if len(common.hashes):
        # Only strings whose least gram is very common need to know which of their other grams are.
        turn = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
        bad = np.flatnonzero(common.has(h[anchor[turn[:-1]]]))
        change = np.zeros(n_grams + 1, np.int32)
        change[turn[bad]] += 1
        np.add.at(change, turn[bad + 1] + width - 1, -1)
        near = np.flatnonzero(np.cumsum(change[:-1]))
        if len(near):
            low[near] |= common.has(h[near]).astype(np.uint64) << np.uint64(63)  # above all others
            anchor = _least(low, width)
    change = np.zeros(strings + 1, np.int32)  # strings that reach over the end of a document
    ends = at[1:-1]
    np.add.at(change, np.clip(ends - length + 1, 0, strings), 1)
    np.add.at(change, np.clip(ends, 0, strings), -1)
    valid = np.cumsum(change[:-1]) == 0
    new = np.empty(strings + 1, bool)
    new[0] = new[-1] = True
    new[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first, last = np.flatnonzero(new[:-1] & valid), np.flatnonzero(new[1:] & valid)
    sid = mix(_windows_hash(words, first, length) * _ODD[0] + mix(_windows_hash(words, last, length) + (last - first).astype(np.uint64)))
    return h[anchor[first]], sid, first, last, anchor[first]


def _pack(**columns: np.ndarray) -> bytes:
    """Columns as compressed planes of bytes."""
    head = ";".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in columns.items()).encode()
    body = b"".join(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes() for v in columns.values() if len(v))
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(1).compress(body)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, {}
    for item in blob[4 : 4 + n].decode().split(";"):
        name, kind, rows = item.split(":")
        kind, rows = np.dtype(kind), int(rows)
        size = kind.itemsize * rows
        planes = np.frombuffer(body, np.uint8, size, at).reshape(kind.itemsize, rows)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += size
    return out


def _joined(blobs: list[dict[str, np.ndarray]], names: list[str], kinds: list[str]) -> list[np.ndarray]:
    return [np.concatenate([b[k] for b in blobs]) if blobs else np.zeros(0, t) for k, t in zip(names, kinds, strict=True)]


def _places(known_sid: np.ndarray, known_h: np.ndarray, sid: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch is among the known ones, and whether it is there; both hashes must be equal."""
    if not len(known_sid):
        return np.zeros(len(sid), np.int64), np.zeros(len(sid), bool)
    order = np.argsort(known_sid, kind="stable")
    s, t = known_sid[order], known_h[order]
    k = np.minimum(np.searchsorted(s, sid), len(s) - 1)
    while True:
        following = np.minimum(k + 1, len(s) - 1)
        on = (s[k] == sid) & (t[k] != h) & (following > k) & (s[following] == sid)
        if not on.any():
            return order[k], (s[k] == sid) & (t[k] == h)
        k = np.where(on, following, k)


def _unit(file: pq.ParquetFile, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Bytes, documents' bounds and ids (null: the largest), and ids as they are, of a row group."""
    part = file.read_row_group(group, ["doc_id", "text"]).combine_chunks()
    texts, ids = part["text"].combine_chunks(), part["doc_id"].combine_chunks()
    data, at = _bytes_of(texts.cast(pa.large_string()))
    return data, at, ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), ids


def _open(uri: str):
    fs, path = shared.filesystem(uri)
    return fs.open_input_file(path)


_BLOBS = ["key", "blob"]


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], _BLOBS)


def _common(batches):
    """Grams that a unit of each file has several times, and how often."""
    for batch in batches:
        for item in batch.column(0).to_pylist():
            number, uri = item.split("|", 1)
            with _open(uri) as source:
                file = pq.ParquetFile(source)
                if not file.num_row_groups:
                    continue
                data = _unit(file, int(number) % file.num_row_groups)[0]
                order = np.sort(np.concatenate([grams(data[a : a + SLICE + GRAM - 1]) for a in range(0, max(1, len(data)), SLICE)]))
                new = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(order)])
                some = n >= max(2, COMMON // SAMPLE_UNITS)
                yield pa.RecordBatch.from_arrays([pa.array(order[new][some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["gram", "n"])


def common_grams(spark: SparkSession, uris: list[str]) -> Common:
    """The very common grams of a sample of units: which they are changes how work is dealt, never a result."""
    step = -(-len(uris) // SAMPLE_UNITS)
    found = shared.spread(spark, [f"{i}|{u}" for i, u in list(enumerate(uris))[::step]]).mapInArrow(_common, "gram long, n long")
    most = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(MOST_COMMON)
    return Common(most.select("gram").toArrow()["gram"].to_numpy().view(np.uint64))


def _anchors(length: int, buckets: int, sent):
    """Units to blobs of their stretches by bucket, equal ones within a unit together."""

    def dealt(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, sid, doc, many, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
        return _rows([(int(bucket[i[0]]), _pack(h=h[i], sid=sid[i], doc=doc[i], many=many[i], unit=unit[i])) for i in np.split(order, new[1:])])

    def run(batches):
        shared.begin("substrings")
        parts, held = [], 0
        for batch in batches:
            for item in batch.column(0).to_pylist():
                number, uri = item.split("|", 1)
                with _open(uri) as source:
                    file = pq.ParquetFile(source)
                    for group in range(file.num_row_groups):
                        data, at, ids, _ = _unit(file, group)
                        h, sid, first, *_ = stretches(data, at, length, sent.value)
                        if not len(h):
                            continue
                        doc = ids[np.searchsorted(at, first, "right") - 1]
                        order = np.lexsort((doc, sid))
                        if ((h[order][1:] != h[order][:-1]) & (sid[order][1:] == sid[order][:-1])).any():  # two stretches of one hash
                            order = np.lexsort((doc, h, sid))
                        h, sid, doc = h[order], sid[order], doc[order]
                        new = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (h[1:] != h[:-1])])
                        many = np.maximum.reduceat(doc, new) > doc[new]
                        parts.append((h[new], sid[new], doc[new], many, np.full(len(new), int(number) * 2**20 + group, np.int64)))
                        held += len(new)
                        if held >= GATHERED:
                            yield dealt(parts)
                            parts, held = [], 0
        if parts:
            yield dealt(parts)

    return run


def _decide(batches):
    """A bucket's blobs to decisions (kind 0, by unit), memberships (1, by bucket) and requests (2, by unit)."""
    by_key: dict[int, list[bytes]] = {}
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_key.setdefault(key, []).append(blob)
    for key in sorted(by_key):
        h, sid, doc, many, unit = _joined([_unpack(b) for b in by_key.pop(key)], ["h", "sid", "doc", "many", "unit"], [_U8, _U8, "<i8", "?", "<i8"])
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.diff(np.r_[new, len(h)]) > 1
        keep = np.repeat(several | np.logical_or.reduceat(many[order], new), np.diff(np.r_[new, len(h)]))
        order, h = order[keep], h[keep]
        sid, doc, many, unit = sid[order], doc[order], many[order], unit[order]
        order = np.lexsort((unit, doc, sid, h))
        h, sid, doc, many, unit = h[order], sid[order], doc[order], many[order], unit[order]
        if not len(h):
            continue
        new = np.r_[True, h[1:] != h[:-1]]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(h)])
        least = np.minimum.reduceat(doc, starts)
        common = (np.maximum.reduceat(doc, starts) > least) | np.logical_or.reduceat(many, starts)
        fresh = new | np.r_[True, sid[1:] != sid[:-1]]
        kinds = np.add.reduceat(fresh.astype(np.int64), starts)
        row_least, plain, mixed = (np.repeat(x, sizes) for x in (least, common & (kinds == 1), common & (kinds > 1)))
        out = []
        told = plain & (many | (doc > row_least))
        for u, i in _by(unit, told):
            out.append((0, u, _pack(h=h[i], sid=sid[i], least=row_least[i])))
        if mixed.any():
            out.append((1, key, _pack(h=h[mixed], sid=sid[mixed], unit=unit[mixed], doc=doc[mixed], many=many[mixed])))
            for u, i in _by(unit, mixed & fresh):
                out.append((2, u, _pack(sid=sid[i], doc=doc[i], h=h[i])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["kind", "key", "blob"])


def _by(key: np.ndarray, chosen: np.ndarray):
    """Indices of the chosen rows for each key."""
    i = np.flatnonzero(chosen)
    i = i[np.argsort(key[i], kind="stable")]
    for part in np.split(i, np.flatnonzero(np.diff(key[i])) + 1) if len(i) else []:
        yield int(key[part[0]]), part


def _gathered(batches) -> dict[int, list[dict[str, np.ndarray]]]:
    out: dict[int, list[dict[str, np.ndarray]]] = {}
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = out.setdefault(key, [])
            if blob is not None:
                own.append(_unpack(blob))
    return out


def _fetch(uris: list[str], length: int, buckets: int, sent):
    """Requests to the texts of stretches, by bucket."""

    def run(batches):
        wanted = _gathered(batches)
        for number in sorted({u >> 20 for u in wanted}):
            with _open(uris[number]) as source:
                file = pq.ParquetFile(source)
                for unit in sorted(u for u in wanted if u >> 20 == number):
                    asked, doc, of = _joined(wanted.pop(unit), ["sid", "doc", "h"], [_U8, "<i8", _U8])
                    data, at, _, _ = _unit(file, unit & (2**20 - 1))
                    h, sid, first, last, anchor = stretches(data, at, length, sent.value)
                    k, there = _places(asked, of, sid, h)
                    hit = np.flatnonzero(there)
                    k, one = np.unique(k[hit], return_index=True)
                    hit = hit[one]
                    size = last[hit] - first[hit] + length
                    rows = []
                    for b, i in _by((of[k] % np.uint64(buckets)).astype(np.int64), np.ones(len(k), bool)):
                        own = np.repeat(first[hit[i]] - np.cumsum(size[i]) + size[i], size[i]) + np.arange(int(size[i].sum()))
                        rows.append((b, _pack(h=of[k[i]], sid=asked[k[i]], doc=doc[k[i]], size=size[i].astype(np.int32), left=(anchor[hit[i]] - first[hit[i]]).astype(np.int32), text=data[own])))
                    yield _rows(rows)

    return run


def _compare(length: int):
    """Memberships and texts of a bucket to decisions for each string of a stretch, by unit."""

    def run(batches):
        for _, blobs in sorted(_gathered(batches).items()):
            texts, members = [b for b in blobs if "text" in b], [b for b in blobs if "text" not in b]
            if not texts:
                continue
            h, sid, doc, size, left, text = _joined(texts, ["h", "sid", "doc", "size", "left", "text"], [_U8, _U8, "<i8", "<i4", "<i4", "u1"])
            at = np.cumsum(size) - size
            least = shared_strings(h, doc, size, left, at, text, length)  # for each string of each stretch
            strings = size - length + 1
            where = np.cumsum(strings) - strings
            m_sid, m_h, m_unit, m_doc, m_many = _joined(members, ["sid", "h", "unit", "doc", "many"], [_U8, _U8, "<i8", "<i8", "?"])
            k, there = _places(sid, h, m_sid, m_h)
            if not there.all():
                raise ValueError("a stretch that was asked for has not come")
            told = m_many | (m_doc > np.minimum.reduceat(least, where)[k])
            rows = []
            for u, i in _by(m_unit, told):
                n = strings[k[i]]
                own = np.repeat(where[k[i]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                rows.append((u, _pack(h=m_h[i], sid=m_sid[i], strings=n.astype(np.int32), least=least[own])))
            yield _rows(rows)

    return run


def shared_strings(h: np.ndarray, doc: np.ndarray, size: np.ndarray, left: np.ndarray, at: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """The smallest doc_id that has each string of each stretch, given the smallest that has the stretch.

    Two stretches of one anchor share a string if they share, for some split of the bytes beside the anchor, those
    on either side. What no partner shares at a stretch's ends, and stretches without any partner, are left out of
    the suffix arrays, and of what is left equal ones, byte by byte, go there once. Large groups are split by half
    of the bytes on either side.
    """
    strings = size - length + 1
    where = np.cumsum(strings) - strings
    least = np.repeat(doc, strings)
    beside = length - GRAM
    around = [_outward(text, at + left - 1, left, -1, beside), _outward(text, at + left + GRAM, size - left - GRAM, 1, beside)]
    low, high = np.full(len(h), beside + 1), np.full(len(h), -1)  # bytes before the anchor in the last and first such string
    for l in range(beside + 1):
        i = np.flatnonzero((left >= l) & (size - left - GRAM >= beside - l))
        i = i[_repeated(mix(h[i] + around[0][l][i] * _ODD[1] + around[1][beside - l][i] * _ODD[2]))]
        low[i] = np.minimum(low[i], l)
        high[i] = l
    some = np.flatnonzero(high >= 0)
    if not len(some):
        return least
    first = (left - high)[some]
    one, back = _equal(text, at[some] + first, (high - low)[some] + length)
    h, at, left, size = h[some][one], (at[some] + first)[one], high[some][one], (high - low)[some][one] + length
    lowest = np.full(len(one), NO_ID, np.int64)
    np.minimum.at(lowest, back, doc[some])
    n_own = size - length + 1
    own_where = np.cumsum(n_own) - n_own
    own_least = np.repeat(lowest, n_own)
    side, keys, partner = beside // 2, [], []
    for sums, there in zip(around, (left, size - left - GRAM), strict=True):
        key = mix(np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))  # alone
        i = there >= side
        key[i] = mix(h[i] + sums[side][some[one[i]]])
        keys.append(key)
        partner.append(_repeated(key))
    order = np.argsort(h, kind="stable")
    chunk, held = [], 0
    for group in np.split(order, np.flatnonzero(np.diff(h[order])) + 1):
        n = int(size[group].sum())
        if n > 4 * ARRAY_BYTES:
            for key, has in zip(keys, partner, strict=True):
                own = group[has[group]]
                own = own[np.argsort(key[own], kind="stable")]
                for part in np.split(own, np.flatnonzero(np.diff(key[own])) + 1) if len(own) else []:
                    _by_arrays(part, size, at, text, own_where, own_least, length)
            continue
        if held + n > CHUNK_BYTES and chunk:
            _by_array(chunk, size, at, text, own_where, own_least, length)
            chunk, held = [], 0
        chunk.append(group)
        held += n
    if chunk:
        _by_array(chunk, size, at, text, own_where, own_least, length)
    n = n_own[back]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    least[np.repeat(where[some] + first, n) + step] = own_least[np.repeat(own_where[back], n) + step]
    return least


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are there more than once."""
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[back] > 1


def _equal(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each different stretch of bytes, and which of these each stretch equals."""
    one, back = [], np.zeros(len(size), np.int64)
    for n in np.unique(size):  # few: from a string's length to less than twice that
        i = np.flatnonzero(size == n)
        rows = np.ascontiguousarray(text[begin[i][:, None] + np.arange(n)]).view(f"V{n}").ravel()
        _, k, of = np.unique(rows, return_index=True, return_inverse=True)
        back[i] = of + sum(map(len, one))
        one.append(i[k])
    return np.concatenate(one), back


def _outward(text: np.ndarray, start: np.ndarray, there: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """Hashes of the first 0 to ``most`` bytes from each place in one direction; what lies beyond ``there`` means nothing."""
    out = [np.zeros(len(start), np.uint64)]
    for j in range(most):
        byte = text[np.where(j < there, start + step * j, 0)].astype(np.uint64)
        out.append(mix(out[-1] * _ODD[3] + byte + np.uint64(1)))
    return out


def _by_arrays(group: np.ndarray, size: np.ndarray, at: np.ndarray, text: np.ndarray, where: np.ndarray, least: np.ndarray, length: int) -> None:
    """As ``_by_array`` for one group of any size: in arrays of ``ARRAY_BYTES``, whose different strings are merged by their bytes."""
    ends = np.cumsum(size[group].astype(np.int64))
    if ends[-1] <= 4 * ARRAY_BYTES:
        _by_array([group], size, at, text, where, least, length)
        return
    cuts = np.flatnonzero(np.diff(ends // ARRAY_BYTES)) + 1
    runs = [_by_array([part], size, at, text, where, least, length) for part in np.split(group, cuts)]
    ones = np.concatenate([place[np.flatnonzero(np.r_[True, np.diff(run) > 0])] for place, run in runs])  # one string of each run
    inside = np.sort(group)  # `where` rises with the stretches
    of = inside[np.searchsorted(where[inside], ones, "right") - 1]
    begin = at[of] + ones - where[of]
    words = np.ndarray((len(text) - 7,), _U8, np.ascontiguousarray(text), strides=(1,))
    deal = np.concatenate([_windows_hash(words, begin[i : i + 65536], length) for i in range(0, len(begin), 65536)])
    classes = -(-len(ones) * length // (16 * ARRAY_BYTES))
    lowest = least[ones]
    for c in range(classes):
        some = np.flatnonzero(deal % np.uint64(classes) == c)
        if not len(some):
            continue
        rows = np.ascontiguousarray(text[begin[some][:, None] + np.arange(length)]).view(f"V{length}").ravel()
        _, back = np.unique(rows, return_inverse=True)
        low = np.full(int(back.max()) + 1, NO_ID, np.int64)
        np.minimum.at(low, back, lowest[some])
        lowest[some] = low[back]
    done = 0
    for place, run in runs:
        n = int(run[-1]) + 1 if len(run) else 0
        np.minimum.at(least, place, lowest[done : done + n][run])
        done += n


def _by_array(groups: list[np.ndarray], size: np.ndarray, at: np.ndarray, text: np.ndarray, where: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowers ``least`` to the smallest among equal strings, found as runs in the suffix array of the stretches.

    Returns the strings' places in order and the number of each one's run.
    """
    own = np.concatenate(groups)
    n = size[own].astype(np.int64) + 1
    ends = np.cumsum(n)
    joined = np.zeros(int(ends[-1]), np.int64)  # 0 ends each stretch
    source = np.repeat(at[own] - ends + n, n) + np.arange(len(joined))
    inside = np.ones(len(joined), bool)
    inside[ends - 1] = False
    joined[inside] = text[source[inside]].astype(np.int64) + 1
    string = np.full(len(joined), -1, np.int64)  # the place in `least` of the string that begins here
    offset = np.arange(len(joined)) - np.repeat(ends - n, n)
    begins = offset < np.repeat(n - length, n)
    string[begins] = (np.repeat(where[own], n) + offset)[begins]
    order = suffix_array(joined)
    order = order[string[order] >= 0]
    view = np.lib.stride_tricks.sliding_window_view(joined.astype(np.int16), length)
    same = np.ones(len(order), bool)
    for i in range(1, len(order), 65536):
        j = min(len(order), i + 65536)
        same[i:j] = (view[order[i:j]] == view[order[i - 1 : j - 1]]).all(1)
    same[:1] = False
    run = np.cumsum(~same) - 1
    place = string[order]
    smallest = np.minimum.reduceat(least[place], np.flatnonzero(~same))
    np.minimum.at(least, place, smallest[run])
    return place, run


def _apply(uris: list[str], length: int, with_kept: bool, sent):
    """Decisions to each document's result."""

    def run(batches):
        told = _gathered(batches)
        numbers = sorted({u >> 20 for u in told})
        for number in numbers:
            with _open(uris[number]) as source:
                file = pq.ParquetFile(source)
                for group in range(file.num_row_groups):
                    data, at, ids, raw_ids = _unit(file, group)
                    blobs = told.pop(number * 2**20 + group, [])
                    marks = np.zeros(len(data) + 1, np.int32)
                    if any("sid" in b for b in blobs):
                        _mark(marks, [b for b in blobs if "sid" in b], data, at, ids, length, sent.value)
                    gone = np.cumsum(marks[:-1]) > 0
                    starts = gone.copy()
                    starts[1:] &= ~gone[:-1]
                    edge = at[:-1][at[:-1] < len(data)]
                    starts[edge] = gone[edge]
                    n_gone, n_starts = (np.r_[0, np.cumsum(x)][at] for x in (gone, starts))
                    kept = [data[a:b][~gone[a:b]].tobytes() if c else data[a:b].tobytes() for a, b, c in zip(at[:-1], at[1:], np.diff(n_gone), strict=True)]
                    columns = [raw_ids.cast(pa.int64()), pa.array(np.diff(at)), pa.array(np.diff(n_gone)), pa.array(np.diff(n_starts)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                    if with_kept:
                        columns.append(pa.array(kept, pa.binary()))
                        names.append("kept")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _mark(marks: np.ndarray, blobs: list[dict[str, np.ndarray]], data: np.ndarray, at: np.ndarray, ids: np.ndarray, length: int, common: Common) -> None:
    """Adds 1 where a removed string begins and takes it away after its end."""
    h, sid, first, last, _ = stretches(data, at, length, common)
    doc = ids[np.searchsorted(at, first, "right") - 1]
    known, known_h, least = _joined([b for b in blobs if "strings" not in b], ["sid", "h", "least"], [_U8, _U8, "<i8"])
    if len(known):
        k, hit = _places(known, known_h, sid, h)
        hit &= doc > least[k]
        np.add.at(marks, first[hit], 1)
        np.add.at(marks, last[hit] + length, -1)
    known, known_h, strings, least = _joined([b for b in blobs if "strings" in b], ["sid", "h", "strings", "least"], [_U8, _U8, "<i4", "<i8"])
    if len(known):
        k, hit = _places(known, known_h, sid, h)
        hit = np.flatnonzero(hit)
        k = k[hit]
        where = np.cumsum(strings) - strings
        n = strings[k].astype(np.int64)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin = np.repeat(first[hit], n) + step
        begin = begin[np.repeat(doc[hit], n) > least[np.repeat(where[k], n) + step]]
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + length, -1)


def remove_repeats(docs: DataFrame, length: int = 50, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) for each row of ``docs`` (doc_id, text).

    A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller
    doc_id, judged on the input. Null texts are empty; rows without a doc_id count as after all others;
    rows that share a doc_id are not earlier than one another. Texts of any length are judged as a whole. An
    empty table gives an empty one; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    if length < GRAM + 8:
        raise ValueError(f"strings must have at least {GRAM + 8} bytes")
    shared.small_arrow_batches(spark)
    path = shared.new_dir(spark, "texts")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    own = spark.read.schema(narrow.schema).parquet(path)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uris = sorted(own.inputFiles()) if not own.isEmpty() else []
    if not uris:
        empty = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
        return spark.createDataFrame([], empty)
    buckets = max(12, math.ceil(size / BUCKET_BYTES))
    sent = spark.sparkContext.broadcast(common_grams(spark, uris))  # 12 MB at most
    blobs = "key long, blob binary"
    anchors = shared.spread(spark, [f"{i}|{u}" for i, u in enumerate(uris)]).mapInArrow(_anchors(length, buckets, sent), blobs)
    decided = anchors.repartitionById(buckets, F.col("key").cast("int")).mapInArrow(_decide, "kind int, key long, blob binary")
    decided = shared.written(decided, "decided")
    of_file = F.shiftright("key", 20).cast("int")
    asked = decided.where("kind = 2").select("key", "blob").repartitionById(len(uris), of_file)
    texts = asked.mapInArrow(_fetch(uris, length, buckets, sent), blobs)
    bucketed = texts.unionByName(decided.where("kind = 1").select("key", "blob")).repartitionById(buckets, F.col("key").cast("int"))
    compared = shared.written(bucketed.mapInArrow(_compare(length), blobs), "compared")
    stubs = spark.createDataFrame([(i << 20, None) for i in range(len(uris))], blobs)
    told = decided.where("kind = 0").select("key", "blob").unionByName(compared).unionByName(stubs).repartitionById(len(uris), of_file)
    # A document without any decision comes back whole, since every file has a stub.
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return told.mapInArrow(_apply(uris, length, with_kept, sent), schema)
