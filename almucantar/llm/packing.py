"""Best-fit packing of whole documents into sequences of bounded length, with large-item matching.

Only how many pieces there are of each length decides the plan, so the driver sees a histogram with at
most ``capacity`` entries, however many documents there are. The plan:

1. full pieces have a sequence each;
2. large pieces (over a third of the capacity) go at most two to a sequence: from the largest down, each
   takes the largest partner that still fits beside it;
3. smaller pieces, from the largest down, go to the sequence with the smallest gap that holds them, or
   open a new one.

Pieces of one length are interchangeable: the r-th of them, in a fixed order, takes the r-th place that
the plan has for its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almucantar.llm import shared, tokens

#: One stretch of places: the places r0 <= r < r1 of pieces of this length lie in the sequences from
#: ``first`` on, ``per`` in each, from ``base`` on.
PLAN_SCHEMA = "length long, r0 long, r1 long, first long, per long, base long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length; rows as in ``PLAN_SCHEMA``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    taken: Counter[int] = Counter()
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> stretches (first sequence, how many) with it
    order: list[int] = []  # the gaps there are, ascending
    used = 0

    def put(length: int, first: int, bins: int, per: int, base: int) -> None:
        rows.append((length, taken[length], taken[length] + bins * per, first, per, base))
        taken[length] += bins * per

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((p for p in large if left[p] and p <= min(length, capacity - length)), None)
            if partner is None:
                put(length, used, left[length], 1, 0)
                leave(capacity - length, used, left[length])
                used += left[length]
                left[length] = 0
            elif partner == length:
                bins = left[length] // 2
                if bins:
                    put(length, used, bins, 2, 0)
                    leave(capacity - 2 * length, used, bins)
                    used += bins
                    left[length] -= 2 * bins
                if left[length]:  # the odd one looks for a smaller partner
                    other = next((p for p in large if p < length and left[p] and p <= capacity - length), None)
                    put(length, used, 1, 1, 0)
                    left[length] = 0
                    if other is not None:
                        put(other, used, 1, 1, length)
                        left[other] -= 1
                    leave(capacity - length - (other or 0), used, 1)
                    used += 1
            else:
                bins = min(left[length], left[partner])
                put(length, used, bins, 1, 0)
                put(partner, used, bins, 1, length)
                left[length] -= bins
                left[partner] -= bins
                leave(capacity - length - partner, used, bins)
                used += bins
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
                fresh = False
            else:
                gap, fresh = capacity, True
                first, bins = used, -(-left[length] // (capacity // length))
            per = gap // length
            full = min(bins, left[length] // per)
            if full:
                put(length, first, full, per, capacity - gap)
                leave(gap - per * length, first, full)
                left[length] -= full * per
            rest = left[length] if full < bins and left[length] < per else 0
            if rest:
                put(length, first + full, 1, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
                left[length] -= rest
                full += 1
            if fresh:
                used += full
            elif full < bins:
                leave(gap, first + full, bins - full)
    return rows


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be shorter than the capacity, if there are more."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = pa.list_(pa.uint32())


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Tokenizes whole documents (null: empty), appends ``end_id`` and cuts those over the capacity.

    A row for each piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids.
    """
    shared.small_arrow_batches(docs.sparkSession)

    def run(batches):
        encode = tokens.encoder(tokenizer, keeps_space=True)
        for batch in shared.text_batches(batches, tokens.BATCH):
            ids, bounds = encode.encode(batch.column(1))
            rows, parts = [], []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                for k, (start, length) in enumerate(pieces_of(len(own), capacity)):
                    part = own[start : start + length]
                    rows.append((doc, k, start, length, tokens.crc32(part)))
                    parts.append(part)
            out = shared.record_batch(dict(zip(_PIECE.names, list(zip(*rows, strict=True)) or [()] * 5, strict=True)), _PIECE)
            if with_ids:
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate(parts).astype(np.int64) if parts else [], pa.int64()))
                out = out.append_column("ids", lists)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Null
    texts count as empty and still have their end id; null ids stay null. Rows that repeat a doc_id are packed
    one by one. A text of any length is cut into pieces of the capacity. An empty table gives an empty one;
    further columns, whatever their names, are not read. The places that the pieces of one length take go by the rows'
    order in the table that is written first, so a retried task gives them the same places.
    """
    spark = docs.sparkSession
    pieces = cut(docs, tokenizer, end_id, capacity, with_ids)
    own = shared.written(pieces, "pieces")
    by_file = own.groupBy(F.col("_metadata.file_name").alias("_file"), "length").agg(F.count("*").alias("n"))
    by_file = shared.written(by_file, "lengths")
    counts = {r["length"]: r["n"] for r in by_file.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_file.withColumn("_before", F.coalesce(before, F.lit(0)))
    # Each file's starts, at most `capacity` of them, go to the rows of that file.
    by_start = starts.groupBy("_file").agg(F.map_from_entries(F.collect_list(F.struct("length", "_before"))).alias("_before"))
    table = sorted(places)
    keys = np.array([(r[0], r[1]) for r in table], np.int64).reshape(-1, 2)
    values = np.array([(r[3], r[4], r[5]) for r in table], np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast((keys, values))  # bounded by the capacity, not by the documents
    uris = sorted(own.inputFiles())
    names = shared.spread(spark, uris, column="uri").withColumn("_file", F.element_at(F.split("uri", "/"), -1))

    def run(batches):
        import pyarrow.parquet as pq

        keys, values = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = shared.filesystem(row["uri"])
                rank = dict(row["_before"])
                with fs.open_input_file(path) as source:
                    for part in pq.ParquetFile(source).iter_batches(20_000):
                        length = part.column("length").to_numpy()
                        r = np.empty(len(length), np.int64)
                        for n in np.unique(length):
                            here = np.flatnonzero(length == n)
                            r[here] = rank[int(n)] + np.arange(len(here))
                            rank[int(n)] += len(here)
                        k = _find(keys, length, r)
                        first, per, base = values[k].T
                        within = r - keys[k, 1]
                        part = part.append_column("sequence_id", pa.array(first + within // per, pa.int64()))
                        yield part.append_column("offset", pa.array(base + within % per * length, pa.int64()))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    joined = names.join(by_start, "_file").select("uri", "_before")
    return joined.repartition(max(1, len(uris))).mapInArrow(run, schema)


def _find(keys: np.ndarray, length: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The last plan row with this length and r0 <= r."""
    most = int(max(keys[:, 1].max(), r.max())) + 1
    return np.searchsorted(keys[:, 0] * most + keys[:, 1], length * most + r, "right") - 1
