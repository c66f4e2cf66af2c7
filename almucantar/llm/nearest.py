"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the least
distance, and are rotated at random. In each probed list the distance is summed over blocks of
coordinates; after each block, candidates whose partial distance shows, by a hypothesis test, that the
whole one is over the query's threshold are abandoned. What stays is scored exactly on the original
vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almucantar.llm import shared

#: Coordinates that are looked at between two tests.
COLUMNS = 16


@dataclass
class Index:
    """Rotation, the norm that all vectors are raised to, and the lists' centres (rotated)."""

    dim: int
    norm: float
    rotation: np.ndarray
    centres: np.ndarray

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Data vectors with their last coordinate, rotated."""
        last = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate([x, last[:, None]], 1) @ self.rotation

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries, scaled to the data's norm, rotated."""
        q = q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres."""
        return (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector, in pieces of at most about 64 MB."""
        n = max(1, min(4096, (1 << 23) // max(1, len(self.centres))))
        return np.concatenate([self.distances(x[i : i + n]).argmin(1) for i in range(0, len(x), n)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, norm: float, lists: int, rounds: int = 12, seed: int = 23) -> Index:
    """Centres by k-means on a sample."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    index = Index(dim, norm, rotation, np.zeros((0, dim + 1)))
    x = index.raised(sample)
    different = np.unique(x, axis=0)
    index.centres = different[rng.permutation(len(different))[:lists]]
    for _ in range(rounds):
        near = index.nearest(x)
        n = np.bincount(near, minlength=len(index.centres))
        total = np.zeros_like(index.centres)
        np.add.at(total, near, x)
        index.centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], index.centres)
    return index


def true_nearest(placed: DataFrame, queries: list, k: int) -> list:
    """query, list: where the ``k`` nearest of each of some vectors (vec_id, v) lie, by comparison with the whole table."""
    ids, q = np.array([r["vec_id"] for r in queries], np.int64), np.array([r["v"] for r in queries], np.float64)

    def best(batches):
        lists, scores = np.zeros((len(q), 0), np.int32), np.zeros((len(q), 0))
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, q.shape[1])
            score = q @ v.T
            score[ids[:, None] == np.asarray(batch.column(0))[None, :]] = -np.inf
            scores = np.concatenate([scores, score], 1)
            lists = np.concatenate([lists, np.broadcast_to(np.asarray(batch.column(2), np.int32), score.shape)], 1)
            if scores.shape[1] > k:
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, lists = np.take_along_axis(scores, top, 1), np.take_along_axis(lists, top, 1)
        query, at = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(lists[query, at]), pa.array(scores[query, at])], ["query", "list", "score"])

    found = placed.select("vec_id", "v", "list").mapInArrow(best, "query int, list int, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "list"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "list").collect()  # k rows for each query


def probes_for(index: Index, queries: list, near: list, recall: float) -> int:
    """How many lists to probe so that this share of the nearest (of ``true_nearest``) lies in them; without any, all."""
    if not near:
        return len(index.centres)
    order = np.argsort(index.distances(index.asked(np.array([r["v"] for r in queries], np.float64))), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    needed = np.sort(place[[r["query"] for r in near], [r["list"] for r in near]])
    return int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def column_blocks(x: np.ndarray) -> list[np.ndarray]:
    """Vectors as blocks of ``COLUMNS`` coordinates, each contiguous."""
    return [np.ascontiguousarray(x[:, d : d + COLUMNS]) for d in range(0, x.shape[1], COLUMNS)]


def scan(x: list[np.ndarray], q: np.ndarray, k: int, epsilon: float = 2.1, block: int = 256) -> np.ndarray:
    """Places in ``x`` of the candidates that may be among the ``k`` nearest to ``q``; ties at the limit stay."""
    n, dim, limit = len(x[0]), len(q), np.inf
    kept, near = np.zeros(0, np.int64), np.zeros(0)
    for lo, hi in [(0, min(block, n))] + [(a, min(n, a + 8 * block)) for a in range(block, n, 8 * block)]:
        at, part, seen = None, np.zeros(hi - lo), 0
        for own in x:
            some = own[lo:hi] if at is None else own.take(at, axis=0)
            gap = some - q[seen : seen + own.shape[1]]
            part = part + np.einsum("ij,ij->i", gap, gap)
            seen += own.shape[1]
            slack = 1 + 1e-6 if seen == dim else (1 + epsilon / np.sqrt(seen)) ** 2
            stay = np.flatnonzero(part <= limit * (seen / dim) * slack + 1e-9)
            if len(stay) < len(part):
                at, part = stay + lo if at is None else at[stay], part[stay]
                if not len(at):
                    break
        if len(part):
            kept, near = np.concatenate([kept, np.arange(lo, hi) if at is None else at]), np.concatenate([near, part])
            if len(near) > k:
                limit = np.partition(near, k - 1)[k - 1]
                stay = near <= limit * (1 + 1e-6) + 1e-9
                kept, near = kept[stay], near[stay]
    return kept


def _partial(best_of: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A task's best candidates by query."""
    queries = np.repeat(list(best_of), [len(b[0]) for b in best_of.values()])
    ids, scores = (np.concatenate([b[i] for b in best_of.values()]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that take part, each row once.

    Null ids, null vectors, vectors without length and those that hold null or non-finite components take
    no part, nor those whose number of components is not the most frequent (ties: the larger).
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)").dropDuplicates(["vec_id", "v"])
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.95, sample: int = 20_000, chunk: int = 4096, per_list: int = 800, most_queries: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose vec_id is divisible by ``every``.

    A query probes as many of the nearest lists as hold this share of the true nearest of about 200 vectors, which
    are held out from the fit of the lists and compared with the whole table, and more until they hold ten times ``k`` vectors. Lists hold about ``per_list`` vectors, up to 16,384 lists, and are
    searched in chunks of vectors and of queries, so a list with a third of all vectors is many tasks. Ties go to the smaller vec_id. The index is fitted on a sample of
    about ``sample`` vectors, at least 16 for each list; every vector is indexed. Rows equal in all are one; an empty table gives an
    empty one; further columns are not read.
    """
    spark = vectors.sparkSession
    own = shared.written(usable(vectors), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    about = own.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("m")).first()
    if not about["n"]:
        return spark.createDataFrame([], schema)
    lists = int(min(16_384, max(1, about["n"] // per_list)))
    chance = lambda seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    asks = chance(5) < min(200 / about["n"], 0.25)
    held_out = sorted(own.where(asks).select("vec_id", "v").collect())  # about 200 rows
    table = own.where(~asks & (chance(3) < max(sample, 16 * lists) / about["n"])).select("vec_id", "v").toArrow()  # bounded by the lists
    if not table.num_rows:
        table = own.select("vec_id", "v").limit(1).toArrow()
    points = table.column(1).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    points = points[np.lexsort([*points.T[::-1], table.column(0).to_numpy()])]
    del table
    index = fit(points, float(about["m"]) ** 0.5, lists)
    lists = len(index.centres)
    sent = spark.sparkContext.broadcast(index)  # bounded: at most 16384 centres

    def assign(batches):
        index = sent.value
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, index.dim)
            near = index.nearest(index.raised(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    placed = shared.written(own.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int"), "placed")
    n_probes = probes_for(index, held_out, true_nearest(placed, held_out, k) if held_out else [], recall)
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        held[r["list"]] = r["n"]
    parts = np.maximum(1, -(-held // chunk))
    counts = spark.sparkContext.broadcast(held)

    def probe(batches):
        index, held = sent.value, counts.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                q = np.asarray(some.column(1).flatten(), np.float64).reshape(-1, index.dim)
                order = np.argsort(index.distances(index.asked(q)), axis=1, kind="stable")
                total = np.cumsum(held[order], axis=1)
                n = np.maximum(n_probes, (total < 10 * k).sum(1) + 1)
                chosen = (np.arange(order.shape[1]) < n[:, None]) & (held[order] > 0)
                take, at = np.nonzero(chosen)
                picked = some.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(order[take, at].astype(np.int32)), picked.column(0), picked.column(1)], ["list", "vec_id", "v"])

    queries = own.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").mapInArrow(probe, "list int, vec_id long, v array<double>")
    queries = shared.written(queries, "probes")
    asked = np.zeros(lists, np.int64)
    for r in queries.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row for each list
        asked[r["list"]] = r["n"]
    shares = np.maximum(1, -(-asked // chunk))
    of_list = lambda n: F.lit(n.tolist())[F.col("list")]
    dealt_to = lambda n: F.pmod(F.xxhash64("vec_id"), of_list(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), (of_list(n) - 1).cast("int")))
    # A list's vectors in parts and its queries in shares: each share meets each part in a cell.
    data = placed.where(of_list(asked) > 0).select("list", dealt_to(parts).alias("part"), every_one(shares).alias("share"), F.lit(0).alias("kind"), "vec_id", "v")
    both = data.unionByName(queries.select("list", every_one(parts).alias("part"), dealt_to(shares).alias("share"), F.lit(1).alias("kind"), "vec_id", "v"))
    dealt = both.repartition("list", "part", "share").sortWithinPartitions("list", "part", "share", "kind", "vec_id")

    def nearest(batches):
        index, cell = sent.value, None
        ids, raw, x = [], [], None
        best_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # merged over the task's cells, flushed when large
        for batch in batches:
            v = np.asarray(batch.column(5).flatten(), np.float64).reshape(-1, index.dim)
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            kind, vec = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            asked = index.asked(v) if any(kind) else None
            for i, key in enumerate(keys):
                if key != cell:
                    cell, ids, raw, x = key, [], [], None
                if kind[i] == 0:
                    ids.append(vec[i])
                    raw.append(v[i])
                    continue
                if x is None:
                    if not ids:
                        continue
                    id_array, raw_array = np.array(ids, np.int64), np.array(raw)
                    x = column_blocks(index.raised(raw_array))
                some = scan(x, asked[i], k + 1)
                some = some[id_array[some] != vec[i]]
                score = (raw_array[some] * v[i]).sum(1)
                found, own = id_array[some], best_of.get(vec[i])
                if own is not None:
                    found, score = np.concatenate([own[0], found]), np.concatenate([own[1], score])
                best = np.lexsort((found, -score))[:k]
                best_of[vec[i]] = found[best], score[best]
                if len(best_of) >= most_queries:
                    yield _partial(best_of)
                    best_of = {}
        if best_of:
            yield _partial(best_of)

    found = dealt.mapInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
