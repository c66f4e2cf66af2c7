"""Near-duplicates by circulant MinHash.

Two permutations of a fixed range make all coordinates of a signature: the first scatters a shingle, and
the second, shifted circularly by k places, gives the k-th coordinate, so a shingle's coordinates are one
contiguous stretch of a table. Bands of coordinates find candidates, and every link is confirmed on the
full shingle sets.

Documents with equal sets are one class with one representative. In a band's bucket each representative
is compared with the smallest, and the links found make components. A bucket that still holds several of
them is searched once more: those outside its most frequent component go past all others, in blocks, as
counts of their shingles by residue. These bound the intersection of two sets from above, so only pairs that
may be links go on to be confirmed. So no link between candidates is lost, and no text is sent for a pair
that its counts rule out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared, words
from almucantar.llm.components import components

BITS = 21
#: Classes of shingles that are counted for the bound on an intersection.
CLASSES = 128
#: Text bytes that are hashed at once.
BATCH = 1 << 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
shared.held_by("minhash", _TABLES.clear)


def _tables(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    if coordinates not in _TABLES:
        rng = np.random.default_rng(7)
        scatter = rng.permutation(1 << BITS).astype(np.uint32)
        circle = rng.permutation(1 << BITS).astype(np.uint32)
        _TABLES[coordinates] = scatter, sliding_window_view(np.concatenate([circle, circle[: coordinates - 1]]), coordinates)
    return _TABLES[coordinates]


def signature(shingle_set: np.ndarray, coordinates: int) -> np.ndarray:
    """The least value of each coordinate over a set that is not empty."""
    scatter, circle = _tables(coordinates)
    at = scatter[(words.mix(shingle_set) >> np.uint64(64 - BITS)).astype(np.int64)]
    parts = [circle[at[i : i + 2048]].min(0) for i in range(0, len(at), 2048)]
    return parts[0] if len(parts) == 1 else np.min(parts, 0)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the same values in another band give another key."""
    bands = sig.reshape(-1, rows).astype(np.uint64)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        out = words.mix(out + bands[:, k] * np.uint64(0x9FB21C651E98DF25))
    return out


def class_counts(shingle_set: np.ndarray) -> bytes:
    """How many shingles of a set are in each class, two bytes each; empty if one has more than these hold."""
    n = np.bincount((shingle_set & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return n.astype("<u2").tobytes() if n.max() < 1 << 16 else b""


def text_key(text: str):
    """128 bits by which equal texts are found again. Null texts count as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def described(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (digest of the set; null: empty), bands and class counts for each document."""
    shared.small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("counts", pa.binary())])

    def run(batches):
        shared.begin("minhash")
        for batch in shared.text_batches(batches, BATCH):
            sets = words.shingle_sets(batch.column(2), shingle)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            at = [band_keys(signature(s, bands * rows), rows).view(np.int64) if len(s) else None for s in sets]
            counts = [class_counts(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.list_(pa.int64())), pa.array(counts, pa.binary())], schema=schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>, counts binary")


def confirmed(edges: DataFrame, texts: DataFrame, shingle: int, per_cent: int, most: int = 500) -> DataFrame:
    """The edges (a, b) whose full sets, of ``texts`` (rep, text), have 100 * intersection >= per_cent * union.

    A leader's text goes to its members' tasks, ``most`` members in each, and never all pairs are made.
    """
    texts = texts.select(F.col("rep").alias("_id"), F.col("text").alias("_text")).hint("merge")
    salts = edges.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {most}) as int)").alias("_salts"))
    members = edges.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_salts").cast("int").alias("_salt"))
    members = members.join(texts, F.col("b") == F.col("_id")).select("a", "b", "_salt", "_text")
    leaders = salts.join(texts, F.col("a") == F.col("_id")).select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_text")
    grouped = members.unionByName(leaders).repartition("a", "_salt").sortWithinPartitions("a", "_salt", "b")

    def run(batches):
        shared.begin("minhash")
        leader, own = None, []
        for part in shared.text_batches(batches, BATCH):
            found = []
            sets = words.shingle_sets(part.column(2), shingle)
            for a, b, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sets, strict=True):
                if b is None:
                    own = [*own, s] if leader == a else [s]
                    leader = a
                    continue
                for o in own:
                    at = np.minimum(np.searchsorted(o, s), len(o) - 1)
                    both = int((o[at] == s).sum())
                    if both and 100 * both >= per_cent * (len(o) + len(s) - both):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return grouped.select("a", "b", "_text").mapInArrow(run, "a long, b long").distinct()


def across(hot: DataFrame, label: DataFrame, traits: DataFrame, per_cent: int, most: int = 500) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose class counts allow a link.

    ``hot`` (key, rep) are the buckets, ``label`` (node, component), ``traits`` (rep, n_shingles, bands, counts).
    Members of a bucket are dealt to blocks of about ``most``, and those outside its most frequent component to
    as many of their own; each block of these meets each block of members in a cell. A pair is looked at in the
    first band that it shares.
    """
    labelled = hot.join(label, hot["rep"] == label["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    total = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", F.negative("label"))).alias("main"), F.max("n").alias("largest"), F.count("*").alias("labels"), F.sum("n").alias("n"))
    mixed = total.where("labels > 1 and n > 2").select("key", "main", F.expr(f"cast(ceil(n / {most}) as int)").alias("blocks"), F.expr(f"cast(ceil((n - largest) / {most}) as int)").alias("others"))
    rows = labelled.join(mixed, "key")
    dealt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("key", dealt("blocks", 1).alias("block"), every("others").alias("other"), F.lit(0).alias("role"), "rep", "label")
    outside = rows.where("label != main").select("key", every("blocks").alias("block"), dealt("others", 2).alias("other"), F.lit(1).alias("role"), "rep", "label")
    cells = members.unionByName(outside).join(traits.hint("merge"), "rep").repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "role", "rep")

    def run(batches):
        cell, group = None, _Group()
        for batch in batches:
            bands = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            found = []
            for i, (key, block, other, role, rep, own, size, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5, 6, 8)), strict=True)):
                if (key, block, other) != cell:
                    cell, group = (key, block, other), _Group()
                if role == 0:
                    group.add(rep, own, size, counts, bands[i])
                else:
                    found += [(rep, b) for b in group.near(key, rep, own, size, counts, bands[i], per_cent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return cells.select("key", "block", "other", "role", "rep", "label", "n_shingles", "bands", "counts").mapInArrow(run, "a long, b long").distinct()


class _Group:
    """The members of a cell."""

    def __init__(self):
        self.rows, self.ready = [], False

    def add(self, rep: int, label: int, size: int, counts: bytes, bands: np.ndarray) -> None:
        self.rows.append((rep, label, size, counts, bands))

    def near(self, key: int, rep: int, label: int, size: int, counts: bytes, bands: np.ndarray, per_cent: int) -> list[int]:
        """Members of other labels whose sets may be close enough to a set."""
        if not self.rows:
            return []
        if not self.ready:
            self.rep, self.label, self.size = (np.array([r[k] for r in self.rows], np.int64) for k in (0, 1, 2))
            self.bands = np.stack([r[4] for r in self.rows])
            self.known = np.array([len(r[3]) > 0 for r in self.rows])
            self.counts = np.stack([np.frombuffer(r[3], "<u2") if r[3] else np.zeros(CLASSES, "<u2") for r in self.rows])
            self.ready = True
        same = self.bands == bands
        here = (self.label != label) & (self.rep != rep) & (same.any(1)) & (bands[same.argmax(1)] == key)
        here &= 100 * np.minimum(self.size, size) >= per_cent * np.maximum(self.size, size)
        at = np.flatnonzero(here)
        if counts and len(at):
            most = np.minimum(self.counts[at], np.frombuffer(counts, "<u2")).sum(1, dtype=np.int64)  # no intersection is larger
            at = at[~self.known[at] | ((100 + per_cent) * most >= per_cent * (self.size[at] + size))]
        return self.rep[at].tolist()


def _grouped(docs: DataFrame, shingle: int, per_cent: int, bands: int, rows: int, id_col: str, text_col: str, most: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, rep (the smallest id of an equal set) and component of each row of ``docs``."""
    own = shared.written(described(docs, shingle, bands, rows, id_col, text_col), "described")
    classes = own.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = shared.written(classes, "classes")
    reps = own.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    banded = shared.written(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key")).distinct(), "bands")
    heads = banded.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    hot = shared.written(banded.join(heads, "key").select("key", "rep", "a"), "buckets")
    shared.drop(banded)
    narrow = docs.select(F.col(id_col).cast("long").alias("rep"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    some = reps.withColumnRenamed("doc_id", "rep").join(hot.select("rep").distinct(), "rep").dropDuplicates(["rep", "set_key"])
    some = shared.written(some.select("rep", "text_key", "n_shingles", "bands", "counts"), "traits")
    # Texts are joined by a shuffle at every size: how many candidates there are follows the documents.
    one = narrow.hint("merge").join(some.select("rep", "text_key"), ["rep", "text_key"]).dropDuplicates(["rep", "text_key"])
    texts = shared.written(one.select("rep", "text"), "candidates")
    found = shared.written(confirmed(hot.where("rep != a").select("a", F.col("rep").alias("b")).distinct(), texts, shingle, per_cent), "confirmed")
    label = shared.written(components(found), "labels")
    pairs = shared.written(across(hot, label, some, per_cent, most), "across")
    if not pairs.isEmpty():
        more = shared.written(confirmed(pairs, texts, shingle, per_cent), "confirmed-across")
        older, label = label, shared.written(components(found.unionByName(more)), "labels")
        shared.drop(older, more)
    shared.drop(hot, some, texts, found, pairs)
    of_class = classes.where("rep is not null").select("set_key", "rep")
    of_class = of_class.join(label, of_class["rep"] == label["node"], "left").select("set_key", "rep", F.coalesce("component", "rep").alias("component"))
    return own.select("doc_id", "text_key", "n_shingles", "set_key").join(of_class, "set_key", "left")


def near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text", most: int = 500) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Null or empty texts have no shingles, no links and are kept. Rows that share a doc_id are one node. A
    row without an id takes its component from rows with an equal set that have one, and is kept only if
    there is none. Texts of any length are whole sets. An empty table gives an empty one; further columns,
    whatever their names, are not read.
    """
    out = _grouped(docs, shingle, per_cent, bands, rows, id_col, text_col, most)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, per_cent: int = 80, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text", most: int = 500) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``, with all its columns, whatever their names.

    It is a row with the smallest doc_id of the group; of several rows with that id, one with the smallest text
    key, and of equal ones the least in all columns. A row whose text has no shingles stays. Of rows without an
    id, one of each set stays if no row with an id has that set. An empty table gives an empty one.
    """
    own = _grouped(docs, shingle, per_cent, bands, rows, id_col, text_col, most)
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("set_key")).alias("set_key"))
    stays = own.where("set_key is not null and doc_id <=> component").groupBy(group.alias("g")).agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    of_key = own.where("set_key is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    stays = stays.select("k.doc_id", "k.text_key").join(of_key.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("doc_id", "text_key", "n")
    empty = own.where("set_key is null").select("doc_id", "text_key").distinct().withColumn("n", F.lit(0).cast("long"))
    d, t, n, i, k = shared.fresh(docs, "d", "t", "n", "i", "k")
    decided = stays.unionByName(empty).select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("n").alias(n))
    keyed = docs.withColumns({i: F.col(f"`{id_col}`").cast("long"), k: text_key(text_col)})
    kept = keyed.join(decided, F.col(i).eqNullSafe(F.col(d)) & (F.col(k) == F.col(t)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ordered = [F.col(f"`{c}`") for c, kind in docs.dtypes if not re.search(r"\b(map|variant)\b", kind)]  # kinds that Spark can compare
    several = kept.where(F.col(n) > 1).groupBy(i, k).agg(F.min_by(F.struct(*columns), F.struct(*ordered)).alias(n)).select(f"{n}.*")
    return kept.where(F.col(n) <= 1).select(*columns).unionByName(several)
