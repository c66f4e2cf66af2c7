"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at a mask's chosen places, so words that were exchanged at the places
the mask ignores do not hide an overlap. The seeds of documents that a Bloom filter of the test items'
seeds lets through are joined with these; each pair of document and item that shares a seed is then
compared word by word on the diagonals of its hits, and an overlap counts if enough words are equal.

Equal texts are one class from the first shuffle on, so a group of copies costs as much as one of them, and
seeds that very many texts share are dealt over several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almucantar.llm import shared, words

#: The masks by the fewest words of an item that uses them; 1 is a place that counts. Every stretch of
#: that many words and more of which 80 % are equal has a place where all that some mask counts are equal. It is
#: enough that this holds below twice as many words: of a longer stretch's two halves one has 80 % equal itself.
#: Of fewer than five words 80 % are all.
MASKS = {
    13: ("1111011", "110100010011", "110101011", "1110111"),
    10: ("1110111", "111001011", "1011111", "11111001", "1100101011"),
    8: ("1111011", "1101111", "111111"),
    5: ("1111", "11011", "11101", "10111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}
#: Bits of the Bloom filter for each seed, at most and at least in all, and how many are set for one.
BITS_PER_SEED, LEAST_BITS, MOST_BITS, PROBES = 24, 16, 27, 4
#: Seeds that are dealt over several tasks are broadcast up to this many, and beyond it joined by a shuffle.
MOST_HOT = 1 << 20
#: Text bytes whose words are hashed at once.
BATCH = 1 << 20
_PLACE = words.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def seeds(hashes: np.ndarray, span: int) -> list[np.ndarray]:
    """For each mask of a span the seed from every word on that it has words for."""
    out = []
    for k, mask in enumerate(MASKS[span]):
        n = len(hashes) - len(mask) + 1
        total = np.full(max(0, n), 64 * span + k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1" and n > 0:
                total += hashes[i : i + n] * _PLACE[i]
        out.append(words.mix(total))
    return out


def span_of(n_words: int) -> int:
    """The masks that an item of so many words uses; 0 without words."""
    return max((s for s in MASKS if s <= n_words), default=0)


def bit_places(values: np.ndarray, bits: int) -> np.ndarray:
    """The places of a Bloom filter of 2**bits bits that a seed sets, a row for each."""
    a, b = values >> np.uint64(64 - bits), words.mix(values) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) & np.uint64((1 << bits) - 1) for k in range(PROBES)])


class Filter:
    """A Bloom filter: 64-bit words, and which spans have seeds at all."""

    def __init__(self, bits: int, spans: list[int], places: list[int], values: list[int]):
        self.bits, self.spans = bits, spans
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[places] = np.array(values, np.int64).view(np.uint64)

    def has(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that may be in it."""
        at = np.arange(len(values))
        for k in range(PROBES):
            place = bit_places(values[at], self.bits)[k] if k else values >> np.uint64(64 - self.bits)
            at = at[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            if not len(at):
                break
        return at


def overlap(equal: np.ndarray, need: int, per_cent: int) -> tuple[int, int] | None:
    """The longest stretch of at least ``need`` words of which ``per_cent`` are equal, the first of such; in linear memory.

    With each equal word worth what is missing from 100 and each other one less ``per_cent``, it is the longest
    stretch whose sum is not negative: from the first place whose sum so far is not above that at its end.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - per_cent, -per_cent))])
    least = np.minimum.accumulate(sums)  # never rises
    first = np.searchsorted(-least, -sums, "left")
    size = np.arange(len(sums)) - first
    end = int(size.argmax())
    return (int(first[end]), end) if size[end] >= max(1, need) else None


def best_overlap(text: np.ndarray, item: np.ndarray, shifts: list[int], per_cent: int, least: int) -> tuple[int, int, int] | None:
    """First word in the text, length and equal words of the overlap with the most equal words, then the longest, then the first."""
    best = None
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        equal = item[lo:hi] == text[lo + shift : hi + shift]
        stretch = overlap(equal, min(least, len(item)), per_cent)
        if stretch:
            start, end = stretch
            found = (int(equal[start:end].sum()), end - start, -(lo + shift + start))
            best = found if best is None or found > best else best
    return best and (-best[2], best[1], best[0])


def _keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """key (128 bits of the text) and text of the rows that have one."""
    text = F.col(f"`{text_col}`").cast("string")
    return rows.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).where("text is not null")


def item_seeds(items: DataFrame) -> DataFrame:
    """seed, span, item (its text's key) and first (the word that the seed begins at) of different test items."""

    def run(batches):
        for part in shared.text_batches(batches, BATCH):
            hashes, bounds = words.word_hashes(part.column(1))
            out = []
            for key, a, b in zip(part.column(0).to_pylist(), bounds[:-1], bounds[1:], strict=True):
                span = span_of(int(b - a))
                for own in seeds(hashes[a:b], span) if span else []:
                    out.append((own.view(np.int64), np.full(len(own), span, np.int32), pa.array([key] * len(own), pa.binary()), np.arange(len(own))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.concat_arrays([o[2] for o in out]), pa.array(np.concatenate([o[3] for o in out]))], ["seed", "span", "item", "first"])

    return _keyed(items, "text").dropDuplicates(["key"]).mapInArrow(run, "seed long, span int, item binary, first long")


def bloom(of_items: DataFrame, n: int) -> Filter:
    """A filter of all seeds, put together in parts: the driver gets its words that are not 0, 16 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(BITS_PER_SEED * max(1, n)))))

    def run(batches):
        own = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            places = bit_places(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            np.bitwise_or.at(own, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(own[at].view(np.int64))], ["place", "value"])

    rows = of_items.select("seed").mapInArrow(run, "place long, value long").groupBy("place").agg(F.bit_or("value").alias("value")).collect()
    spans = sorted(r["span"] for r in of_items.select("span").distinct().collect())
    return Filter(bits, spans, [r["place"] for r in rows], [r["value"] for r in rows])


def overlapping(docs: DataFrame, items: DataFrame, per_cent: int, least: int, text_col: str, most: int) -> DataFrame:
    """key, item (keys of texts), first_word, n_words, n_equal of each pair of different texts that overlaps."""
    spark = docs.sparkSession
    if not 80 <= per_cent <= 100:
        raise ValueError("the masks find overlaps of which 80 to 100 per cent are equal")
    shared.small_arrow_batches(spark)
    of_items = shared.written(item_seeds(items), "item-seeds")
    n = of_items.count()
    sent = spark.sparkContext.broadcast(bloom(of_items, n))  # 16 MB at most, however many items there are

    def look_up(batches):
        shared.begin("decontaminate")
        known = sent.value
        for part in shared.text_batches(batches, BATCH):
            hashes, bounds = words.word_hashes(part.column(1))
            seed, text, first = [], [], []
            for span in known.spans:
                for mask, own in zip(MASKS[span], seeds(hashes, span), strict=True):
                    at = known.has(own)
                    of = np.searchsorted(bounds, at, "right") - 1
                    whole = at + len(mask) <= bounds[of + 1]  # a mask does not reach into the next text
                    seed.append(own[at][whole].view(np.int64))
                    text.append(of[whole])
                    first.append((at - bounds[of])[whole])
            if sum(map(len, seed)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed)), part.column(0).take(pa.array(np.concatenate(text))), pa.array(np.concatenate(first).astype(np.int64))], ["seed", "key", "at"])

    texts = _keyed(docs, text_col)
    hits = shared.written(texts.mapInArrow(look_up, "seed long, key binary, at long").distinct(), "hits")
    # A seed that very many texts share is dealt over as many tasks as it needs, and the items' rows with it.
    hot = hits.groupBy("seed").agg(F.expr(f"cast(ceil(count(*) / {most}) as int)").alias("salts")).where("salts > 1")
    hot = hot_at = shared.written(hot, "hot-seeds")
    if hot.count() <= MOST_HOT:
        hot = F.broadcast(hot)  # 16 MB at most
    one = F.coalesce("salts", F.lit(1))
    left = hits.join(hot, "seed", "left").select("seed", F.pmod(F.xxhash64("key"), one).cast("int").alias("salt"), "key", "at")
    right = of_items.join(hot, "seed", "left").select("seed", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"), "item", "first")
    pairs = left.join(right.hint("merge"), ["seed", "salt"]).select("key", "item", (F.col("at") - F.col("first")).alias("shift"))
    pairs = shared.written(pairs.groupBy("key", "item").agg(F.sort_array(F.collect_set("shift")).alias("shifts")), "pairs")
    # A text goes to its candidates' task once; the items, which are short, go with the pairs.
    of_text = texts.join(pairs.select("key"), "key", "left_semi").dropDuplicates(["key"])
    of_text = of_text.select("key", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("item"), "text", F.lit(None).cast("array<long>").alias("shifts"))
    of_item = _keyed(items, "text").dropDuplicates(["key"]).withColumnRenamed("key", "item")
    of_pair = pairs.join(of_item, "item").select("key", F.lit(1).alias("kind"), "item", "text", "shifts")
    dealt = of_text.unionByName(of_pair).repartition("key").sortWithinPartitions("key", "kind", "item")

    def compare(batches):
        own, own_words = None, None
        for part in shared.text_batches(batches, BATCH):
            hashes, bounds = words.word_hashes(part.column(3))
            out = []
            for i, (key, kind, item, shifts) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                some = hashes[bounds[i] : bounds[i + 1]]
                if kind == 0:
                    own, own_words = key, some.copy()
                    continue
                found = best_overlap(own_words, some, shifts, per_cent, least) if key == own else None
                if found:
                    out.append((key, item, *found))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k < 2 else pa.int64()) for k, c in enumerate(columns)], ["key", "item", "first_word", "n_words", "n_equal"])

    found = dealt.mapInArrow(compare, "key binary, item binary, first_word long, n_words long, n_equal long")
    found = shared.written(found, "overlaps")
    shared.drop(of_items, hits, hot_at, pairs)
    return found


def contaminated(docs: DataFrame, items: DataFrame, per_cent: int = 80, least: int = 13, text_col: str = "text", most: int = 20_000) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: the best overlap of each document with each test item.

    An overlap has at least ``least`` words (or the item's, if fewer), ``per_cent`` of them equal after
    lower-casing A-Z; so items of fewer than five words must stand in the text as they are. Null texts and
    those without words overlap with nothing, and null item ids are left out; null doc_ids stay null. Rows that
    repeat a doc_id are compared one by one; equal items are found each. Texts and items of any length are
    compared as a whole, in memory linear in the longer one. Empty tables give an empty one; further columns,
    whatever their names, are not read. ``most`` rows of one seed go to a task.
    """
    found = overlapping(docs, items.where("item_id is not null"), per_cent, least, text_col, most)
    key = F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")))
    of_doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    of_item = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("item"))
    return of_doc.join(found, "key").join(of_item, "item").select("doc_id", "item_id", "first_word", "n_words", "n_equal")


def clean(docs: DataFrame, items: DataFrame, per_cent: int = 80, least: int = 13, text_col: str = "text", most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that overlap with no test item, with all their columns, whatever their names.

    Null texts and those without words stay; rows with equal texts stay or go together; an empty table gives an
    empty one; without items all rows stay. Overlaps are as for ``contaminated``.
    """
    found = overlapping(docs, items, per_cent, least, text_col, most).select("key")
    (own,) = shared.fresh(docs, "key")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary"))))
    return keyed.join(found.withColumnRenamed("key", own), own, "left_anti").drop(own)
