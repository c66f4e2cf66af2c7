"""Places where an operator did less than it promises."""

import itertools

import numpy as np
import pyarrow as pa

from pyarrow import fs as _  # noqa: F401
from pyspark.sql import functions as F

from almucantar.llm import decontaminate, minhash, nearest, shared, substrings, words


def substituted(size):
    """All ways to exchange as many of ``size`` words as leave 80 % equal; fewer leave more seeds."""
    n = size - -(-80 * size // 100)
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(size), n)])


def test_masks_cover_every_pattern():
    least = sorted(decontaminate.MASKS)
    for span, following in zip(least, [*least[1:], 26], strict=True):
        for size in range(span, following):  # from 26 words on, one of the two halves has 80 % equal
            left = substituted(size)
            for mask in decontaminate.MASKS[span]:
                bits = sum(1 << i for i, c in enumerate(mask) if c == "1")
                for at in range(size - len(mask) + 1):
                    left = left[left & (bits << at) != 0]
            assert not len(left), (span, size)


def found_in(doc, item):
    """The best overlap by the item's seeds, as in a join of both."""
    a, b = (words.word_hashes(pa.array([x]))[0] for x in (doc, item))
    shifts = set()
    for x, y in zip(*(decontaminate.seeds(h, decontaminate.span_of(len(b))) for h in (a, b)), strict=True):
        places = {}
        for i, v in enumerate(y.tolist()):
            places.setdefault(v, []).append(i)
        shifts |= {i - j for i, v in enumerate(x.tolist()) for j in places.get(v, ())}
    return decontaminate.best_overlap(a, b, sorted(shifts), 80, 13)


def test_substituted_items_are_found():
    for size in [*range(1, 17), 20]:
        text = [f"w{i}" for i in range(size)]
        left = substituted(size).tolist()
        for m in left[:: max(1, len(left) // 300)]:
            doc = "before " + " ".join("x" if m >> i & 1 else w for i, w in enumerate(text)) + " after"
            assert found_in(doc, " ".join(text)), (size, m)
    for size in range(13, 80, 3):
        for period in (5, 6, 7):
            text = [f"w{i}" for i in range(size)]
            for first in range(1, period):
                doc = ["x" if i % period == first else w for i, w in enumerate(text)]
                equal = sum(a == b for a, b in zip(doc, text, strict=True))
                assert found_in(" ".join(doc), " ".join(text)) or 100 * equal < 80 * size, (size, period, first)


def test_nearest_recall_with_many_lists(spark):
    x = np.random.default_rng(8).normal(size=(6000, 32))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    hit = 0
    for r in nearest.search(vectors, per_list=20, sample=600).groupBy("query_id").agg({"vec_id": "collect_list"}).collect():
        score = x @ x[r[0]]
        score[r[0]] = -np.inf
        hit += len(set(r[1]) & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.9 * 20 * 300, hit / 6000


def test_pairs_that_share_one_band_are_looked_at():
    group, own = minhash._Group(), np.arange(20, dtype=np.uint64)
    group.add(1, 1, 19, minhash.class_counts(own[:19]), np.array([5, 6, 7]))
    group.add(3, 1, 20, minhash.class_counts(own + np.uint64(20)), np.array([5, 6, 7]))
    group.add(4, 1, 20, b"", np.array([5, 6, 7]))
    assert group.near(5, 2, 2, 20, minhash.class_counts(own), np.array([5, 8, 9]), 80) == [1, 4]


def test_mixed_buckets_in_small_cells(spark):
    """Buckets whose smallest member is unlike the others, so that links are only found across components."""
    rng = np.random.default_rng(4)
    family = [f"w{i}" for i in range(400)]
    texts = [" ".join(family[:150])]
    for _ in range(24):
        texts.append(" ".join(w if rng.random() > 0.012 else f"n{rng.integers(10**6)}" for w in family))
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(words.shingle_sets(pa.array([t]), 3)[0].tolist()) for t in texts]
    links = {(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    parent = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, shingle=3, per_cent=85, bands=200, rows=1, most=3).collect()}
    assert [got[i] for i in range(len(texts))] == parent


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g h i j", 1), (3, "a b c d e f g h i j", 2), (5, "quite another text it is", 3), (5, "quite another text it is", 2), (7, None, 1), (7, None, 1), (8, "", 4), (None, "quite another text it is", 5), (None, "alone here", 6), (None, "alone here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d0 int").withColumn("K", F.create_map(F.lit("a"), F.col("_d0")))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["_d0"]) for r in kept.collect()), key=str) == sorted([(3, rows[1][1], 2), (5, rows[2][1], 2), (7, None, 1), (7, None, 1), (8, "", 4), (None, "alone here", 6)], key=str)
    assert minhash.keep_one(docs.limit(0)).count() == 0


def test_groups_of_one_anchor_in_several_arrays(spark, monkeypatch):
    """A line in all documents with other surroundings each time; and the same with its grams taken for common."""
    rng = np.random.default_rng(6)
    line = "this is the one line that every document of the corpus has in its midst"
    rows = [(i, "".join(rng.choice(list("abcdefgh"), 40)) + line + "".join(rng.choice(list("abc"), 3)) + str(i % 7) * 30) for i in range(120)]
    data = [t.encode() for _, t in rows]
    at = np.cumsum([0] + [len(b) for b in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    known = substrings.grams(np.frombuffer(line.encode(), np.uint8))
    first = {}
    for i, b in enumerate(data):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    monkeypatch.setattr(substrings, "ARRAY_BYTES", 2000)
    for common in (substrings.NONE, substrings.Common(known)):
        h, sid, begin, last, anchor = substrings.stretches(raw, at, 50, common)
        assert (last - begin + 1).sum() == sum(len(b) - 49 for b in data)
        doc, size = np.searchsorted(at, begin, "right") - 1, last - begin + 50
        text = np.concatenate([raw[f : f + n] for f, n in zip(begin, size, strict=True)])
        places = np.cumsum(size) - size
        where = np.cumsum(size - 49) - (size - 49)
        for least in (substrings.shared_strings(h, doc, size, anchor - begin, places, text, 50), np.repeat(doc, size - 49)):
            if (least == np.repeat(doc, size - 49)).all():  # all of them as one group
                substrings._by_arrays(np.arange(len(h)), size, places, text, where, least, 50)
            for i in range(len(h)):
                for o in range(size[i] - 49):
                    assert least[where[i] + o] == first[raw[begin[i] + o : begin[i] + o + 50].tobytes()]
    per_anchor = [np.unique(substrings.stretches(raw, at, 50, c)[0], return_counts=True)[1].max() for c in (substrings.NONE, substrings.Common(known))]
    assert per_anchor[0] >= 120


def test_places_need_both_hashes():
    sid, h = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    k, there = substrings._places(sid, h, np.array([5, 5, 5, 9, 9, 7], np.uint64), np.array([4, 1, 8, 3, 1, 1], np.uint64))
    assert there.tolist() == [True, True, False, True, False, False] and k[[0, 1, 3]].tolist() == [3, 0, 2]


def test_pipeline_goes_on_where_it_broke_off(spark, monkeypatch):
    import corpus_pipeline

    sf, folder, ran = "/root/testdata/sf0.001", shared.new_dir(spark, "broken"), []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if fails:
                raise RuntimeError(name)
            return docs.where("doc_id % 3 != 0") if name == "a" else docs

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", True)])
    for _ in range(2):
        try:
            corpus_pipeline.run(spark, sf, folder)
        except RuntimeError:
            pass
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    out = corpus_pipeline.run(spark, sf, folder)
    assert ran == ["a", "b", "c", "c", "c"] and out.count() == spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 != 0").count()


def test_publish_and_sweep(spark):
    folder = shared.make_dir(shared.new_dir(spark, "published"))
    fs, base = shared.filesystem(folder)
    for attempt in range(2):
        with fs.open_output_stream(f"{base}/.{attempt}.tmp") as out:
            out.write(b"same")
        shared.publish(fs, f"{base}/.{attempt}.tmp", f"{base}/final")
    with fs.open_output_stream(f"{base}/.left.tmp") as out:
        out.write(b"x")
    shared.sweep(fs, base)
    assert [i.base_name for i in fs.get_file_info(pa.fs.FileSelector(base))] == ["final"]
