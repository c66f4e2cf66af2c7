"""Deduplication, packing, search and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from almucantar.llm import components, minhash, nearest, packing, shared, substrings, words
from almucantar.llm.suffixes import suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")


def brute_repeats(rows, length=50):
    first, out = {}, []
    last = 2**63 - 1
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g, k = b[p : p + length], last if i is None else i
            first[g] = min(first.get(g, k), k)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeated_rows(n=200):
    random.seed(5)
    rows = []
    for i in range(n):
        t = "".join(random.choice("abcdefghijklm é\n") for _ in range(random.randint(0, 500))) if random.random() < 0.8 else "x" * random.randint(0, 200)
        if rows and random.random() < 0.6:
            o = random.choice(rows)[1]
            a = random.randint(0, max(0, len(o) - 1))
            t = t[:100] + o[a : a + random.randint(40, 200)] + t[100:]
        rows.append((i, t))
    return rows + [(7, rows[8][1]), (None, rows[3][1]), (n + 1, None), (n + 2, ""), (3, rows[3][1])]


def test_suffix_array():
    random.seed(3)
    for _ in range(500):
        x = [random.randrange(random.choice([1, 2, 3, 9])) for _ in range(random.randint(0, 60))]
        x = (x[:7] * 20)[: len(x)] if random.random() < 0.3 else x
        assert suffix_array(np.array(x, int)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_repeats_against_brute_force(spark):
    rows = repeated_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, blob int").repartition(3)
    assert sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=str) == brute_repeats(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1 << 20, 40])
def test_shared_strings(monkeypatch, small):
    monkeypatch.setattr(substrings, "ARRAY_BYTES", small)
    monkeypatch.setattr(substrings, "SLICE", 300)
    data = [(t or "").encode() for _, t in repeated_rows(60)]
    at = np.cumsum([0] + [len(b) for b in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    h, sid, first, last, anchor = substrings.stretches(raw, at, 50)
    assert sum(last - first + 1) == sum(max(0, len(b) - 49) for b in data)
    doc = np.searchsorted(at, first, "right") - 1
    size = last - first + 50
    text = np.concatenate([raw[f : f + n] for f, n in zip(first, size, strict=True)])
    least = substrings.shared_strings(h, doc, size, anchor - first, np.cumsum(size) - size, text, 50)
    where, k = np.cumsum(size - 49) - (size - 49), {}
    for i in range(len(first)):
        for o in range(size[i] - 49):
            g = raw[first[i] + o : first[i] + o + 50].tobytes()
            k[g] = min(k.get(g, 10**9), int(doc[i]))
    for i in range(len(first)):
        for o in range(size[i] - 49):
            assert least[where[i] + o] == k[raw[first[i] + o : first[i] + o + 50].tobytes()]


def test_very_common_grams_are_last_anchors():
    """The anchor of each string is its least gram that is not very common, or its least if all are."""
    rng = np.random.default_rng(5)
    line = rng.integers(0, 256, 120, dtype=np.uint8)
    data = np.concatenate([x for _ in range(12) for x in (line[: rng.integers(20, 121)], rng.integers(0, 256, rng.integers(1, 60), dtype=np.uint8))])
    h = substrings.grams(data)
    common = substrings.Common(np.unique(np.concatenate([substrings.grams(line), h[::17]])))
    known = set(common.hashes.tolist())
    key = [(int(x) in known, (int(x) >> 1) & 0x7FFFFFFF00000000, i) for i, x in enumerate(h)]
    width = 50 - substrings.GRAM + 1
    expected = [min(key[i : i + width])[2] for i in range(len(data) - 49)]
    _, _, first, last, anchor = substrings.stretches(data, np.array([0, len(data)]), 50, common)
    assert np.repeat(anchor, last - first + 1).tolist() == expected
    assert any(key[i][0] for i in expected) and not all(key[i][0] for i in expected)


def test_pieces_are_encoded_together(monkeypatch):
    """Ids are the library's whatever the pieces hold, and the tokenizer is not called with each piece."""
    from almucantar.llm import tokens

    rng = random.Random(3)
    word = lambda odd: "".join(rng.choice("abXYZéßσΣŉ'’-9٣_\u0301\x7f世\t\u3000.,!$&" + odd) for _ in range(rng.randrange(0, 9)))
    path = public_tokenizers.path("word_bpe_49k.json")
    for odd in ("", "\x01\x1f\x00"):
        encoder = tokens.Encoder(path, keeps_space=False)
        texts = ["\n".join(" ".join(word(odd) for _ in range(12)) for _ in range(3)) for _ in range(400)] + ["a\x01 \x01 b" * bool(odd), ""]
        for part in (texts[:100], texts):
            ids, bounds = encoder.encode(pa.array(part))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    given = []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return own.encode_batch_fast(texts, **options)

    own, encoder.tokenizer = encoder.tokenizer, Counting()
    encoder.encode(pa.array([" ".join(f"word{i}" for i in range(1000))]))
    assert len(given) <= 10


def test_encoder_on_slices():
    """A slice of an array of texts gets the ids that its texts get one by one."""
    from almucantar.llm import tokens

    texts = [f"Größe Ärger {i} naïve Łódź 日本語 Text\nNEW Line" * (i % 5) for i in range(300)]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), keeps_space=False)
    for part in shared.text_batches([batch.slice(7)], 4000):
        ids, bounds = encoder.encode(part.column(0))
        expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in part.column(0).to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    random.seed(9)
    base = [[f"w{random.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(160):
        t = list(random.choice(base))
        for _ in range(random.randrange(5)):
            t[random.randrange(60)] = f"n{random.randrange(9999)}"
        rows.append((i, " ".join(t)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE  two"), (504, "x"), (3, rows[3][1]), (None, rows[4][1]), (None, "alone here now yes")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, bands string")
    sets = [frozenset(words.shingle_sets(__import__("pyarrow").array([t]), 3)[0].tolist()) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, shingle=3, per_cent=85).collect())
    expected = Counter((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True) if i is not None)
    expected[None, len(sets[-2]), find(4), False] += 1
    expected[None, len(sets[-1]), None, True] += 1
    assert got == expected
    assert minhash.near_duplicates(docs.limit(0), shingle=3).count() == 0


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    x, y = minhash.signature(a, 192), minhash.signature(b, 192)
    assert abs((x == y).mean() - 1600 / 2400) < 0.12
    scatter, circle = minhash._tables(192)
    assert (circle[5][1:] == circle[6][:-1]).all() and sorted(scatter[:5]) != list(range(5))


def check_plan(counts, capacity):
    used = Counter()
    bins = {}
    for length, r0, r1, first, per, base in packing.plan(counts, capacity):
        assert r0 == used[length]
        used[length] = r1
        for r in range(r1 - r0):
            bins.setdefault(first + r // per, []).append((base + r % per * length, length))
    assert used == Counter(counts)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_plan_is_whole_and_tight():
    rng = random.Random(4)
    for capacity in (7, 30, 1024):
        for _ in range(60):
            counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
            n = check_plan(counts, capacity)
            least = -(-sum(k * v for k, v in counts.items()) // capacity)
            assert max(least, sum(v for k, v in counts.items() if 2 * k > capacity)) <= n <= 1.3 * least + sum(v for k, v in counts.items() if 3 * k > capacity) + 1
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError, match="capacity"):
        packing.plan({11: 1}, 10)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "ça", "x1"]) for _ in range(rng.choice([0, 3, 30, 60])))) for i in range(60)] + [(70, None), (5, "twice"), (None, "no id"), (71, "w " * 300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in texts)
    by_sequence, whole = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 64
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] == 71:
            whole[r["start"]] = r["ids"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    long = tuple(i for _, ids in sorted(whole.items()) for i in ids)
    assert (71, long) in expected
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows if r["piece"] == 0 and r["ids"][-1] == 2) <= expected
    assert packing.pack(docs.limit(0), path).count() == 0


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(600)] + [(700, None, 0), (720, [0.0] * 16, 0), (740, [float("nan")] * 16, 0), (760, [1.0] * 5, 0), (None, [1.0] * 16, 0), (780, [None] * 16, 0), (0, [float(v) for v in x[0]], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest.search(vectors, chunk=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        hit += len({v for v, _ in found.values()} & set(best.tolist()))
        listed = [found[k] for k in sorted(found)]
        assert listed == sorted(listed, key=lambda r: (-r[1], r[0])) and all(s == pytest.approx(score[v]) for v, s in listed)
    assert hit >= 0.9 * 20 * len(got)
    assert nearest.search(vectors.limit(0)).count() == 0 and nearest.search(spark.createDataFrame(rows[:3], vectors.schema)).count() == 2


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline
    from almucantar.llm import decontaminate, secrets, shared

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, docs, sf), "stage-test")
        sizes.append(out.count())
        if name != "packing":
            assert out.columns == docs.columns and sizes[-1] <= sizes[-2]
        if name == "near_duplicates":
            assert minhash.near_duplicates(out).where("not kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(out, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name == "secrets":
            assert out.count() == docs.count() and secrets.scan(out).where("n_assign + n_access + n_hex > 0").count() == 0
            assert out.where("n_chars != char_length(text)").count() == 0
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out


def test_shared_strings_go_to_arrays_once(monkeypatch):
    """A passage that many texts have between bytes of their own does not go to the suffix arrays with each of them."""
    rng = np.random.default_rng(11)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    passage = letters(60)
    parts = [np.concatenate([letters(89), own, passage, own, letters(89)]) for own in np.arange(200, dtype=np.uint8)[:, None]]
    raw, at = np.concatenate(parts), np.arange(201) * 240
    h, sid, first, last, anchor = substrings.stretches(raw, at, 50)
    doc, size = np.searchsorted(at, first, "right") - 1, last - first + 50
    text = np.concatenate([raw[f : f + n] for f, n in zip(first, size, strict=True)])
    seen = []
    monkeypatch.setattr(substrings, "suffix_array", lambda symbols: seen.append(len(symbols)) or suffix_array(symbols))
    least = substrings.shared_strings(h, doc, size, anchor - first, np.cumsum(size) - size, text, 50)
    begins = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    inside = (begins % 240 >= 90) & (begins % 240 <= 100)
    assert (least == np.where(inside, 0, begins // 240)).all()
    assert sum(seen) < 1000
