"""Each registered query on the smallest tables: columns, and rows against brute force or SQL."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from almucantar.llm import decontaminate, queries, secrets, words  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def run(spark, name):
    out = queries.queries()[name](spark, SF)
    return out.columns, [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    columns, rows = run(spark, name)
    expected = duck.execute(queries.oracle_sql()[name])
    assert [d[0] for d in expected.description] == columns
    assert Counter(rows) == Counter(expected.fetchall())


def test_op2_against_all_places(spark, duck):
    columns, rows = run(spark, "op2_decontaminate")
    assert columns == ["doc_id", "item_id", "first_word", "n_words", "n_equal"]
    ids, texts = zip(*duck.execute("SELECT doc_id, text FROM documents").fetchall(), strict=True)
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    hashes, bounds = words.word_hashes(__import__("pyarrow").array(texts))
    own = [(i, words.word_hashes(__import__("pyarrow").array([t]))[0]) for i, t in items]
    expected = set()
    for doc, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True):
        some = hashes[a:b]
        for item, q in own:
            if len(np.intersect1d(some, q)) and decontaminate.best_overlap(some, q, range(-len(q) + 1, len(some)), 80, 13):
                expected.add((doc, item))
    assert {r[:2] for r in rows} == expected and len(rows) == len(expected) > 0


def test_op3_recall(spark, duck):
    columns, rows = run(spark, "op3_nearest")
    assert columns == ["query_id", "rank", "vec_id", "score"]
    data = duck.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY 1").fetchall()
    x, ids = np.array([r[1] for r in data], np.float64), np.array([r[0] for r in data])
    found, hit, total = defaultdict(list), 0, 0
    for q, rank, v, score in rows:
        found[q].append((rank, v, score))
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[: min(20, len(ids) - 1)]
        assert sorted(r for r, _, _ in found[q]) == list(range(1, len(best) + 1))
        hit += len({v for _, v, _ in found[q]} & set(ids[best].tolist()))
        total += len(best)
        for _, v, s in found[q]:
            assert s == pytest.approx(score[ids == v][0])
    assert hit >= 0.9 * total and set(found) == set(ids[ids % 20 == 0].tolist())


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_op4_columns_and_held_out(spark, duck):
    columns, rows = run(spark, "op4_toxicity")
    assert columns == ["doc_id", "held_out", "score", "predicted"]
    assert Counter(r[0] for r in rows) == Counter(r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall())
    for doc, held, score, predicted in rows:
        assert held == (crc(doc) % 3 == 1) and 0 <= score <= 1 and predicted == int(score >= 0.7)


def test_op5_places_and_ids(spark, duck):
    from tokenizers import Tokenizer

    columns, rows = run(spark, "op5_packing")
    assert columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, crc32, sequence, offset in rows:
        by_doc[doc].append((piece, start, length, crc32))
        by_sequence[sequence].append((offset, length))
    for doc, text in duck.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, (piece, start, length, crc32) in enumerate(sorted(by_doc.pop(doc))):
            assert (piece, start) == (k, at) and (length == 1024 or k == 0)
            assert crc32 == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not by_doc
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * sum(r[3] for r in rows) / 1024 + sum(3 * r[3] > 1024 for r in rows) * 0.5 + 1


def test_op7_spans(spark, duck):
    columns, rows = run(spark, "op7_secrets")
    assert columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == len(texts)
    for doc, n_assign, n_access, n_hex, base, spans in rows:
        own = [s.split(":") for s in spans.split(",") if s]
        assert own == sorted(own, key=lambda s: (int(s[1]), secrets.KINDS.index(s[0]))) and all(int(e) <= len(texts[doc] or "") for _, _, e in own)
        kept = [s for s in own if s[0] != "lexed"]
        assert hashlib.sha256(",".join(map(":".join, kept)).encode()).hexdigest() == base
        assert [sum(s[0] == k for s in kept) for k in secrets.KINDS[:3]] == [n_assign, n_access, n_hex]


def test_op8_ids(spark, duck):
    from tokenizers import Tokenizer

    columns, rows = run(spark, "op8_token_files")
    assert columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    tokenizer, start, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {r[0]: r for r in rows}
    for doc, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert got.pop(doc) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_op9_held_out(spark, duck):
    columns, rows = run(spark, "op9_langid")
    assert columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert len(rows) == len(lang) and all(h == (crc(d) % 4 == 2) and 0 <= s <= 1 for d, h, _, s in rows)
    held = [(lang[d], p) for d, h, p, _ in rows if h and lang[d]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_pipeline(spark, duck):
    columns, rows = run(spark, "pipeline")
    assert columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = {r[0] for r in rows}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert kept <= set(texts)
    sets = {d: frozenset(words.shingle_sets(__import__("pyarrow").array([texts[d]]), 5)[0].tolist()) for d in kept}
    of = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            of[g].add(d)
    for d, s in sets.items():  # no two that stay are near duplicates
        for other, n in Counter(o for g in s for o in of[g] if o < d).items():
            assert 100 * n < 80 * (len(s) + len(sets[other]) - n)
    assert json.dumps(sorted(kept))  # ids are plain integers


def test_entry_without_a_library(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == "public_tokenizers":
            raise ModuleNotFoundError("No module named 'public_tokenizers'", name="public_tokenizers")
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m in ("public_tokenizers", "corpus_pipeline") or m.startswith("almucantar.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import almucantar

    monkeypatch.delattr(almucantar, "llm", raising=False)
    monkeypatch.setattr(builtins, "__import__", refuse)
    with pytest.warns(UserWarning, match="without the training-data operators"):
        entry = importlib.reload(__spark_entry__)
    assert "clim_blend" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
