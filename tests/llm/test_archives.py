"""WARC files and token files: exact round trips and edges."""

import hashlib
import zlib

import numpy as np
import pytest

from almucantar.llm import shared, token_files, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_warc_round_trip(spark):
    page = "<html>é" + "x" * 120 + "</html>"
    rows = [(3, "http://a/é b", page, 1), (1, "http://b", page, 2), (2, None, "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (None, "u", page, 6), (7, "u", "", 7), (7, "u", "", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest long")
    folder = shared.new_dir(spark, "warc-test")
    manifest = warc.write(pages, folder, file_bytes=600)
    assert sum(f["records"] for f in manifest) == len(rows) and len(manifest) > 1
    got = {(r["page_id"], r["record_type"]): r for r in warc.read(spark, folder, with_payload=True).collect()}
    digest = hashlib.sha256(page.encode()).hexdigest()
    assert got[1, "response"]["payload"] == page.encode() and got[1, "response"]["refers_to"] is None
    for k in (3, None):
        r = got[k, "revisit"]
        assert (r["refers_to"], r["payload_digest"], r["payload_bytes"]) == (1, digest, len(page.encode()))
    assert got[2, "response"]["payload"] == b"short" and got[4, "response"]["payload"] == b"short" and got[5, "response"]["payload"] == b""
    again = shared.new_dir(spark, "warc-test")
    warc.write(pages.repartition(3), again, file_bytes=600)
    data = []
    for f in (folder, again):
        fs, base = shared.filesystem(f)
        names = sorted(x.path for x in fs.get_file_info(__import__("pyarrow").fs.FileSelector(base)) if x.path.endswith(".gz"))
        data.append([(n.rsplit("/", 1)[1], fs.open_input_stream(n, compression=None).read()) for n in names])
    assert data[0] == data[1]


def test_warc_empty(spark):
    folder = shared.new_dir(spark, "warc-test")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder) == []
    assert warc.read(spark, folder).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        for high in (1, 2, 300, 50_000, 2**32 - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n > 10:
                ids[::97] = 2**32 - 1
            assert (token_files.decode_blocks(token_files.encode_blocks(ids))[:n] == ids).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(5, "Hello  WORLD it's"), (1, None), (2, ""), (9, "a " * 3000), (None, "null id"), (5, "Aa"), (3, "é\n\nü <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, start string").repartition(3)
    folder = shared.new_dir(spark, "ids-test")
    token_files.write(docs, folder, path, end_id=1, file_tokens=500)
    tokenizer, start = Tokenizer.from_file(path), 0
    got = sorted((tuple(r) for r in token_files.read(spark, folder).collect()), key=lambda r: r[1])
    for (doc, text), row in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), got, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert row == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = shared.new_dir(spark, "ids-test")
    token_files.write(docs.limit(0), empty, path, end_id=1)
    assert token_files.read(spark, empty).count() == 0


def test_one_document_can_be_read_alone(tmp_path):
    from pyarrow import fs

    ids = np.arange(5000, dtype=np.uint32) % 777
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "f")) as out:
        w = token_files.Writer(out)
        for a, b in ((0, 100), (100, 100), (100, 5000)):
            w.add([a], np.array([b - a]), ids[a:b])
        w.close()
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        r = token_files.Reader(source)
        assert (r.document(2) == ids[100:]).all() and len(r.document(1)) == 0
