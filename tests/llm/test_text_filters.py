"""Secrets, decontamination, toxicity and languages: fixtures, brute force and held-out accuracy."""

import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from almucantar.llm import decontaminate, langid, secrets, toxicity, words

SF = "/root/testdata/sf0.01"


def brute_base(text):
    spans = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets_against_brute_force(spark):
    texts = ["", None, "token=token=abcdefgh", "password: token: abcdefghij", "PassWord='abc' passwd = \"longenough1\"", "AKIA" + "A1" * 8 + " AKIAAKIA12", "é" + "0123456789abcdef" * 2 + "g", "api_key:x apikey=12345678", "secret" * 1000]
    rng = np.random.default_rng(4)
    bits = ["token", "secret", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH1234", "0f" * 16, "é", "\n", "api_key", "x"]
    texts += ["".join(rng.choice(bits, 30)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in secrets.scan(docs).collect():
        base = brute_base(texts[r["doc_id"]] or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert secrets.scan(docs.limit(0)).count() == 0


def test_lexer_carries_literals_through_names():
    text = 'seed = "Zx81kQpL0vNn3s"\nother = seed\ndb_pwd = other\nnote = "hello there friend"\n{"client_key": \'Qw3rTy7uIoPa9\'}\n<privateKey>Ab9dEf7hIj5kLm</privateKey>\nx: "Zz" + "9k"'
    found = [text[a:b] for a, b in secrets.lexed_spans(text)]
    assert found == ['"Zx81kQpL0vNn3s"', "'Qw3rTy7uIoPa9'", "Ab9dEf7hIj5kLm"]
    assert secrets.lexed_spans('password = "changeme-example"') == [] and secrets.lexed_spans("plain words only") == []
    assert "kQpL" not in secrets.redact_text(text) and "hello there friend" in secrets.redact_text(text)


KEY = "q9Zx7Lm2Rt8Vb4Ny"


@pytest.mark.parametrize(
    "code",
    [
        '{"name": "db_password", "value": "%s"}',
        "const pwd = `%s`",
        'pwd = """%s"""',
        'const pwd: string = "%s"',
        "db_pass: |\n  %s\nnext: 1",
        'client.credential = x\nx = "%s"',
        "- name: DB_PWD\n  value: %s\n",
        "- value: %s\n  name: DB_PWD\n",
        '<add key="pwd" value="%s"/>',
        '# old_pwd = "%s"',
        '/* pwd = "%s" */',
        'config["pwd"] = "%s"',
        "'pwd' => '%s',",
        'let pwd: &str = "%s";',
        'pwd = os.environ.get("X", "%s")',
        'pwd = ("%s")',
        "export PWD_MAIN=%s",
    ],
)
def test_lexer_reads(code):
    text = code.replace("%s", KEY)
    assert KEY in [text[a:b].strip("\"'`") for a, b in secrets.lexed_spans(text)]


def test_lexer_joins_and_tells_apart():
    text = 'a = "q9Zx7L"\nb = "m2Rt8Vb4Ny"\nmy_pwd = a + b\nc = "q9Zx7L" + "m2Rt8Vb4Ny"'
    assert [text[a:b] for a, b in secrets.lexed_spans(text)] == ['"q9Zx7L"', '"m2Rt8Vb4Ny"']
    assert secrets.lexed_spans(f'# x = "{KEY}"\npwd = x') == []  # a comment binds no name of the code
    assert secrets.lexed_spans("a = b\nb = a\npwd = a") == [] and secrets.lexed_spans(f'- name: DB_PWD\n- value: "{KEY}"') == []
    assert secrets.lexed_spans("x = x + x\n" * 2000 + "pwd = x") == []


@pytest.mark.parametrize("piece", ['pwd = "a1b2c3d4X" ;', "a=b;", "<a b='c' ", "- a: b\n  value: c\n", "a-", "x=f(", "password = aaaaaaaa1 ", "/* a=b */ ", "'", "{"])
def test_scan_is_linear(piece):
    took = []
    for size in (40_000, 320_000):
        text = piece * (size // len(piece))
        began = time.process_time()
        secrets.all_spans(text, secrets.base_spans(text))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_spans_against_every_base_span():
    rng = np.random.default_rng(3)
    for _ in range(200):
        base = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 20, 6), strict=True))
        lexed = sorted({(int(a), int(a + n)) for a, n in zip(rng.integers(0, 60, 6), rng.integers(1, 20, 6), strict=True)})
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(secrets, "lexed_spans", lambda text, lexed=lexed: lexed)
            found = secrets.all_spans("", base)
        assert found == sorted(base + [(s, 3, e) for s, e in lexed if not any(b <= s + 1 and e - 1 <= f for b, _, f in base)])


def test_decontamination_finds_substituted_passages(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    items = [make(30), make(15), make(9), make(3)]
    docs = [make(200) for _ in range(40)]
    docs[3][50:80] = items[0]
    docs[4][10:40] = [w if i % 8 else "other" for i, w in enumerate(items[0])]
    docs[5][180:195] = [w.upper() for w in items[1]]
    docs[6][0:9] = items[2]
    docs[7][0:3] = items[3]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)] + [(90, None), (91, ""), (None, " ".join(items[0]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()), key=str)
    expected = sorted([(3, 0), (4, 0), (5, 1), (6, 2), (7, 3), (None, 0)], key=str)
    assert got == expected
    clashing = d.withColumns({"key": F.lit(1), "_key0": F.lit(2), "seed": F.lit(3)})
    left = decontaminate.clean(clashing, b)
    assert left.columns == clashing.columns and left.count() == d.count() - 6
    hot = d.unionByName(d.selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' ', doc_id) AS text"))  # seeds that several texts share
    found = decontaminate.contaminated(hot, b.unionByName(b.withColumn("item_id", F.col("item_id") + 100)), most=1)
    more = [(a if a is None else a + k, i + j) for a, i in expected for k in ((0,) if a is None else (0, 1000)) for j in (0, 100)]
    assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == sorted(more, key=str)
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_overlap_against_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 25)) < rng.random()
        for need, per_cent in ((1, 80), (5, 80), (13, 90), (4, 100)):
            fits = [(b - a, -a) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if b - a >= need and 100 * equal[a:b].sum() >= per_cent * (b - a)]
            found = decontaminate.overlap(equal, need, per_cent)
            assert (found and found[1] - found[0]) == (max(fits)[0] if fits else None)
            if found:
                assert 100 * equal[found[0] : found[1]].sum() >= per_cent * (found[1] - found[0])
    began = time.perf_counter()
    assert decontaminate.overlap(np.ones(2_000_000, bool), 13, 80) == (0, 2_000_000) and time.perf_counter() - began < 5


def test_bloom_filter_has_all(spark):
    values = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    rows = spark.createDataFrame([(int(v), 13) for v in values[:2500].view(np.int64)], "seed long, span int")
    own = decontaminate.bloom(rows, 2500)
    assert np.isin(np.arange(2500), own.has(values)).all() and len(own.has(values)) < 2520 and own.spans == [13]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), per_language=100)
    some = docs.where(langid.held_out()).toPandas()
    right = sum(model.predict(t)[0] == lang for t, lang in zip(some["text"], some["lang"], strict=True))
    assert right >= 0.97 * len(some)
    assert model.predict(None) == ("und", 0.0) and model.predict("12 !") == ("und", 0.0) and model.predict("")[0] == "und"
    odd = spark.createDataFrame([(1, None, 5), (None, "the 𝒜", 5), (2, "", 5)], "doc_id long, text string, score int")
    assert langid.identify(odd, model).count() == 3
    assert langid.train(docs.limit(0)).predict("word") == ("und", 0.0)


def test_toxicity_held_out():
    rows = duckdb.sql("SELECT d.doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) ORDER BY toxic DESC, doc_id LIMIT 2200").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    net = toxicity.fit([r[1] for r in known], [r[2] for r in known], sum(r[2] for r in known) / len(known))
    p = net.scores(toxicity.read(pa.array([r[1] for r in held])))
    y = np.array([r[2] for r in held])
    order = np.argsort(np.argsort(p))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and (p[y == 0] >= 0.7).mean() < 0.1
    odd = net.scores(toxicity.read(pa.array(["", None, "a", "a b " * 50])))
    assert odd[0] == odd[1] and ((odd >= 0) & (odd <= 1)).all()


def test_network_gradient():
    net = toxicity.Network.new(1)
    t = toxicity.read(pa.array(["one two three four five", "six seven"]))
    apart = toxicity.read_all(["one two three four five", "six seven"], most_bytes=1)
    assert (net.scores(t) == net.scores(apart)).all() and (apart.hash == t.hash).all() and (apart.index == t.index).all()
    first, size, _ = toxicity.windows(t.bounds)
    index, mask = toxicity.window_words(t, first, size)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)

    def loss():
        gates = net.projected(net.inputs(t))
        return float(net.forward(gates, index, mask).sum())

    gates = net.projected(net.inputs(t).astype(np.float64))
    _, saved = net.forward(gates, index, mask, keep=True)
    g, _ = net.backward(gates, index, mask, saved, np.ones(len(index)))
    for name in ("hf", "hb", "a", "av", "o"):
        w, at = net.w[name], tuple(0 for _ in net.w[name].shape)
        w[at] += 1e-2
        up = loss()
        w[at] -= 2e-2
        down = loss()
        w[at] += 1e-2
        assert abs((up - down) / 2e-2 - g[name][at]) < 1e-3


def test_windows_cover_all_words():
    first, size, text = toxicity.windows(np.array([0, 0, 5, 29, 100]))
    seen = np.zeros(100, int)
    for a, n in zip(first, size, strict=True):
        seen[a : a + n] += 1
    assert seen.min() >= 1 and set(text) == {0, 1, 2, 3} and size.max() <= toxicity.WINDOW


def test_word_hashes_equal_words_only():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("aB \n\té"), 40)) for _ in range(200)] + [None, "", " "]
    hashes, bounds = words.word_hashes(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(words._LOWER)))
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, h in zip(own, hashes[bounds[i] : bounds[i + 1]], strict=True):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_whole_values_are_scored():
    """What stands beyond the first thousands of characters of a value counts as well."""
    key = "kQpL93ZxWm7Rt2Vb" * 300
    assert secrets.lexed_spans(f'pwd = "{key}"') == [(6, 8 + len(key))]
    assert secrets.lexed_spans(f'pwd = "{key} and then prose"') == []
    assert secrets.lexed_spans(f'a = "{key}"\npwd = a + "exam" + "ple"') == []
    assert secrets.lexed_spans('pwd = "' + "a" * 5000 + 20 * key + '"') != []
    assert len(secrets.lexed_spans(f'k0 = "{KEY}"\n' + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 2000)) + "pwd = k1999")) == 1
