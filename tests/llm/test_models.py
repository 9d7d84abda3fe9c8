"""Language, whitening and fill-in-middle against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from claimforge.llm import entry, fim, langid, whitening

DOCS = "doc_id long, text string, lang string, n long, score double, _cf_row string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, 0.5, "x") for i, t, lang in rows], DOCS)


def plain_phrases(sample, data):
    """Greedy longest matches by searching the sample, in blocks."""
    count = 0
    for start in range(0, len(data), langid.BLOCK):
        block = data[start : start + langid.BLOCK]
        i = 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in sample:
                n += 1
            i, count = i + n, count + 1
    return count


def test_phrases_equal_plain_search():
    rnd = random.Random(3)
    samples = {"a": "".join(rnd.choice("abé ") for _ in range(700)), "b": "".join(rnd.choice("bcß文 ") for _ in range(300)), "c": "z"}
    model = langid.Model([(k, len(v.encode()), *(x.tobytes() for x in langid.automaton(v.encode()))) for k, v in samples.items()])
    texts = ["", " ", "a", "abba", "zzzz", "ÿ?", *("".join(rnd.choice("abcéß文z ") for _ in range(n)) for n in (3, 50, 1023, 1024, 1025, 5000))]
    coded = [t.encode() for t in texts]
    rows = np.cumsum([0, *map(len, coded)])
    got = model.phrases(np.frombuffer(b"".join(coded), np.uint8), rows)
    assert got.tolist() == [[plain_phrases(v.encode(), c) for v in samples.values()] for c in coded]
    few = langid.Model(model.rows)
    few.tables = {}
    langid_cells, langid.CELLS = langid.CELLS, 0
    try:
        assert few.phrases(np.frombuffer(b"".join(coded), np.uint8), rows).tolist() == got.tolist() and not few.tables
    finally:
        langid.CELLS = langid_cells
    best, score, _ = model.judge(got, np.array([len(c) for c in coded]))
    for phrases, b, s in zip(got, best, score):
        bits = [n * math.log2(max(len(v.encode()), 2)) for n, v in zip(phrases, samples.values())]
        assert bits[b] == min(bits) and abs(s - 1 / sum(2 ** (min(bits) - x) for x in bits)) < 1e-12


def test_language_of_driver_documents(spark, tables):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = entry.op11_langid(spark, tables).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(judged) / len(judged) > 0.95
    assert sorted(map(tuple, entry.op11_langid(spark, tables).collect())) == sorted(map(tuple, got))


def test_language_of_odd_rows(spark):
    english, german = "the cat sat on the mat with the other cats and then ", "der hund und die katze sind nicht auf dem tisch gewesen "
    fit = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    out = [i for i in range(100) if i not in fit]
    rows = [(i, (english, german)[k % 2] * 3, ("en", "de")[k % 2]) for k, i in enumerate(fit[:20])] + [(fit[20], None, "en"), (fit[21], "12 !?", "de"), (fit[22], "qqqq", None), (None, english, "en")]
    rows += [(out[0], "THE OTHER CATS", "de"), (out[1], "nicht auf dem Tisch", None), (out[2], "́ 7", "en"), (out[3], "日本", "en"), (out[4], english * 9000, "de"), (out[0], "THE OTHER CATS", "de"), (out[5], "", "xx"), (out[6], "vous", "fr")]
    got = langid.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "de", "und"}
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (fit[20], fit[21], out[2], out[5])] == ["und"] * 4 and by[out[2]].score == 0
    assert [by[i].lang_pred for i in (out[0], out[1], out[4])] == ["en", "de", "en"] and by[out[4]].score > 0.99
    assert by[out[3]].lang_pred in ("en", "de")
    alone = langid.identify(docs(spark, [(i, english, "en") for i in fit[:3]] + [(out[0], german, "de")])).collect()
    assert {r.lang_pred for r in alone} == {"en"} and {r.score for r in alone} == {1.0}
    assert [(r.lang_pred, r.score) for r in langid.identify(docs(spark, [(fit[0], "the", None)])).collect()] == [("und", 0.0)]
    assert langid.identify(docs(spark, [])).collect() == []


def test_sample_counts_copies_once_and_is_bounded(spark):
    rnd, fit = random.Random(6), [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "copy of one text " * 9, "en") for i in fit[:800]] + [(i, "".join(rnd.choice("abcdefg ") for _ in range(1400)), "en") for i in fit[800:1600]]
    pieces, known = langid.sample(docs(spark, rows), 16)
    got = pieces.collect()
    assert known == [("en", 1600)] and len(got) == 16 and len({r.piece for r in got}) == 16
    assert sum("copy" in r.piece for r in got) <= 1


def expected(vectors):
    """n, deviation of each row, whitened and explained by a plain eigenvalue solver."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, v = np.linalg.eigh(c.T @ c / n)
    values, v = values[::-1], v[:, ::-1]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x], c @ v / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitening_equals_plain_solver(spark, tables):
    rows = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = expected([r.embedding for r in rows])
    place = {r.vec_id: i for i, r in enumerate(rows)}
    got = entry.op12_whitening(spark, tables).collect()
    assert len(got) == 32 * n and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for r in got:
        i, k = place[r.vec_id], r.component - 1
        sign.setdefault(k, 1 if r.whitened * whitened[i][k] > 0 else -1)
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.whitened - sign[k] * whitened[i][k]) < 1e-7 and abs(r.explained / explained[k] - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    rnd = random.Random(2)
    good = [[rnd.gauss(0, 1 + k) for k in range(5)] for _ in range(40)] + [[0.5] * 5] * 3
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4, [1.0] * 4, [None] * 5]
    kind = "vec_id long, embedding array<float>, whitened string, deviation string, _cf_x string"
    table = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in enumerate(good + bad)] + [(None, good[0], "a", "b", "c")], kind)
    got = whitening.query(table).collect()
    stored = [np.float32(v).tolist() for v in [*good, good[0]]]
    n, deviation, whitened, explained = expected(stored)
    assert len(got) == 5 * n and {r.n for r in got} == {44} and got[0].identity_error < 1e-9
    for r in got:
        i = 43 if r.vec_id is None else r.vec_id
        assert r.deviation == deviation[i] and abs(abs(r.whitened) - abs(whitened[i][r.component - 1])) < 1e-7 and abs(r.explained - explained[r.component - 1]) < 1e-9
    model = whitening.fit(table, components=2)
    kept = whitening.transform(table, model).collect()
    assert len(kept) == 44 and set(kept[0].asDict()) == {"vec_id", "embedding", "_cf_x", "deviation", "whitened"} and len(kept[0].whitened) == 2
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<float>")
    line = spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.query(flat).collect() == [] and whitening.query(flat.limit(0)).collect() == []
    assert {r.component for r in whitening.query(line).collect()} == {1}
    far = spark.createDataFrame([(i, [1e30 * (i % 3), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(r.deviation is None or r.deviation > 0 for r in whitening.query(far).collect())


@pytest.mark.parametrize("values", [np.arange(300, 0, -1.0) ** 2, np.r_[np.full(40, 9.0), np.linspace(3, 1, 260)], np.r_[np.full(5, 2.0), np.zeros(295)], np.ones(300), 0.8 ** np.arange(300)])
def test_lanczos_finds_the_leading_pairs(values):
    """Equal values, few values (breakdown) and more passes than the basis holds (restarts)."""
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(1)).standard_normal((300, 300)))
    matrix, passes = (q * values) @ q.T, []

    def apply(v):
        passes.append(v.shape[1])
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-10
        return matrix @ v

    got, vectors = whitening.lanczos(apply, 300, 12, block=4, most=60)
    assert np.allclose(got, values[:12], atol=1e-9 * values[0]) and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-8
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-9 * values[0] and len(passes) < 300


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_in_middle_equals_plain_version(spark):
    rnd = random.Random(5)
    texts = [None, "", " ", "a", "\n\n", "x<P>y", "<S>", "<M", "P>", "<", "<P", "S>", "é😀文", "don't", "ab " * 70000]
    texts += ["".join(rnd.choice("ab <>PSM\né😀1") for _ in range(rnd.randrange(60))) for _ in range(300)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id here", "en"), (12, texts[12], "en"), (-5, "minus five", "en")]
    got = fim.transform(docs(spark, rows)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *plain_fim(i, t), sha(plain_fim(i, t)[-1]), sha(t or "")) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(fim.restore(r.output, r.form) == (texts[r.doc_id] or "") for r in got if r.doc_id in range(len(texts)))
    kept = fim.transformed(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and sorted(r.text for r in kept.collect()) == sorted(r.output for r in got)
    assert fim.transform(docs(spark, [])).collect() == []
