import random

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimforge.llm import decontam, kernels, lines, near

DOCS = "doc_id long, text string, size long, component_id long, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def copies():
    """Texts with exact, near and transitive copies, short texts, nulls, ties and repeated rows."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((4, 30, 120)))]
        for _ in range(rnd.choice((1, 1, 2, 5))):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 1, 4))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "one\xa0two"), (906, "one two"), (907, "Two one"), (907, "Two one"), (None, "one two"), (None, None)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_equals_all_pairs(spark, copies, k):
    got = near.link(docs(spark, copies), k=k).collect()
    assert len(got) == len(copies)
    want = brute.near(list(dict.fromkeys(copies)), k, 80)
    expected = sorted(((i, *want[i, t], i == want[i, t][1]) for i, t in copies), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == expected


def test_near_of_driver_documents(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = brute.near(rows, 2, 80)
    got = near.link(spark.read.parquet(f"{tables}/documents.parquet")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, *v) for (i, _), v in want.items()}


def test_near_of_many_copies_of_one_text(spark):
    """Copies that are each near the first but not near each other form one component."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(w if rnd.random() > 0.04 else f"x{rnd.random()}" for w in base)) for i in range(80)] + [(500, " ".join(base))]
    got = {r.doc_id: r.component_id for r in near.link(docs(spark, rows)).collect()}
    assert got == {i: v[1] for (i, _), v in brute.near(rows, 2, 80).items()}


def test_near_dedup_keeps_rows_and_columns(spark):
    kept = near.deduped(docs(spark, [(3, "a b c"), (1, "a b c"), (2, None), (None, "q")])).collect()
    assert sorted((r.doc_id, r.size) for r in kept if r.doc_id) == [(1, 1), (2, 1)] and len(kept) == 3


def test_near_dedup_of_repeated_rows_and_ids(spark):
    """A repeated row stays once; a doc_id with two texts loses only the one that is a copy; of two near
    copies with one doc_id one stays; rows without doc_id stay."""
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (2, "p q r s"), (3, "x y z"), (3, "X y z"), (4, ""), (4, "m n o"), (4, ""), (None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c")]
    kept = near.deduped(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    got = sorted(((r.doc_id or 0, r.text.lower()) for r in kept.collect()))
    assert got == [(0, "a b c"), (0, "a b c"), (1, "a b c"), (2, "p q r s"), (3, "x y z"), (4, ""), (4, "m n o")]
    assert near.deduped(docs(spark, [])).collect() == []


def test_near_copies_of_which_none_reaches_all(spark):
    """A large group of near copies, beyond the threshold with each other or not; chains of versions; shortened
    copies of a copy; and another group that shares a passage. As by all pairs, with few pairs compared."""
    rnd = random.Random(11)
    word = lambda: f"n{rnd.randrange(10**6)}"
    base = [word() for _ in range(150)]
    edited = lambda text, n: [word() if i in at else w for at in [set(rnd.sample(range(len(text)), n))] for i, w in enumerate(text)]
    texts = [edited(base, rnd.randrange(1, 16)) for _ in range(500)]
    version = base
    for _ in range(12):
        version = edited(version, 7)
        texts.append(version)
    texts += [base[:150 - n] for n in range(1, 70, 3)] + [base[n:] for n in range(2, 60, 7)]
    texts += [base[:60] + [word() for _ in range(rnd.randrange(10, 40))] for _ in range(120)]
    family = [word() for _ in range(100)]
    texts += [edited(base[20:60] + family, rnd.randrange(1, 9)) for _ in range(150)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    compared, old = [], near._Graph.compared

    def counted(self, pairs, star=False):
        compared.append((found := old(self, pairs, star)).count())
        return found

    near._Graph.compared = counted
    try:
        for k in (2, 5):
            compared.clear()
            got = {r.doc_id: r.component_id for r in near.link(docs(spark, rows), k=k).collect()}
            assert got == {i: v[1] for (i, _), v in brute.near(rows, k, 80).items()}
            assert sum(compared) < 12 * len(rows) < len(rows) ** 2 / 60
    finally:
        near._Graph.compared = old


def test_frequent_differences_pair_no_members(spark):
    """Copies far from each other that share a few frequent edits: members of a group are sought by what few of them have."""
    rnd = random.Random(17)
    fresh = iter(range(10**6))
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(200):
        at = set(rnd.sample([*range(20), *range(30, 150)], 12))
        texts.append([f"f{rnd.randrange(3)}" if i == 25 else f"e{next(fresh)}" if i in at else w for i, w in enumerate(base)])
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *texts])]
    sought, old = [], near._Graph.apart

    def counted(self, members):
        sought.append((members.count(), (found := old(self, members)).count()))
        return found

    near._Graph.apart = counted
    try:
        got = {r.doc_id: r.component_id for r in near.link(docs(spark, rows), k=5).collect()}
    finally:
        near._Graph.apart = old
    assert got == {i: v[1] for (i, _), v in brute.near(rows, 5, 80).items()}
    assert sought and sought[0][0] > 150 and sought[0][1] < 50, sought


def test_agreements_by_marks(spark):
    """Marks take an eighth of a signature and count no agreement less than its keys."""
    rnd = random.Random(19)
    for n in (48, 13):
        x = [[rnd.randrange(-2**63, 2**63) for _ in range(n)] for _ in range(200)]
        pairs = [(v, [a if rnd.random() < 0.5 else rnd.randrange(-2**63, 2**63) for a in v]) for v in x] + [(x[0], x[0])]
        rows = spark.createDataFrame(pairs, "x array<long>, y array<long>").select("x", "y", near.marks(F.col("x"), n).alias("u"), near.marks(F.col("y"), n).alias("v"))
        for r in rows.withColumn("n", near.agreements(F.col("u"), F.col("v"), n)).collect():
            assert r.n == sum((a - b) % 256 == 0 for a, b in zip(r.x, r.y)) >= sum(a == b for a, b in zip(r.x, r.y))
            assert len(r.u) == -(-n // 8)


def test_near_dedup_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 5, 6, 7, 8, 9), (2, "a b c", 5, 6, 7, 8, 9)], "doc_id long, text string, g_id int, name int, node int, label int, component_id int")
    assert [tuple(r) for r in near.deduped(rows).collect()] == [(1, "a b c", 5, 6, 7, 8, 9)]


def test_near_of_an_empty_table(spark):
    assert near.link(docs(spark, [])).collect() == []


def test_texts_that_share_a_value_by_chance_are_not_compared_in_full(spark):
    """Texts of few different shingles share values with centres they have little else of: no whole sets of differences are made of them."""
    fresh = iter(range(10**6))
    rnd = random.Random(23)
    texts = [[f"w{rnd.randrange(25)}" for _ in range(60)] for _ in range(300)]
    texts += [[f"v{next(fresh)}" if i == 7 * n else w for i, w in enumerate(t)] for t in rnd.sample(texts, 20) for n in (1, 2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    stars, old = [], near._Graph.compared

    def counted(self, pairs, star=False):
        found = old(self, pairs, star)
        if star:
            stars.append(found.agg(F.sum(F.col("e") + F.col("r"))).first()[0] or 0)
        return found

    near._Graph.compared = counted
    try:
        got = {r.doc_id: r.component_id for r in near.link(docs(spark, rows)).collect()}
    finally:
        near._Graph.compared = old
    assert got == {i: v[1] for (i, _), v in brute.near(rows, 2, 80).items()}
    assert sum(stars) < 10_000, stars  # 260,190 if all members are compared with their centres


@pytest.mark.parametrize("many", [2048, 20])
def test_members_held_by_signatures_equal_all_pairs(spark, monkeypatch, many):
    """With all members of long lists held against each other in blocks, and none by differences."""
    monkeypatch.setattr(near, "APART", 49)
    monkeypatch.setattr(near, "HALF", 49)
    monkeypatch.setattr(near, "straddles", lambda _: 0)
    monkeypatch.setattr(near, "MANY", many)
    rnd = random.Random(29)
    base = [f"b{i}" for i in range(150)]
    texts = [[f"e{rnd.random()}" if rnd.random() < 0.05 else w for w in base] for _ in range(100)]
    rows = [(i, " ".join(t)) for i, t in enumerate([t for t in texts for t in (t, [*t[:-1], f"x{rnd.random()}"])])]
    got = {r.doc_id: r.component_id for r in near.link(docs(spark, rows)).collect()}
    assert got == {i: v[1] for (i, _), v in brute.near(rows, 2, 80).items()}


def test_signatures_rarely_miss():
    assert near.misses() < 1e-5 and near.straddles() < 1e-5


def test_words_and_their_hashes():
    import pyarrow as pa

    texts = ["Ab  cdé\n\x0bEF", None, "", "ab", "x" * 5000 + " AB", "É é"]
    w = kernels.Words(pa.array(texts))
    assert [b - a for a, b in zip(w.ptr, w.ptr[1:])] == [len(brute.words(t)) for t in texts]
    flat = [x for t in texts for x in brute.words(t)]
    assert len(set(zip(flat, w.hash.tolist()))) == len(set(flat)) == len(set(w.hash.tolist()))


def test_line_dedup(spark):
    a, b = "one\ntwo\n\nthree\nfour", "zero\n one \ntwo\nthree\r\nfive"
    rows = [(2, a), (1, b), (3, None), (4, ""), (5, "x\nx\nx\nx\nx"), (6, "one\ntwo"), (7, a)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup(docs(spark, rows)).collect()}
    assert got == brute.line_dedup(rows)
    assert got[7] == ("", 5, 5)


def test_line_dedup_in_the_pipeline(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nc\nd"), (4, None), (None, "a\nb\nc\ne")]
    out = lines.deduped(docs(spark, rows))
    assert out.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "d"), (4, None), (None, "a\nb\nc\ne"), (3, "d")][1:], key=str)


def test_line_dedup_of_an_empty_table(spark):
    assert lines.dedup(docs(spark, [])).collect() == []


def test_tiling_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        few = rnd.choice((3, 6, 12))
        item = [rnd.randrange(few) for _ in range(rnd.randrange(3, 60))]
        text = [rnd.randrange(few) for _ in range(20)] + item[8:] + [rnd.randrange(few) for _ in range(9)] + item[:8]
        assert decontam.tiled_words(item, text, [True] * len(text), 3) == brute.tiling(item, text, 3)
        spread = [i * 1000 + rnd.randrange(3) for i in range(30)]
        moved = spread[20:] + [7, 8] + spread[:20]
        assert decontam.tiled_words(spread, moved, [True] * len(moved), 3) == brute.tiling(spread, moved, 3) == 30


def test_coverage_equals_brute_force(spark):
    """Every document and item by plain greedy tiling of all their words."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    items = [[rnd.choice(words) for _ in range(rnd.randrange(2, 40))] for _ in range(12)]
    texts = []
    for _ in range(80):
        parts = [[rnd.choice(words) for _ in range(rnd.randrange(0, 30))]]
        for x in rnd.sample(items, 2):
            at = rnd.randrange(len(x))
            parts += [x[at:], [rnd.choice(words) for _ in range(rnd.randrange(0, 9))], x[: at if rnd.random() < 0.7 else 0]]
        texts.append([w for part in parts for w in part])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(5, " ".join(texts[5]))]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = sorted((r.doc_id, r["items"], round(r.max_coverage, 9)) for r in decontam.report(docs(spark, rows), bench, block_chars=300).collect())
    want = []
    for i, t in [*enumerate(texts), (5, texts[5])]:
        share = {k: brute.tiling(x, t, 3) / len(x) for k, x in enumerate(items)}
        hit = {k: v for k, v in share.items() if v >= 0.6 and len(items[k]) >= 3}
        want.append((i, ",".join(map(str, sorted(hit))), round(max(hit.values(), default=0.0), 9)))
    assert got == sorted(want)


@pytest.mark.parametrize("unfold", [1, 50, 1 << 21])
def test_coverage_with_a_phrase_in_every_item(monkeypatch, unfold):
    """Whatever number of matches is held at once, items and coverage are those of plain tiling."""
    import pyarrow as pa

    monkeypatch.setattr(decontam, "UNFOLD", unfold)
    rnd = random.Random(9)
    phrase = "this is a very common phrase of all items".split()
    items = [phrase * rnd.randrange(1, 3) + [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 20))] for _ in range(25)]
    texts = [phrase * 9, phrase + items[3][9:], [f"w{rnd.randrange(40)}" for _ in range(50)] + phrase * 2 + items[7], ["x"], []]
    block = decontam._Block([(i, " ".join(x)) for i, x in enumerate(items)], 3, 0.6)
    got = block.hits(kernels.Words(pa.array([" ".join(t) for t in texts])))
    for r, t in enumerate(texts):
        share = {i: brute.tiling(x, t, 3) / len(x) for i, x in enumerate(items)}
        assert sorted(got.get(r, [])) == sorted((i, s) for i, s in share.items() if s >= 0.6)


def test_decontamination(spark):
    item = "The quick brown fox jumps over the lazy dog while eleven old owls watch from a tree"
    w = item.split()
    rows = [(1, f"before {item.upper()} after"), (2, " ".join(w[9:] + ["and", "so"] + w[:9])), (3, " ".join(w[:6])), (4, "nothing of it here"), (5, None), (6, ""), (None, item), (7, "cut. " * 3000 + item)]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, ""), (14, item)], "item_id long, text string")
    for size in (decontam.BLOCK_CHARS, 60):
        got = {r.doc_id: (r.contaminated, r["items"], r.max_coverage) for r in decontam.report(docs(spark, rows), bench, block_chars=size).collect()}
        assert {i for i, v in got.items() if v[0]} == {1, 2, 7, None}
        assert got[1] == (True, "10,14", 1.0) and got[2][2] == 1.0 and got[4] == (False, "", 0.0)
        held = [len(b) for b, _ in decontam.blocks(bench, size)]
        assert sum(held) == 5 and (len(held) == 1) == (size > 60)
    # Whatever the number of blocks, one is in the plan: the others' results are read from files.
    plan = decontam.tiled(docs(spark, rows), bench, block_chars=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(list(decontam.blocks(bench, 10))) > 5
    clean = decontam.clean(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 6}
    assert decontam.report(docs(spark, rows), bench.limit(0)).filter("contaminated").isEmpty()
    assert decontam.report(docs(spark, []), bench).collect() == []
