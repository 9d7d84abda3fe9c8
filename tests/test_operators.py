"""Order-aware operators against plain folds, sources, sinks and streams on small tables."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimforge.operators import dedup, lifecycle, lookup, report, verdict
from claimforge.sources import files, schemas, sinks
from claimforge.streaming import runs


def test_keyword_dedup_golden(spark):
    rows = [("r", 1, "A b", 0.5), ("r", 2, "ab", 0.9), ("r", 3, "c", 0.1), ("r", 4, "AB", 0.9), ("r", 5, " ", 1.0), ("r", 6, None, 1.0)]
    df = spark.createDataFrame(rows, "run string, seq int, keyword_text string, confidence_score double")
    assert [(r.seq, r.keyword_text, r.confidence_score) for r in dedup.keywords(df, "run").orderBy("seq").collect()] == [(1, "ab", 0.9), (3, "c", 0.1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "A", "a ", "b", "（b）", "c—d", "c-d"]), st.one_of(st.none(), st.sampled_from([0.0, 0.3, 0.7]))), max_size=12))
def test_keyword_dedup_equals_a_loop(spark, items):
    df = spark.createDataFrame([("r", i, k, c) for i, (k, c) in enumerate(items)], "run string, seq int, keyword_text string, confidence_score double")
    best = {}
    for i, (k, c) in enumerate(items):
        norm = k.strip().lower().replace("（", "").replace("）", "").replace("—", "-").replace(" ", "")
        if norm not in best:
            best[norm] = [i, k.strip(), c]
        elif (c or 0) > (best[norm][2] or 0):
            best[norm][1:] = [k.strip(), c]
    once = dedup.keywords(df, "run")
    assert sorted((r.seq, r.keyword_text, r.confidence_score) for r in once.collect()) == sorted(map(tuple, best.values()))
    assert dedup.keywords(once, "run").count() == len(best)


def test_product_merge(spark):
    blank = dict.fromkeys(("product_id", "product_name", "product_url", "product_source", "price", "brand", "manufacturer", "description", "matched_keywords"), "")
    rows = [blank | {"seq": 1, "run": "r", "product_url": "u", "product_name": "n", "matched_keywords": "k1"}, blank | {"seq": 2, "run": "r", "product_url": "u", "brand": "b", "matched_keywords": "k2, k1", "product_id": "9"}, blank | {"seq": 3, "run": "r", "product_name": "n"}]
    got = dedup.products(spark.createDataFrame(rows), "run").orderBy("seq").collect()
    assert [(r.key, r.product_name, r.brand, r.matched_keywords, r.product_id) for r in got] == [("url::u", "n", "b", "k1, k2", ""), ("name::n::", "n", "", "", "")]


def test_product_key_keeps_case_and_fills_pictures(spark):
    kind = "run string, seq int, product_id string, product_name string, product_url string, product_source string, price string, brand string, manufacturer string, description string, matched_keywords string, picture array<string>, raw_payload string"
    rows = [("r", 1, "", "Foo", "", "s", "", "", "", "", "a, b", [], None), ("r", 2, "", "foo", "", "s", "", "", "", "", "a", None, "{}"), ("r", 3, "", "Foo", "", "s", "", "", "", "", "c,b", ["p"], "{1}"), (None, 4, "", "x", "", "", "", "", "", "", None, None, None)]
    got = {(r.run, r.key): (r.picture, r.raw_payload, r.matched_keywords) for r in dedup.products(spark.createDataFrame(rows, kind), "run").collect()}
    assert got == {("r", "name::Foo::s"): (["p"], "{1}", "a, b, c"), ("r", "name::foo::s"): (None, "{}", "a"), (None, "name::x::"): (None, None, "")}


def test_nested_rows_from_payloads(spark):
    """Rows without id and name are products of their own, numbered by the products so far."""
    kind = "run_id string, seq int, product_id string, product_name string, feature_id string, reason string, raw_payload string"
    rows = [("r", 1, "5", "n", "f1", None, '{"reason": "why", "feature_id": "no"}'), ("r", 2, None, " ", "f2", None, None), ("r", 3, "5", "other", "f3", "own", '{"reason": "x"}'), ("r", 4, "", "", "f4", None, "broken"), ("r", 5, "", "name", "f5", None, None)]
    got = [(r.product_key, r.product_id, r.product_name, [(f.feature_id, f.reason) for f in r.features]) for r in verdict.nested(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got) == [("5", "5", "n", [("f1", "why"), ("f3", "own")]), ("name", "name", "name", [("f5", None)]), ("product_2", "product_2", "product_2", [("f2", None)]), ("product_3", "product_3", "product_3", [("f4", None)])]


@pytest.mark.parametrize("message, summary, run, want", [("m", "失败", 1, "m"), (None, "比对失败", 5, "比对失败"), (None, "无比对结果", None, "无比对结果"), (None, "ok", 5, None), (None, "ok", 0, "ok"), (None, " ", 0, None), (None, None, 0, None), (None, "cancelled", 3, None)])
def test_exception_message(spark, message, summary, run, want):
    df = spark.createDataFrame([(message, summary, run)], "m string, s string, r int")
    assert df.select(lifecycle.exception_message(F.col("m"), F.col("s"), F.col("r")).alias("v")).first().v == want


@pytest.mark.parametrize("results, want", [(["MATCH", "MATCH"], "infringement_likely"), (["NO_MATCH", "x"], "no_infringement"), (["MATCH", "NO_MATCH"], "uncertain"), (["x"], "uncertain")])
def test_flat_verdict(spark, results, want):
    df = spark.createDataFrame([("p", r) for r in results], "product_id string, comparison_result string")
    assert verdict.flat(verdict.with_status(df)).first().verdict == want


def test_claim_verdict(spark):
    rows = [("a", "1", "MATCH"), ("a", "2", "NO_MATCH"), ("b", "1", "NO_MATCH"), ("b", None, "NO_MATCH"), ("c", "1", "NO_MATCH"), ("c", "2", "x")]
    df = verdict.with_status(spark.createDataFrame(rows, "product_id string, claim_id string, comparison_result string"))
    assert {r.product_id: r.verdict for r in verdict.by_claim(df).collect()} == {"a": "infringement_likely", "b": "no_infringement", "c": "uncertain"}


def test_nested_flat_and_mixed_input(spark):
    kind = "run_id string, product_id string, product_name string, features array<struct<feature_text:string,comparison_result:string>>"
    nested = spark.createDataFrame([("r", "5", "n", [("f1", "MATCH"), ("f2", "匹配")]), ("r", "6", "m", [("f1", "NO_MATCH"), ("f2", "MATCH")])], kind)
    flat = spark.createDataFrame([("r", "9", "x", "e1", "不同")], "run_id string, product_id string, product_name string, claim_element string, status string")
    both = verdict.uniform(nested, flat).groupBy("product_key").agg(F.count("*").alias("n")).collect()
    assert {r.product_key: r.n for r in both} == {"5": 2, "6": 2, "9": 1}
    got = verdict.flat(verdict.uniform(nested, flat), "product_key").collect()
    assert {r.product_key: r.verdict for r in got} == {"5": "infringement_likely", "6": "uncertain", "9": "no_infringement"}
    assert verdict.uniform(nested.limit(0), flat.limit(0)).count() == 0
    rows = spark.createDataFrame([("r", 2, "5", "n", "b"), ("r", 1, "5", "n", "a"), ("r", 3, "", "", "c")], "run_id string, seq int, product_id string, product_name string, feature_text string")
    packed = {r.product_key: [f.feature_text for f in r.features] for r in verdict.nested(rows).collect()}
    assert packed == {"5": ["a", "b"], "product_2": ["c"]}


def test_confirmation(spark):
    requests = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", ["x"])], "session_id string, auto_keywords array<string>").withColumn("requested_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    actions = spark.createDataFrame([("a", "confirm", ["y", "x"]), ("b", "editing", None)], "session_id string, action string, keywords array<string>").withColumn("ts", F.lit("2024-01-01 00:00:05").cast("timestamp"))
    got = {r.session_id: (r.state, r.keywords) for r in lifecycle.confirmed(requests, actions, F.lit("2024-01-01 00:01:00").cast("timestamp")).collect()}
    assert got == {"a": ("confirmed", ["x", "y"]), "b": ("waiting_input", ["x"]), "c": ("auto_confirmed", ["x"])}


def test_results_merge_and_report_limits(spark):
    df = spark.createDataFrame([("s", 1, {"a": "1", "b": "2"}), ("s", 2, {"a": "3", "b": None})], "session_id string, seq int, results map<string,string>")
    assert lifecycle.merged_results(df).first().results == {"a": "3", "b": "2"}
    long = spark.createDataFrame([("x" * 9000, "y" * 9000)], "message string, stack string")
    assert [len(v) for v in lifecycle.error_reports(long).first()] == [4000, 8000]


def test_lookup_helpers(spark):
    users = spark.createDataFrame([(1, "a", "e"), (2, "b", "f")], "id long, name string, email string")
    assert lookup.with_users(spark.createDataFrame([(1,), (3,)], "user_id long"), users, "user_id", "left").filter("user_name is null").count() == 1
    names = spark.createDataFrame([("张",), ("李",), ("阿",)], "product_name string")
    assert [r.product_name for r in names.orderBy(lookup.by_local_name()).collect()] == ["阿", "李", "张"]
    df = spark.createDataFrame([(1, ["u1", "u2"]), (2, ["u9"])], "id long, evidence_images array<string>")
    paths = spark.createDataFrame([("u2", "p2")], "url string, path string")
    assert {r.id: r.evidence_images for r in lookup.local_images(df, paths, "id").collect()} == {1: ["p2"], 2: ["u9"]}
    claims = spark.createDataFrame([(1, 7, "x")], "record_id long, id long, t string")
    nest = lookup.nested_records(spark.createDataFrame([(1,), (2,)], "record_id long"), claims, claims).orderBy("record_id").collect()
    assert len(nest[0].claims) == 1 and nest[1].claims is None
    assert [r.letter for r in lookup.numbered(claims, ["record_id"], [F.col("id")]).collect()] == ["A"]


def test_chart_pages_escape(spark):
    products = spark.createDataFrame([(1, "<n>")], "product_id long, product_name string")
    rows = spark.createDataFrame([(1, 1, "1A", "1", "a<b", "e", "matching", "r", "t")], "product_id long, seq int, feature_id string, claim_id string, feature_text string, evidence string, status string, reason string, reasoning_type string")
    page = report.chart_pages(products, rows).first().value
    assert "a&lt;b" in page and "&lt;n&gt;" in page and "r | t" in page


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("字" * 120)
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    raw = {r.path.rsplit("/", 1)[-1]: r for r in files.raw_text(files.binary_files(spark, str(tmp_path))).collect()}
    assert raw["a.txt"].raw_text == "字" * 120 and raw["b.bin"].read_error == "NOT_UTF8"
    assert files.whole_texts(spark, str(tmp_path / "a.txt")).count() == 1
    df = spark.createDataFrame([("x" * 60, "[FileOps Error]" + "e" * 60)], "a string, b string")
    assert df.select(files.first_usable(F.col("b"), F.col("a")).alias("v")).first().v == "x" * 60
    up = spark.createDataFrame([("a b.pdf", "x/y", 5), ("c.exe", "x/y", 5), ("d", "text/plain", 60 << 20)], "name string, mime string, length long")
    assert [r.safe_name for r in files.uploads(up).collect()] == ["a_b.pdf"]
    assert files.table(spark, "users").columns[:2] == ["id", "name"]
    assert files.table_kind("产品表", []) == "products" and files.table_kind("t", ["商品", "claim"]) == "comparisons" and files.table_kind("侵权", ["商品"]) == "comparisons" and files.table_kind("t", ["x"]) is None
    assert files.sniffed({"商品": ["名称", "匹配状态"], "x": ["y"]}) == {"products": "商品", "comparisons": "商品"} and files.sniffed({"a": ["x"]}) == {} and files.find_table(["a", "Bc"], "b") == "Bc"
    assert df.select(files.file_format(F.lit("http://x/y?file=z.DOCX"), F.lit("document")).alias("v")).first().v == "docx"


def test_sinks(spark, tmp_path):
    stored = spark.createDataFrame([("r", "queued", "t0", None)], "run_id string, status string, started_at string, finished_at string")
    new = spark.createDataFrame([("r", "error", "t1", "t2"), ("s", "queued", "t3", None)], stored.schema)
    assert {tuple(r) for r in sinks.upserted(stored, new, ["run_id"]).collect()} == {("r", "error", "t0", "t2"), ("s", "queued", "t3", None)}
    assert sinks.new_rows(new, stored, "run_id").count() == 1
    made = sinks.figure_files(spark.createDataFrame([("t", "图 1.png", bytearray(b"x"))], "task_id string, name string, content binary"), "http://h").first()
    assert made.safe_name == "__1.png" and made.file_size == 1
    assert schemas.conform(spark.createDataFrame([("7",)], "id string"), "patent_claims").first().id == 7


def test_streams(spark, tmp_path):
    events = [("s", "running", f"2024-01-01 00:00:{i:02d}") for i in range(3)] + [("s", "completed", "2024-01-01 00:01:00"), ("t", "running", "2024-01-01 00:00:09")]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(events, "session_id string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("event_type", F.col("status"))
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    for name, out, mode in (("fold", runs.lifecycle(stream, ["session_id"]), "complete"), ("once", runs.once_per_run(stream, ["session_id"]), "append"), ("win", runs.windowed(stream), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {(r.session_id, r.status, r.n_events) for r in spark.table("fold").collect()} == {("s", "completed", 4), ("t", "running", 1)}
    assert spark.table("once").count() == 3
    assert sum(r.n for r in spark.table("win").collect()) == 5
    asked = spark.createDataFrame([("a", "request", 1), ("a", "confirm", 2)], "session_id string, action string, ts int")
    asked.write.parquet(str(tmp_path / "ask"))
    q = runs.confirmations(spark.readStream.schema(asked.schema).parquet(str(tmp_path / "ask"))).writeStream.format("memory").queryName("conf").option("checkpointLocation", str(tmp_path / "conf")).start()
    for _ in range(120):  # timers keep such a query from ending by itself
        if spark.table("conf").count():
            break
        time.sleep(0.5)
    q.stop()
    assert [(r.session_id, r.state) for r in spark.table("conf").collect()] == [("a", "confirmed")]


def test_gaps_in_random_statuses(spark):
    rnd = random.Random(1)
    events = [("k", rnd.choice("ab"), i) for i in range(50)]
    df = spark.createDataFrame(events, "k string, status string, ts int")
    want = [i for i, e in enumerate(events) if i == 0 or e[1] != events[i - 1][1]]
    assert sorted(r.ts for r in lifecycle.changes(df, ["k"]).collect()) == want


def test_restarted_stream_goes_on(spark, tmp_path):
    """A second run with the same checkpoint reads only what is new."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema("session_id string, status string").json(source)
    for n, rows in enumerate(([("a", "running")], [("b", "running"), ("a", "completed")])):
        spark.createDataFrame(rows, "session_id string, status string").coalesce(1).write.mode("append").json(source)
        runs.persisted(stream(), out, state).awaitTermination(60)
        assert spark.read.parquet(out).count() == (1, 3)[n]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_rows_of_hot_keys_are_numbered_by_ranges(spark, coalesce):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 > 0, (F.col("id") % 50).cast("string"))
    rows = spark.range(5000).select("id", key.alias("k"), F.struct(F.xxhash64("id").alias("h"), "id").alias("o"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = lookup.numbered_apart(rows, ["k"], ["o"], "n")
        want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o")))
        assert got.columns == want.columns and got.count() == 5000 and got.exceptAll(want).isEmpty()
        assert lookup.numbered_apart(rows.limit(0), ["k"], ["o"], "n").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_products_without_a_name_among_others(spark):
    rows = [("r", 1, "5", "", "a"), ("r", 2, "", " ", "b"), ("r", 3, "5", "", "c"), ("r", 4, None, "n", "d"), ("r", 5, None, None, "e"), ("r", 5, None, None, "f"), ("s", 1, None, None, "g"), (None, 1, "", "", "h")]
    got = verdict.nested(spark.createDataFrame(rows, "run_id string, seq int, product_id string, product_name string, feature_id string")).collect()
    assert {(r.run_id, r.product_key): [f.feature_id for f in r.features] for r in got} == {("r", "5"): ["a", "c"], ("r", "product_2"): ["b"], ("r", "n"): ["d"], ("r", "product_5"): ["e", "f"], ("s", "product_1"): ["g"], (None, "product_1"): ["h"]}


def test_grid_of_one_patent_is_shared_and_small_on_disk(spark, tmp_path):
    """One patent's rows are made by several tasks, and take less than a byte each as files."""
    products = spark.createDataFrame([(7, i * 1_000_003) for i in range(1000)] + [(8, 1), (None, 2)], "patent_id int, product_id long")
    features = spark.createDataFrame([(7, i * 1_000_033) for i in range(1000)] + [(9, 1), (None, 2)], "patent_id int, feature_id long")
    verdict.grid(products, features).write.parquet(str(tmp_path / "grid"))
    got = spark.read.parquet(str(tmp_path / "grid"))
    assert got.columns == ["patent_id", "product_id", "feature_id"]
    assert got.count() == got.distinct().count() == 1_000_000 and got.filter("patent_id <> 7 or product_id % 1000003 <> 0 or feature_id % 1000033 <> 0").isEmpty()
    files = list((tmp_path / "grid").glob("*.parquet"))
    assert len(files) > 1 and sum(f.stat().st_size for f in files) < 1_000_000
