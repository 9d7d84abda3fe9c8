"""Paged tables, versioned stores, polls and live tasks against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from claimforge.operators import polling
from claimforge.sources import charsets, keyed, paged, versions
from claimforge.streaming import polling as streamed


def lines(path, name, *files):
    (path / name).mkdir(parents=True)
    for i, rows in enumerate(files):
        (path / name / f"part-{i}").write_text("".join(r if isinstance(r, str) else json.dumps({"fields": r} if r else {"id": 1}) + "\n" for r in rows))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_pages_follow_tokens(tmp_path, size):
    lines(tmp_path, "t", [{"a": 1}, {"a": 2}], [], [{"a": 3}, {"a": 4}, {"a": 5}], [])
    client, token, seen, calls = paged.LinePages(f"file://{tmp_path}"), None, [], 0
    while True:
        items, token = client.page("t", size, token)
        assert len(items) <= size
        seen, calls = seen + [x["fields"]["a"] for x in items], calls + 1
        if not token:
            break
    assert seen == [1, 2, 3, 4, 5] and calls == -(-5 // size)


def test_paged_scan(spark, tmp_path):
    lines(tmp_path, "good", [{"a": i} for i in range(250)], [{}, {"a": "x"}])
    lines(tmp_path, "broken", [{"a": i} for i in range(150)], ["{oops\n"])
    lines(tmp_path, "other", [{"a": 1}])
    lines(tmp_path, "empty", [])
    root = f"file://{tmp_path}"
    records, errors = paged.scan(spark, root)
    rows = records.orderBy("table_name", "seq").collect()
    assert [(r.table_name, r.seq) for r in rows] == [("good", i + 1) for i in range(251)] + [("other", 1)] and json.loads(rows[250].record_json) == {"a": "x"}
    assert [(r.table_name, r.error.split(":")[0]) for r in errors.collect()] == [("broken", "JSONDecodeError")]
    records, errors = paged.scan(spark, root, ["other", "none"])
    assert [r.table_name for r in records.collect()] == ["other"] and [r.table_name for r in errors.collect()] == ["none"]
    raw = paged.raw_scan(spark, root)
    assert raw.rdd.getNumPartitions() == 4 and raw.filter("table_name = 'other'").rdd.getNumPartitions() == 1
    assert raw.filter("table_name in ('other', 'good') and seq > 250").rdd.getNumPartitions() == 2
    (tmp_path / "nothing").mkdir()
    assert paged.scan(spark, f"{root}/nothing")[0].collect() == []


KIND = "k long, v string"


def stored_rows(spark, root, name="t"):
    return sorted(((r.k, r.v) for r in versions.read(spark, root, name, KIND).collect()), key=str)


def change(spark, rows, keys):
    return versions.Change(spark.createDataFrame(rows, KIND), spark.createDataFrame([(k,) for k in keys], "k long"), "k")


def test_children_are_replaced_in_one_step(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert stored_rows(spark, root) == []
    versions.commit(spark, root, {"t": change(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")], [1, 2, None]), "u": change(spark, [(1, "p")], [1])})
    before = stored_rows(spark, root)
    assert before == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    # A key without new children ends empty.
    versions.commit(spark, root, {"t": change(spark, [(3, "d")], [1, 3])}, writer="w", batch=4)
    assert stored_rows(spark, root) == [(2, "c"), (3, "d"), (None, "n")] and stored_rows(spark, root, "u") == [(1, "p")]
    # A batch that is played again changes nothing.
    assert versions.commit(spark, root, {"t": change(spark, [], [2, 3])}, writer="w", batch=4) == 2

    def crash():
        raise RuntimeError("between write and commit")

    with pytest.raises(RuntimeError):
        versions.commit(spark, root, {"t": change(spark, [], [2]), "u": change(spark, [], [1])}, writer="w", batch=5, before_commit=crash)
    assert stored_rows(spark, root) == [(2, "c"), (3, "d"), (None, "n")] and stored_rows(spark, root, "u") == [(1, "p")]
    # Of two writers from one state the second fails.
    with pytest.raises(Exception, match="exists"):
        versions.commit(spark, root, {"t": change(spark, [], [3])}, before_commit=lambda: versions.commit(spark, root, {"t": change(spark, [(9, "z")], [9])}))
    assert stored_rows(spark, root) == [(2, "c"), (3, "d"), (9, "z"), (None, "n")]
    assert versions.unused(spark, root) and stored_rows(spark, root) == [(2, "c"), (3, "d"), (9, "z"), (None, "n")] and versions.unused(spark, root) == []
    versions.commit(spark, root, {"t": change(spark, [], [2, 3, 9, None])}, writer="w", batch=5)
    assert stored_rows(spark, root) == [] and stored_rows(spark, root, "u") == [(1, "p")]


def test_comparisons_of_runs(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    run = "claim_compare_run_id long, run_id string, status string, started_at string, finished_at string"
    result = "run_id string, feature_id string"
    save = lambda runs, results, batch: versions.save_comparisons(spark, root, spark.createDataFrame(runs, run), spark.createDataFrame(results, result), "w", batch)
    save([(0, "r1", "running", "t0", None), (0, "r2", "running", "t0", None)], [("r1", "1A"), ("r1", "1B"), ("r2", "2A")], 1)
    ids = {r.run_id: r.id for r in versions.read(spark, root, "claim_compare_runs").collect()}
    save([(ids["r1"], "r1", "completed", "t9", "t2"), (0, "r2", "completed", "t9", "t3")], [("r2", "2B")], 2)
    save([(0, "r2", "error", "t9", "t9")], [], 2)
    runs = {r.run_id: (r.id, r.status, r.started_at, r.finished_at) for r in versions.read(spark, root, "claim_compare_runs").collect()}
    assert runs == {"r1": (ids["r1"], "completed", "t0", "t2"), "r2": (ids["r2"], "completed", "t0", "t3")}
    assert [(r.claim_compare_run_id, r.feature_id) for r in versions.read(spark, root, "claim_compare_results").collect()] == [(ids["r2"], "2B")]
    new = spark.createDataFrame([(ids["r1"], "x"), (5, "r2"), (None, "r9"), (None, None)], "claim_compare_run_id long, run_id string")
    assert [r.found_by for r in versions.resolved_runs(versions.read(spark, root, "claim_compare_runs"), new).orderBy("run_id").collect()] == ["inserted", "run_id", "inserted", "id"]


def test_patents_with_children(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    save = lambda ids, claims, figures: versions.save_patents(spark, root, spark.createDataFrame([(i, "t") for i in ids], "task_id string, title string"), spark.createDataFrame(claims, "task_id string, claim_id string"), spark.createDataFrame(figures, "task_id string, figure_id string"))
    save(["a", "b"], [("a", "1"), ("a", "2"), ("b", "1")], [("a", "f")])
    save(["a"], [("a", "9")], [])
    assert sorted(map(tuple, versions.read(spark, root, "patent_claims").collect())) == [("a", "9"), ("b", "1")]
    assert versions.read(spark, root, "patent_figures").collect() == [] and versions.read(spark, root, "patent_parse_records").count() == 2


def plain_ladder(polls, stored):
    """polls: (run, seq, ok, status) in order."""
    out, runs = [], {}
    for run, seq, ok, status in polls:
        s = runs.setdefault(run, {"n": 0, "last": None, "over": False})
        if s["over"]:
            continue
        if ok:
            s["n"] = 0
            if s["last"] != (status,):
                out.append((run, seq, "observed", status))
            s["last"] = (status,)
            s["over"] = status in ("completed", "error", "cancelled", "timeout")
            continue
        s["n"] += 1
        if s["n"] >= 5 and stored.get(run):
            out.append((run, seq, "stored", stored[run]))
            if stored[run] in ("completed", "error", "cancelled", "timeout"):
                s["over"] = True
                continue
        if s["n"] >= 12:
            out.append((run, seq, "failed", "error"))
            s["over"] = True
    return sorted(out)


def random_polls(seed):
    rnd, polls = random.Random(seed), []
    for run in range(12):
        ok, left = True, 0
        for seq in range(60):
            if not left:
                ok, left = rnd.random() < 0.5, rnd.choice([1, 2, 4, 5, 7, 12, 14])
            left -= 1
            # Statuses come back; terminal ones are rare.
            polls.append((run, seq, ok if rnd.random() < 0.97 else None, rnd.choice(["running", "running", "queued", None] * 9 + ["completed", "error"])))
    return polls, {0: "running", 1: "completed", 2: "", 3: None, 4: "timeout", 5: "running", 6: "error"}


POLL = "run_id long, seq long, ok boolean, status string"


def test_poll_ladder_equals_a_loop(spark):
    for seed in (1, 2):
        polls, stored = random_polls(seed)
        df = spark.createDataFrame(random.Random(0).sample(polls, len(polls)), POLL)
        kept = spark.createDataFrame(list(stored.items()), "run_id long, status string")
        got = polling.persisted(df, kept, order=("seq",), reported=("status",)).collect()
        assert sorted(map(tuple, got)) == plain_ladder(polls, stored)
        assert {r.action for r in got} == {"observed", "stored", "failed"}


def test_poll_stream_equals_batch(spark, tmp_path):
    """Polls come in three files; state goes from batch to batch, and a status that comes back is kept again."""
    polls, stored = random_polls(3)
    source = str(tmp_path / "in")
    for low in (0, 11, 37):
        high = {0: 11, 11: 37, 37: 60}[low]
        spark.createDataFrame([p for p in polls if low <= p[1] < high], POLL).coalesce(1).write.mode("append").parquet(source)
    kept = spark.createDataFrame(list(stored.items()), "run_id long, status string")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streamed.ROCKSDB)
    try:
        stream = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).parquet(source)
        out = streamed.persisted_polls(stream, kept, order=("seq",), reported=("status",))
        q = out.writeStream.format("memory").queryName("ladder").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(map(tuple, spark.table("ladder").collect())) == plain_ladder(polls, stored)


def test_live_status_equals_a_loop(spark):
    rnd = random.Random(4)
    events = [(rnd.randrange(4), i // 3, i, rnd.choice(["status", "beat", "read"]), rnd.choice(["queued", "running", "completed", "error"])) for i in range(300)]
    df = spark.createDataFrame(events, "run_id long, sec long, seq long, kind string, status string").withColumn("ts", F.timestamp_seconds("sec"))
    got = polling.live_status(df.filter("kind = 'read'"), df.filter("kind = 'status'"), df.filter("kind = 'beat'"), "4 SECONDS").collect()
    status, beat, want = {}, {}, []
    for run, sec, seq, kind, said in events:
        if kind == "status":
            status[run] = said
        elif kind == "beat":
            beat[run] = sec
        else:
            now = status.get(run)
            live = run in beat and beat[run] >= sec - 4
            want.append((seq, "running" if live and now in ("queued", "running") else now, now in ("completed", "error")))
    assert sorted((r.seq, r.status, r.is_finished) for r in got) == sorted(want)


def test_live_status_stream(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    said = [("a", "queued", at(5)), ("b", "queued", at(6)), ("a", "completed", at(7)), ("z", "queued", at(59))]
    spark.createDataFrame(said, "run_id string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("a", at(4)), ("a", at(3)), ("a", at(6)), ("b", at(1)), ("y", at(59))], "run_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "b"))
    read = lambda x: spark.readStream.schema(spark.read.parquet(str(tmp_path / x)).schema).parquet(str(tmp_path / x))
    q = streamed.live_status(read("s"), read("b"), "3 MINUTES", "1 MINUTE").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert sorted((r.run_id, r.status) for r in spark.table("live").collect() if r.run_id != "z") == [("a", "completed"), ("a", "running"), ("b", "queued")]


def test_upsert_stream_applies_a_batch_once(spark, tmp_path):
    root, source, state = f"file://{tmp_path}/s", str(tmp_path / "in"), str(tmp_path / "c")
    kind = "run_id string, seq long, status string, started_at string, finished_at string"
    batches = [[("r", 1, "queued", None, None), ("r", 2, "running", "t1", None), ("s", 3, "running", "t2", None)], [("r", 4, "completed", "t9", "t5"), ("q", 6, "queued", None, None)], [("r", 7, None, "t8", None)]]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        assert streamed.upsert_stream(spark.readStream.schema(kind).parquet(source), root, "runs", state).awaitTermination(120)
    want = [("q", "queued", None, None), ("r", "completed", "t1", None), ("s", "running", "t2", None)]
    got = lambda: sorted(tuple(r) for r in versions.read(spark, root, "runs").select("run_id", "status", "started_at", "finished_at").collect())
    assert got() == want
    version = versions.state(spark, root)["version"]
    merge = streamed.merger(root, "runs", state, "run_id", "seq", ("started_at",), ("finished_at",))
    merge(spark.createDataFrame(batches[1], kind), 1)
    assert got() == want and versions.state(spark, root)["version"] == version


ZH, TW, JA = "本发明涉及一种用于清洁地面的机器人，其特征在于包括底盘。", "本發明涉及一種用於清潔地面的機器人，其特徵在於包括底盤。", "本発明は床を掃除するロボットに関する。カメラを備える。"


@pytest.mark.parametrize("text, encodings", [(ZH, ("utf-8", "utf-16-le", "utf-16-be", "gb18030")), (TW, ("utf-8", "utf-16-le", "big5")), (JA, ("utf-8", "utf-16-be", "shift_jis")), ("été à la forêt, où garçon naïf " * 3, ("utf-8", "utf-16-le", "gb18030")), ("plain ASCII", ("utf-8", "utf-16-le", "utf-16-be")), ("a\t" + ZH + "\r\nEnd", ("gb18030",)), ("x" + TW * 4000, ("big5",))])
def test_charsets(text, encodings):
    for e in encodings:
        assert charsets.detected(text.encode(e)) == (e, text, None)
    for mark, e in charsets.MARKS:
        assert charsets.detected(mark + text.encode(e)) == (e, text, None)


def test_charset_of_odd_bytes(spark, tmp_path):
    assert charsets.detected(None) == (None, None, None) and charsets.detected(b"") == ("utf-8", "", None)
    for data in (b"\xff\xfe\x00", b"\x00", b"\x00\x00", b"\xff\x81\xff", b"\xef\xbb\xbf\xff"):
        assert charsets.detected(data) == (None, None, charsets.UNDECIDED)
    (tmp_path / "a.txt").write_bytes(ZH.encode("gb18030"))
    (tmp_path / "b.txt").write_bytes(b"\xff\x81\xff")
    rows = {r.path[-5:]: (r.charset, r.raw_text, r.read_error) for r in charsets.texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows == {"a.txt": ("gb18030", ZH, None), "b.txt": (None, None, charsets.UNDECIDED)}


def test_keyed_tables_join_without_shuffle(spark, tmp_path):
    keyed.store(spark.range(1000).withColumn("v", F.col("id") * 2), "kt_parents", "id", f"file://{tmp_path}/p", 8)
    keyed.store(spark.range(3000).select((F.col("id") % 1000).alias("id"), F.col("id").alias("c")), "kt_children", "id", f"file://{tmp_path}/c", 8)
    every = keyed.with_children(spark, "kt_parents", "kt_children", "id")
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and every.count() == 3000
    few = keyed.found(spark, "kt_parents", "id", [7])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan and "In(id, [7])" in plan or "EqualTo(id,7)" in plan
    assert [r.v for r in few.collect()] == [14] and keyed.with_children(spark, "kt_parents", "kt_children", "id", [7, 8]).count() == 6
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next((tmp_path / "p").glob("part-*"))).metadata
    assert meta.num_rows < 1000
