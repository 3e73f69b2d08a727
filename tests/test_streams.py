"""Tail by offset, timers and stream joins: restarts, bounds and what is left in state."""

import json
import os

import pytest
import pandas as pd
from pyspark.sql import functions as F

from corvane.catalog import streams
from corvane.streaming import jobs, keyed, tail
from tests.conftest import SF

EVENT = "event_id bigint, what string"


def test_lines_keep_their_offsets(tmp_path):
    store = tail.fs.LocalFileSystem()
    data = b'{"a": 1}\n\n{"b": "\xc3\xa9"}\r\nnot json\n[1]\n{"c"'
    (tmp_path / "x").write_bytes(data)
    got = list(tail.lines_from(store, str(tmp_path / "x"), 0))
    assert [at for at, _ in got] == [9, 10, 23, 32, 36, len(data)]
    assert b"".join(line for _, line in got) == data.replace(b"\n", b"")
    assert [tail.event_of(line) for _, line in got] == ['{"a": 1}', None, '{"b": "é"}', None, None, None]
    assert list(tail.lines_from(store, str(tmp_path / "x"), 10, 23)) == got[2:3]
    assert list(tail.lines_from(store, str(tmp_path / "x"), len(data))) == []


def test_lines_longer_than_a_chunk(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 7)
    (tmp_path / "x").write_bytes(b"a" * 50 + b"\n" + b"b" * 3 + b"\n")
    assert list(tail.lines_from(tail.fs.LocalFileSystem(), str(tmp_path / "x"), 0)) == [(51, b"a" * 50), (55, b"bbb")]


def test_tail_is_capped_and_restarts(spark, tmp_path):
    folder, out = tmp_path / "log", str(tmp_path / "out")
    folder.mkdir()
    lines = [json.dumps({"event_id": i, "what": "é" * (i % 5)}) for i in range(230)]
    odd = [x for i, line in enumerate(lines) for x in ([line, "", "{broken", "[2]"] if i % 4 == 0 else [line])]
    sizes, seen = [], []

    def keep(df, batch):
        rows = df.collect()
        sizes.append(len(rows))
        seen.extend(r["event_id"] for r in rows)

    run = lambda: tail.drain(tail.tail_events(spark, str(folder), EVENT, limit=50), keep, out)
    (folder / "a.jsonl").write_text("\n".join(odd[:150]) + "\n", encoding="utf-8")
    run()
    first = len(seen)
    with open(folder / "a.jsonl", "a", encoding="utf-8") as f:
        f.write("\n".join(odd[150:200]) + "\n")
    run()
    (folder / "b.jsonl").write_text("\n".join(odd[200:]), encoding="utf-8")
    run()
    run()  # nothing new
    assert 0 < first < len(seen) and max(sizes) <= 50
    assert seen == list(range(230))


def test_tail_in_shares_reads_each_event_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    sizes, seen = [], [[], [], []]

    def keep(share):
        def each(df, batch):
            rows = df.collect()
            sizes.append(len(rows))
            seen[share].extend(r["event_id"] for r in rows)
        return each

    def run():
        tail.drain_all([(tail.tail_events(spark, str(folder), EVENT, 20, n, 3), keep(n), str(tmp_path / f"c{n}")) for n in range(3)])

    names = ["part-00000-a9", "part-00001-a9", "part-00002-a9", "part-00004-a9", "notes"]
    for n, name in enumerate(names):
        (folder / name).write_text("".join(json.dumps({"event_id": 100 * n + i, "what": ""}) + "\n" for i in range(50)))
    run()
    with open(folder / names[1], "a") as f:
        f.write(json.dumps({"event_id": 150, "what": ""}) + "\n")
    run()
    assert max(sizes) <= 20 and [len(s) >= 50 for s in seen] == [True] * 3
    assert sorted(sum(seen, [])) == sorted([*(100 * n + i for n in range(5) for i in range(50)), 150])
    for share in seen:  # a file's events stay in order, in one share
        for n in range(5):
            own = [x for x in share if x // 100 == n]
            assert own == sorted(own) and len(own) in (0, 50, 51)


def test_tails_go_on_after_a_failure(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for n in range(3):
        (folder / f"part-0000{n}").write_text("".join(json.dumps({"event_id": 100 * n + i, "what": ""}) + "\n" for i in range(30)))
    seen, failures = {}, []

    def keep(share):
        def each(df, batch):
            if share == 1 and batch == 1 and not failures:
                failures.append(batch)
                raise RuntimeError("a worker did not connect back")
            seen[share, batch] = [r["event_id"] for r in df.collect()]
        return each

    def run(each):
        tail.drain_all([(tail.tail_events(spark, str(folder), EVENT, 20, n, 3), each(n), str(tmp_path / f"{each.__name__}{n}")) for n in range(3)])

    run(keep)
    assert failures == [1]
    assert sorted(sum(seen.values(), [])) == sorted(100 * n + i for n in range(3) for i in range(30))

    def broken(share):
        def each(df, batch):
            failures.append(share)
            raise RuntimeError("for good")
        return each

    with pytest.raises(Exception, match="for good"):
        run(broken)
    assert failures.count(2) == tail.TRIES


def test_missing_folder_is_an_empty_tail(spark, tmp_path):
    seen = []
    tail.drain(tail.tail_events(spark, str(tmp_path / "none"), EVENT), lambda df, batch: seen.append(df.count()), str(tmp_path / "c"))
    assert sum(seen) == 0


def lots(spark, path, rows, job, mode, checkpoint):
    """One run for each lot of ``(user_id, event_id, event, seconds)``."""
    schema = "user_id bigint, event_id bigint, event string, ts timestamp"
    found = []
    with keyed.state_store(spark):
        for lot in rows:
            spark.createDataFrame(lot, "user_id bigint, event_id bigint, event string, s bigint").select(
                "user_id", "event_id", "event", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(path)
            query = job(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode(mode).foreachBatch(
                lambda df, b: found.append([tuple(r) for r in df.collect()])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
    return [r for batch in found for r in batch]


def state_keys(spark, checkpoint, name):
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return {r["k"] for r in state.select(F.col("key.user_id").alias("k")).collect()}


def test_budget_state_goes_with_its_window(spark, tmp_path):
    checkpoint = str(tmp_path / "c")
    job = lambda s: keyed.budget_stream(s, "user_id", "ts", limit=2, window=100, delay="10 seconds")
    rows = [[(1, 0, "x", 1000), (1, 1, "x", 1100), (1, 2, "x", 1101), (2, 3, "x", 1000)], [(1, 4, "x", 1150), (3, 5, "x", 1160)], [(3, 6, "x", 5000)]]
    got = lots(spark, str(tmp_path / "in"), rows, job, "update", checkpoint)
    last = {(u, start): (n, ok, no) for u, start, n, ok, no in got}
    assert last == {(1, 1000): (2, 2, 0), (1, 1101): (2, 2, 0), (2, 1000): (1, 1, 0), (3, 1160): (1, 1, 0), (3, 5000): (1, 1, 0)}
    assert state_keys(spark, checkpoint, "open") == {3}


def test_guard_entries_live_for_their_time(spark, tmp_path):
    checkpoint = str(tmp_path / "c")
    job = lambda s: keyed.expiring_guard(s, "user_id", "event_id", "ts", "event", ttl=100, delay="10 seconds")
    rows = [[(1, 0, "ask", 1000), (1, 1, "ask", 1100), (2, 2, "ask", 1000)], [(1, 3, "failed", 1150), (1, 4, "ask", 1160), (3, 5, "ask", 1160), (1, 6, "failed", 1170)], [(3, 7, "ask", 5000)]]
    got = {r[1]: r[2:] for r in lots(spark, str(tmp_path / "in"), rows, job, "append", checkpoint)}
    assert got == {0: ("started", 0), 1: ("pending", 0), 2: ("started", 0), 3: ("ignored", 0), 4: ("started", 0), 5: ("started", 0), 6: ("retry_counted", 1), 7: ("started", 0)}
    assert state_keys(spark, checkpoint, "entry") == {3}


def test_asks_wait_for_their_outcome(spark, tmp_path):
    def job(s):
        asks = s.filter("event = 'ask'").select(F.col("user_id").alias("key"), F.col("event_id").alias("ask_id"), F.col("ts").alias("asked_at"))
        done = s.filter("event <> 'ask'").select(F.col("user_id").alias("key"), F.col("event_id").alias("outcome_id"), F.col("event").alias("outcome"), F.col("ts").alias("done_at"))
        return keyed.asks_with_outcomes(asks, done, "100 SECONDS", "10 seconds")

    rows = [[(1, 0, "ask", 1000), (2, 1, "ask", 1000), (None, 2, "ask", 1000)], [(1, 3, "failed", 1050), (1, 4, "succeeded", 1060), (2, 5, "succeeded", 1101)], [(8, 6, "ask", 9000), (9, 7, "failed", 9000)]]
    got = lots(spark, str(tmp_path / "in"), rows, job, "append", str(tmp_path / "c"))
    joined = spark.createDataFrame(got, "key bigint, ask_id bigint, asked_at timestamp, outcome_id bigint, outcome string, done_at timestamp")
    assert {tuple(r) for r in keyed.settled(joined).collect()} == {(0, "ingest_failed", 3), (1, "pending", None), (2, "pending", None)}


def test_join_has_one_store_a_partition_and_replays_no_log(spark, tmp_path):
    def job(s):
        asks = s.filter("event = 'ask'").select(F.col("user_id").alias("key"), F.col("event_id").alias("ask_id"), F.col("ts").alias("asked_at"))
        done = s.filter("event <> 'ask'").select(F.col("user_id").alias("key"), F.col("event_id").alias("outcome_id"), F.col("event").alias("outcome"), F.col("ts").alias("done_at"))
        return keyed.asks_with_outcomes(asks, done, "100 SECONDS", "10 seconds")

    rows = [[(u, 10 * n + u, "ask" if u % 2 else "failed", 1000 + 60 * n) for u in range(10)] for n in range(4)]
    lots(spark, str(tmp_path / "in"), rows, job, "append", str(tmp_path / "c"))
    stores = [d for d, _, files in os.walk(tmp_path / "c" / "state") if any(f.endswith((".zip", ".changelog")) for f in files)]
    partitions = [p for p in os.listdir(tmp_path / "c" / "state" / "0") if p.isdigit()]
    assert stores and len(stores) <= len(partitions)
    assert not [f for _, _, files in os.walk(tmp_path / "c" / "state") for f in files if f.endswith(".changelog")]


@pytest.mark.parametrize("name", ["q_budget", "q_guard", "q_settled", "q_tail"])
def test_stream_queries_have_rows(spark, name):
    assert getattr(streams, name)(spark, SF).count() > 0 and os.path.exists(SF)


def test_index_log_is_folded_into_a_base(spark, tmp_path):
    table = jobs.IndexTable(spark, str(tmp_path / "t"), "doc_id bigint, text string", most_open=3)
    want = {}
    for n in range(8):
        rows = spark.createDataFrame([(n % 3, f"v{n}"), (100 + n, "x")], "doc_id bigint, text string")
        gone = spark.createDataFrame([(99 + n,)], "doc_id bigint")
        table.replace(rows, rows.select("doc_id").unionByName(gone), f"b{n}")
        want.update({n % 3: f"v{n}", 100 + n: "x"})
        want.pop(99 + n, None)
        assert len(table.open_versions()) <= 4
        assert {r["doc_id"]: r["text"] for r in table.read().collect()} == want
    table.replace(rows, rows.select("doc_id").unionByName(gone), "b7")  # a retry
    table.compact()
    assert len(table.open_versions()) == 1 and {r["doc_id"]: r["text"] for r in table.read().collect()} == want


class _Handle:
    """What a processor sees of Spark: one value and its timers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


def test_one_timer_for_what_is_left_open():
    budget, handle = keyed.BudgetProcessor("k", 2, 10), _Handle()
    budget.init(handle)
    out = pd.concat(budget.handleInputRows((1,), iter([pd.DataFrame({"second": [0, 5, 20, 40, 41, 42]})]), None))
    assert out["window_start"].tolist() == [0, 20, 40] and out["denied"].tolist() == [0, 0, 1]
    assert handle.timers == [51_000] and handle.value == (40, 3)
    list(budget.handleInputRows((1,), iter([pd.DataFrame({"second": [43]})]), None))
    assert handle.timers == [51_000] and handle.value == (40, 4)
    at = lambda ms: type("Info", (), {"getExpiryTimeInMs": lambda self: ms})()
    assert not list(budget.handleExpiredTimer((1,), None, at(11_000))) and handle.value == (40, 4)
    assert not list(budget.handleExpiredTimer((1,), None, at(51_000))) and handle.value is None

    guard, handle = keyed.GuardProcessor(("k", "n", "event"), 10), _Handle()
    guard.init(handle)
    rows = pd.DataFrame({"second": [0.0, 30.0, 60.0], "n": [1, 2, 3], "event": ["ask"] * 3})
    out = pd.concat(guard.handleInputRows((1,), iter([rows]), None))
    assert out["outcome"].tolist() == ["started"] * 3 and handle.timers == [71_000]
    assert not list(guard.handleExpiredTimer((1,), None, at(11_000))) and handle.value is not None
    assert not list(guard.handleExpiredTimer((1,), None, at(71_000))) and handle.value is None
