"""Keyed streaming state and the message queue: order of arrival, restarts, what is forgotten."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_streaming import at, batches, collected, record, stateful_rules
from vigilake.operators.detect import RuleSet
from vigilake.operators.stateful import event_time
from vigilake.plans import modes, queries_streaming
from vigilake.rules.model import FirstSeen, Threshold
from vigilake.sources import queue
from vigilake.sources.scratch import Scratch
from vigilake.streaming import detection, in_order, stateful
from vigilake.streaming.rule_state import RuleState


def crossings(rows, window, count):
    want, seen = set(), {}
    for k, t, i in sorted(rows):
        seen[k] = [x for x in seen.get(k, []) if x >= t - window] + [t]
        if len(seen[k]) == count:
            want.add(i)
    return want


def openings(rows, period):
    out, created = [], {}
    for k, t, i in sorted(rows):
        new = k not in created or created[k] < t - period
        created[k] = t if new else created[k]
        out.append((i, created[k], new))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_equal_simulations_and_state_is_small(seed):
    rng = random.Random(seed)
    rows = sorted((rng.choice("abc"), rng.randrange(500), f"{i:04}") for i in range(900))
    for window, count in ((5, 1), (5, 3), (40, 12), (0, 2)):
        fold, memory, got = in_order.Crossing((window, count)), {}, set()
        for k, t, i in rows:
            memory[k], out = fold.step((k,), memory.get(k), t)
            assert len(memory[k][0]) <= count + 1
            got |= {i} if out is not None else set()
        assert got == crossings(rows, window, count)
    fold, memory, got = in_order.Alerting(30), {}, []
    for k, t, i in rows:
        memory[k], out = fold.step((k,), memory.get(k), t)
        got.append((i, *out))
    assert sorted(got) == sorted(openings(rows, 30))


def shuffled_batches(rng, rows, jitter, parts):
    """Rows in micro-batches, each up to ``jitter`` later than its turn."""
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(jitter))
    step = len(order) // parts + 1
    return [order[k : k + step] for k in range(0, len(order), step)]


def start(df, name, checkpoint):
    with in_order.rocksdb(df.sparkSession):
        return df.writeStream.format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()


def test_shuffled_micro_batches_and_restarts_equal_a_simulation(spark, tmp_path):
    """The stream is stopped and started again behind each micro-batch; at the end all state has gone."""
    rng = random.Random(11)
    rows = [(rng.choice("abcd"), rng.randrange(600), f"{i:04}") for i in range(300)]
    parts = [*shuffled_batches(rng, rows, 40, 4), [("end", 5000, "end")], [("end", 9000, "end2")]]
    folder, base = tmp_path / "in", datetime(2024, 1, 1, tzinfo=UTC)
    folder.mkdir()
    sizes = []
    for n, part in enumerate(parts):
        text = "\n".join(json.dumps({"k": k, "i": i, "t": (base + timedelta(seconds=t)).isoformat()}) for k, t, i in part)
        (folder / f"{n}.json").write_text(text)
        s = spark.readStream.schema("k string, i string, t timestamp").json(str(folder))
        q = start(stateful.threshold_crossed(s, "k", "t", 20_000_000, 3, "i", late="120 seconds"), f"s{n}", str(tmp_path / "cp"))
        q.awaitTermination()
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    got = [r.event_id for r in spark.read.parquet(str(tmp_path / "cp-out")).collect()]
    assert sorted(got) == sorted(crossings([(k, t * 1_000_000, i) for k, t, i in rows], 20_000_000, 3))
    assert max(sizes) >= 8 and sizes[-1] <= 2, sizes  # rows of state: a list and a memory for each key


def test_many_keys_are_a_bounded_number_of_calls_and_timers(spark, tmp_path):
    """Of 3,000 keys in two micro-batches, each seen twice; the state's values don't grow with the keys."""
    groups = in_order.GROUPS
    parts = [[{"k": f"k{i}" if i else None, "eventID": f"{n}", "eventTime": at(n)} for i in range(3000)] for n in (1, 0)]
    df = batches(spark, tmp_path, [*parts, [{"k": "end", "eventID": "end", "eventTime": at(5000)}]], "eventID string, k string, eventTime timestamp")
    q = start(stateful.first_seen(df, "k", ts="eventTime", tie="eventID", late="10 minutes", keep_us=60 * 60_000_000), "many", str(tmp_path / "cp"))
    q.awaitTermination()
    got = [(r.k, r.eventID) for r in spark.read.parquet(str(tmp_path / "cp-out")).collect()]
    assert sorted(got, key=str) == sorted(((f"k{i}" if i else None, "0") for i in range(3000)), key=str)
    seen = [p.stateOperators[0] for p in q.recentProgress]
    assert max(s.numRowsTotal for s in seen) <= groups and max(s.customMetrics["numRegisteredTimers"] for s in seen) <= groups
    assert seen[-1].numRowsTotal <= 1


def test_rows_of_a_group_reach_its_state_as_one_piece_of_each_task(spark, tmp_path, monkeypatch):
    """Spark takes what it hands to the processor apart row by row."""
    counted = str(tmp_path / "counted")

    class Counting(in_order._Processor):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            frames = list(rows)
            with open(counted, "a") as f:
                f.write(f"{sum(map(len, frames))}\n")
            yield from super().handleInputRows(key, iter(frames), timerValues)

    monkeypatch.setattr(in_order, "_Processor", Counting)
    rows = [(f"k{i % 40}", i % 600, f"{i:05}") for i in range(6000)]
    parts = [[{"k": k, "eventID": i, "eventTime": at(t)} for k, t, i in rows], [{"k": "end", "eventID": "end", "eventTime": at(5000)}]]
    df = batches(spark, tmp_path, parts, "eventID string, k string, eventTime timestamp")
    start(stateful.threshold_crossed(df, "k", "eventTime", 20 * 60_000_000, 3, late="1 day"), "pieces", str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "cp-out")).collect()) == sorted(crossings(rows, 20, 3))
    assert 2 <= sum(map(int, open(counted))) <= 41


def test_memories_of_a_group_are_read_at_once_and_written_once():
    """Each request to the store costs as much as some hundred rows."""

    class Store:
        def __init__(self):
            self.held, self.asked = {}, []

        def __getattr__(self, name):
            self.asked.append(name)
            return {"iterator": lambda: iter(self.held.items()), "getValue": self.held.get, "updateValue": self.held.__setitem__, "removeKey": self.held.pop, "exists": lambda: bool(self.held)}[name]

    class Value:
        update = clear = lambda self, *_: None

    worker = in_order._Processor(in_order.Alerting(100), ["k", "at", "body", "created", "is_new_alert"])
    worker.memory, worker.forget = Store(), Value()
    rows = [(f'["k{i % 200}"]', i, "", f"{i}") for i in range(1000)]
    got = []
    for part in (rows[:400], rows[400:700], rows[700:]):
        held = in_order._Held(worker.memory)
        due = pa.Table.from_pylist([dict(zip(in_order._ROWS.names, r, strict=True)) for r in part], in_order._ROWS).sort_by([(n, "ascending") for n in in_order._ROWS.names])
        got += worker._folded(due, held)[0]
        worker._forgotten(part[-1][1] - 50, held)
        worker.memory.asked.clear()
        held.write()
        assert len(worker.memory.asked) <= in_order.SLOTS
    assert sorted((body, created, new) for _, _, body, created, new in got) == sorted(openings([(k, t, i) for k, t, _, i in rows], 100))
    worker.memory.asked.clear()
    held = in_order._Held(worker.memory)
    worker._folded(due, held)
    worker._forgotten(10**9, held)
    held.write()
    assert worker.memory.asked.count("iterator") == 1 and not {"getValue", "updateValue"} & set(worker.memory.asked)
    assert worker.memory.held == {}


def test_pieces_hold_all_rows_of_a_group_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(in_order, "_PACK_ROWS", 100)
    rng = random.Random(5)
    rows = [(rng.randrange(7), f"k{rng.randrange(50)}", rng.randrange(10**6), f"{i}", None if i % 9 == 0 else "b" * (i % 5)) for i in range(1000)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("_group", "key", "at", "tie", "body"), r, strict=True)) for r in rows[k : k + 30]], pa.schema([("_group", pa.int64()), *in_order._ROWS])) for k in range(0, 1000, 30)]
    got, pieces = [], [p for b in in_order._pieces(iter([*batches, batches[0].slice(0, 0)])) for p in b.to_pylist()]
    for p in pieces:
        held = pa.ipc.open_stream(p["rows"]).read_all().to_pylist()
        assert 0 < len(held) <= 120 and p["first"] == min(r["at"] for r in held) and p["_ts"].timestamp() * 1e6 == pytest.approx(max(r["at"] for r in held))
        got += [(p["_group"], *r.values()) for r in held]
    assert sorted(got, key=str) == sorted(rows, key=str) and len(pieces) == 7 * 9
    assert list(in_order._pieces(iter([]))) == []


def test_late_rows_are_dropped_though_they_share_a_piece_with_others(spark, tmp_path):
    """Of a key that is remembered, a row behind what has been folded would come out of order."""
    row = lambda k, i, t: {"k": k, "eventID": i, "eventTime": at(t)}
    parts = [[row("x", "a", 100), row("x", "b", 300)], [row("x", "c", 310)], [row("x", "late", 0), row("x", "d", 305), row("x", "e", 320)], [row("x", "gone", 1)], [row("x", "end", 9000)]]
    df = batches(spark, tmp_path, parts, "eventID string, k string, eventTime timestamp").coalesce(1)
    q = start(stateful.threshold_crossed(df, "k", "eventTime", 6 * 60 * 60_000_000, 5, late="10 minutes"), "late", str(tmp_path / "cp"))
    q.awaitTermination()
    # a, b, d, c, e: with "late" or "gone" among them the fifth would be another
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "cp-out")).collect()] == ["e"]
    assert q.recentProgress[3].stateOperators[0].numRowsDroppedByWatermark == 1


def test_rules_of_all_kinds_are_one_keyed_state(spark, tmp_path):
    """Each further one would read the micro-batch and evaluate the rules again; keys to be kept for ever lie beside those to be forgotten."""
    one = [{"log_type": "Own", "eventID": f"{t:03}", "eventTime": at(t), "payload": json.dumps({"kind": kind, "who": who})} for kind, who, t in (("few", "a", 0), ("few", "a", 1), ("new", "a", 2), ("few", "a", 700), ("new", "a", 701), ("new", "b", 702))]
    two = [{"log_type": "Own", "eventID": f"{t:04}", "eventTime": at(t), "payload": json.dumps({"kind": kind, "who": who})} for kind, who, t in (("end", "z", 9000), ("new", "a", 8000), ("few", "a", 8001))]
    end = [{"log_type": "Own", "eventID": "end", "eventTime": at(20000), "payload": json.dumps({"kind": "end"})}]
    df = batches(spark, tmp_path, [one, two, end], "log_type string, eventID string, eventTime timestamp, payload string").withColumn("payload", F.parse_json("payload"))
    own = lambda e: [e.rule("few", e.eq("kind", "few"), state=Threshold(e.s("who"), 600, 2)), e.rule("new", e.eq("kind", "new"), state=FirstSeen(e.s("who")))]
    q = start(detection.matches(df, RuleSet("intended", []).add(own, ("Own",)), "2 hours"), "kinds", str(tmp_path / "cp"))
    q.awaitTermination()
    got = [(r.rule_id, r.eventID) for r in spark.read.parquet(str(tmp_path / "cp-out")).collect()]
    assert sorted(got) == [("few", "001"), ("new", "002"), ("new", "702")]
    assert {len(p.stateOperators) for p in q.recentProgress} == {1}


def test_state_has_no_more_partitions_than_asked_for(spark, tmp_path):
    """The session's number for shuffles would be a worker, a store and a commit each in every micro-batch, for however few rows."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = batches(spark, tmp_path, [[{"k": "x", "eventID": "a", "eventTime": at(0)}], [{"k": "x", "eventID": "b", "eventTime": at(1)}]], "eventID string, k string, eventTime timestamp")
        for asked, got in ((3, 3), (20, 9)):
            with in_order.rocksdb(spark, asked):
                out = stateful.first_seen(df, "k", ts="eventTime", tie="eventID")
                out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"cp{asked}")).trigger(availableNow=True).start().awaitTermination()
            assert len([n for n in os.listdir(tmp_path / f"cp{asked}/state/0") if n.isdigit()]) == got
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_replay_of_few_rows_has_few_partitions_of_state(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_streaming, "_STATES", 2)
    monkeypatch.setattr(queries_streaming, "Scratch", lambda s: Scratch(s, str(tmp_path / "run")))
    assert queries_streaming.stream_alerts(spark, small).count() > 0
    assert len([n for n in os.listdir(tmp_path / "run/checkpoint/state/0") if n.isdigit()]) == 2


def test_event_time_looks_each_field_up_once(spark):
    given = [None, "{}", '{"Datetime": ""}', '{"p_event_time": "", "Datetime": "2024-01-01 00:00:01"}', '{"EdgeStartTimestamp": 1704067202}', '{"p_event_time": "x", "Datetime": "2024-01-01T00:00:00Z"}', '{"date_create": "1704067203.5"}', '{"Datetime": null, "date_create": "2024-01-01T02:00:04+02:00"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    time = event_time(F.parse_json("x"), F.timestamp_seconds(F.lit(0)))
    base = 1704067200 * 1_000_000
    got = [r.t for r in df.select("i", F.unix_micros(time).alias("t")).orderBy("i").collect()]
    assert got == [0, 0, 0, base + 1_000_000, base + 2_000_000, 0, base + 3_500_000, base + 4_000_000]
    plan = df.select(event_time(F.parse_json("x"), F.timestamp_seconds(F.lit(0))).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['date_create']") == 1


def test_a_row_dated_in_the_future_makes_no_other_late(spark, tmp_path):
    one = [{"k": "x", "eventID": "a", "eventTime": at(0)}, {"k": "x", "eventID": "far", "eventTime": "2999-01-01T00:00:00Z"}]
    two = [{"k": "x", "eventID": "b", "eventTime": at(5)}, {"k": "y", "eventID": "c", "eventTime": "2999-01-01T00:00:00Z"}]
    df = batches(spark, tmp_path, [one, two], "eventID string, k string, eventTime timestamp")
    late = f"{(datetime.now(UTC) - datetime(2024, 1, 1, tzinfo=UTC)).days + 5} days"
    q = start(stateful.threshold_crossed(df, "k", "eventTime", 600_000_000, 2, late=late), "future", str(tmp_path / "cp"))
    q.awaitTermination()
    assert all(p.stateOperators[0].numRowsDroppedByWatermark == 0 for p in q.recentProgress)


def test_first_seen_by_event_time_is_forgotten(spark, tmp_path):
    rows = [("x", 10), ("x", 5), ("x", 30), ("y", 0), ("x", 200)]
    one = [{"k": k, "eventID": f"{k}{t}", "eventTime": at(t)} for k, t in rows]
    df = batches(spark, tmp_path, [one, [{"k": "z", "eventID": "z", "eventTime": at(900)}]], "eventID string, k string, eventTime timestamp")
    got = collected(stateful.first_seen(df, "k", ts="eventTime", tie="eventID", keep_us=60 * 60_000_000), tmp_path, "firsts")
    assert sorted(r.eventID for r in got) == ["x200", "x5", "y0", "z"]


def test_alerts_of_a_stream_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(900), f"{i:03}") for i in range(150)]
    parts = [[{"dedup": k, "title": i, "rule_id": "r", "severity": "LOW", "t": at(t)} for k, t, i in part] for part in shuffled_batches(rng, rows, 30, 3)]
    df = batches(spark, tmp_path, [*parts, [{"dedup": "end", "title": "end", "rule_id": "r", "severity": "LOW", "t": at(9000)}]], "rule_id string, dedup string, title string, severity string, t timestamp")
    got = collected(stateful.alerts(df, 60, "t", late="30 hours"), tmp_path, "alerts").copy()
    start_us = int(datetime(2024, 1, 1, tzinfo=UTC).timestamp())
    assert sorted((r.title, (int(r.created_at.replace(tzinfo=UTC).timestamp()) - start_us) // 60, r.is_new_alert) for r in got if r.title != "end") == sorted(openings(rows, 60))


def test_sessions(spark, tmp_path):
    rows = [{"k": "x", "eventTime": at(t)} for t in (0, 4, 30, 33, 36)] + [{"k": "y", "eventTime": at(1)}]
    df = batches(spark, tmp_path, [rows, [{"k": "z", "eventTime": at(5000)}]], "k string, eventTime timestamp")
    got = collected(stateful.sessions(df, ["k"], "10 minutes", late="1 minute"), tmp_path, "sessions")
    assert sorted((r.k, r.events) for r in got) == [("x", 2), ("x", 3), ("y", 1)]


def test_following_a_directory_by_event_time(spark, tmp_path):
    """What modes.watch() says of records in order, this says of them in any."""
    (tmp_path / "logs").mkdir()
    parts = [[record(4, "Try", "a", 5), record(5, "Clone", "b", 1)], [record(1, "Try", "a", 0), record(2, "Try", "a", 1), record(3, "Clone", "b", 0)], [record(9, "Other", "z", 60 * 24 * 9)]]
    seen = []
    for k, rows in enumerate(parts):
        (tmp_path / f"logs/{k}.jsonl").write_text("\n".join(rows))
        modes.follow(spark, str(tmp_path / "logs"), str(tmp_path / "cp"), lambda df, _: seen.extend((r.rule_id, r.eventID) for r in df.collect()), stateful_rules(), late="1 day").awaitTermination()
    assert sorted(seen) == [("new", "003"), ("three", "004")]


def test_hits_of_watch_outlive_a_record_dated_in_the_future(spark, tmp_path):
    from vigilake.operators.detect import Analysis

    memory = RuleState(spark, str(tmp_path / "rules"), 600, 600)
    now = datetime.now(UTC)
    for batch, when in enumerate((now - timedelta(seconds=60), datetime(2999, 1, 1, tzinfo=UTC))):
        hits = spark.createDataFrame([("r", "x", when, "t", str(batch))], "rule_id string, state string, _at timestamp, title string, eventID string")
        memory.keep(batch, Analysis(hits, hits, hits), [])
    assert sorted(r.eventID for r in memory.past(2).collect()) == ["0", "1"]


def test_a_queue_loses_and_repeats_nothing(tmp_path):
    """Names in no order, one that arrives between plan and commit, a stream that dies in between."""
    folder = tmp_path / "q"
    folder.mkdir()
    put = lambda *names: [(folder / n).write_text(n) for n in names]
    read = lambda r, a, b: [m for p in r.partitions(a, b) for _, m in r.read(p)]
    put("0005", "zz", "0001")
    r = queue._Reader({"path": str(folder), "maxMessages": "2"})
    first = r.latestOffset()
    taken = read(r, r.initialOffset(), first)
    assert len(taken) == 2 and first == {"taken": 2}
    put("0003", "0000")  # before the largest name taken
    r.commit(first)
    assert sorted(os.listdir(folder)) == sorted({"0005", "zz", "0001", "0003", "0000"} - set(taken))
    second = r.latestOffset()  # planned, but the stream dies before it is logged
    again = queue._Reader({"path": str(folder), "maxMessages": "2"})
    third = again.latestOffset()
    assert third["taken"] == second["taken"] + 1
    assert sorted([*taken, *read(again, first, third)]) == ["0000", "0001", "0003", "0005", "zz"]
    assert read(again, first, third) == read(queue._Reader({"path": str(folder)}), first, third)  # a micro-batch that is repeated
    again.commit(third)
    again.commit(third)
    assert os.listdir(folder) == [] and again.latestOffset() == third == queue._Reader({"path": str(folder)}).latestOffset()
    put(taken[0])  # an id that comes again is a new message
    last = again.latestOffset()
    assert read(again, third, last) == [taken[0]]


def test_a_queue_as_a_stream_through_restarts(spark, tmp_path):
    folder, seen = tmp_path / "q", []
    folder.mkdir()
    for names in (["m7", "m2"], ["m1"], [], ["m9", "a0", "m3"]):
        for n in names:
            (folder / n).write_text(n)
        q = queue.QueueSource.stream(spark, str(folder), 2).writeStream.foreachBatch(lambda df, _: seen.extend(r.body for r in df.select(F.col("body")).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(seen)[:5] == sorted(set(seen))[:5] and len(seen) == len(set(seen)) >= 5
