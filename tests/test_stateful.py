import random
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from vigilake.functions.ids import ALERT_NAMESPACE, uuid5
from vigilake.functions.text import parse_duration
from vigilake.operators import alerts, stateful
from vigilake.sources.scratch import Scratch


def test_window_threshold_equals_a_simulation(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randrange(60)) for i in range(400)]
    for window, count in ((5, 3), (0, 2), (20, 12)):
        want, seen = set(), {}
        for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            kept = [x for x in seen.get(k, []) if x >= t - window] + [t]
            seen[k] = kept
            if len(kept) == count:
                want.add(i)
        df = spark.createDataFrame(rows, "i int, k string, t long")
        assert {r.i for r in stateful.threshold_crossed(df, ["k"], "t", ["i"], window, count).collect()} == want
        both = df.withColumn("rule", F.lit("r"))
        assert {r.i for r in stateful.thresholds_crossed(both, {"r": (max(1, window), count), "other": (7, 1)}, "rule", "k", "t", ["i"]).collect()} == (want if window else {r.i for r in stateful.threshold_crossed(df, ["k"], "t", ["i"], 1, count).collect()})


def matches(spark, rows):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    return spark.createDataFrame([(r, d, f"t{i}", "HIGH", start + timedelta(microseconds=us)) for i, (r, d, us) in enumerate(rows)], "rule_id string, dedup string, title string, severity string, event_time timestamp")


def test_alert_runs_are_anchored_at_creation(spark):
    hour = 3_600_000_000
    given = [("r", "k", 0), ("r", "k", hour - 1), ("r", "k", hour), ("r", "k", hour + 1), ("r", "k", 2 * hour + 1), ("r", "x", 5)]
    runs = stateful.alert_runs(matches(spark, given)).orderBy("dedup", "created_at").collect()
    assert [(r.dedup, r.hits, r.resolved_at is None, r.title) for r in runs] == [("k", 3, False, "t2"), ("k", 2, True, "t4"), ("x", 1, True, "t5")]
    assert runs[0].dedup_key == str(uuid.uuid5(uuid.UUID(ALERT_NAMESPACE), "r:k"))
    earlier = stateful.alert_runs(matches(spark, given[:1]))
    later = stateful.alert_runs(matches(spark, given).where("event_time > '2024-01-01 00:00:00'"), open_alerts=earlier)
    assert {(r.dedup, r.created_at, r.alert_id) for r in later.collect()} == {(r.dedup, r.created_at, r.alert_id) for r in runs}


def test_alert_runs_equal_a_simulation(spark):
    rng = random.Random(2)
    rows = [("r", rng.choice("abc"), rng.randrange(0, 40) * 60_000_000) for _ in range(300)]
    period, want, open_ = 7 * 60_000_000, [], {}
    for _, d, t in sorted(rows, key=lambda r: (r[1], r[2])):
        if d in open_ and not open_[d][0] < t - period:
            open_[d][1] += 1
        else:
            if d in open_:
                want.append((d, *open_[d]))
            open_[d] = [t, 1]
    want += [(d, *v) for d, v in open_.items()]
    got = stateful.alert_runs(matches(spark, rows), 7).select("dedup", (F.unix_micros("created_at") - 1704067200000000).alias("c"), "hits").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_forwarding_keeps_every_match(spark):
    hour = 3_600_000_000
    m = matches(spark, [("r", "", 0), ("r", "k", 1), ("r", "k", hour), ("r", "k", 3 * hour)]).withColumns({"eventName": F.lit("N"), "eventSource": F.lit("s")}).withColumnRenamed("event_time", "eventTime")
    out = alerts.forward(m).orderBy("eventTime").collect()
    assert [(r.dedup, r.is_new_alert) for r in out] == [("t0", True), ("k", True), ("k", False), ("k", True)]
    assert out[0].alert_context == {"eventName": "N", "eventSource": "s"}
    text = alerts.slack_alert(alerts.forward(m)).select("payload").first().payload
    assert '"color":"#f57c00"' in text and "*event name:* N" in text


def test_ties_open_one_alert_and_late_matches_belong_to_the_open_one(spark):
    hour = 3_600_000_000
    m = matches(spark, [("r", "k", 5 * hour), ("r", "k", 5 * hour), ("r", "k", hour), ("r", "x", 0), ("q", "k", 0)])
    before = stateful.alert_runs(matches(spark, [("r", "k", 4 * hour + 1)]))
    out = alerts.forward(m, ts="event_time", open_alerts=before).collect()
    assert len(out) == 5
    kept = {(r.rule_id, r.title): (r.alert_id, r.is_new_alert) for r in out}
    old = before.first().alert_id
    assert {kept["r", t] for t in ("t0", "t1", "t2")} == {(old, False)} and kept["r", "t3"][1] and kept["q", "t4"][1]
    alone = alerts.forward(m.where("rule_id = 'r' and dedup = 'k'"), ts="event_time").orderBy("event_time", "title").collect()
    assert [(r.title, r.is_new_alert) for r in alone] == [("t2", True), ("t0", True), ("t1", False)]
    assert {r.alert_id for r in stateful.alert_runs(m).collect()} == {r.alert_id for r in alerts.forward(m, ts="event_time").collect()}


def test_windows_without_a_common_measure(spark):
    rng = random.Random(8)
    limits = {"a": (7_000_003, 2), "b": (86_399_000_017, 3), "c": (1, 1)}
    start = 1_700_000_000_000_000
    rows = [(i, rng.choice("abcd"), rng.choice("xy"), start + rng.randrange(200_000_000_000)) for i in range(600)]
    want, seen = set(), {}
    for i, r, k, t in sorted(rows, key=lambda x: (x[3], x[0])):
        if r in limits:
            kept = [x for x in seen.get((r, k), []) if x >= t - limits[r][0]] + [t]
            seen[r, k] = kept
            if len(kept) == limits[r][1]:
                want.add(i)
    df = spark.createDataFrame(rows, "i int, rule string, k string, t long")
    assert {r.i for r in stateful.thresholds_crossed(df, limits, "rule", "k", "t", ["i"]).collect()} == want


def test_resolving_listing_and_ids(spark):
    runs = stateful.alert_runs(matches(spark, [("r", "a", 0), ("r", "b", 9)]))
    first = runs.where("dedup = 'a'").select("alert_id")
    left = stateful.open_alerts(stateful.resolve(runs, first, F.current_timestamp()), limit=0)
    assert [r.dedup for r in left.collect()] == ["b"]
    assert [r.dedup for r in stateful.open_alerts(runs, limit=1, offset=1).collect()] == ["a"]
    assert spark.range(1).select(uuid5(F.lit("ä:b"))).first()[0] == str(uuid.uuid5(uuid.UUID(ALERT_NAMESPACE), "ä:b"))
    assert parse_duration("1h30m") == 5400 and parse_duration("7d") == 604800


def marks(df):
    return sorted((r.rule_id, r.dedup, r._t, r._created, r._new, r._updated, r.title) for r in df.select("rule_id", "dedup", "_t", "_created", "_new", "_updated", "title").collect())


def test_alerts_in_parts_equal_the_fold(spark, tmp_path):
    """Ties, gaps of many periods, matches before an open alert, one key with most matches."""
    rng = random.Random(6)
    minute = 60_000_000
    rows = [("r", rng.choice("aaaab"), rng.randrange(0, 900) * minute // 2) for _ in range(400)] + [("r", "a", 5000 * minute), ("r", "a", 5000 * minute), ("q", "a", 0), ("r", "c", 7)]
    m, scratch = matches(spark, rows), Scratch(spark, str(tmp_path / "scratch"))
    assert marks(stateful.alerted_in_parts(m, scratch, 7)) == marks(stateful.alerted(m, 7))
    for hot in (0, 50, 10_000):
        assert marks(stateful.alerted(m, 7, hot_rows=hot, scratch=scratch)) == marks(stateful.alerted(m, 7))
    old = stateful.alert_runs(matches(spark, [("r", "a", 100 * minute), ("z", "z", 0)]), 7)
    assert marks(stateful.alerted_in_parts(m, scratch, 7, old)) == marks(stateful.alerted(m, 7, old))
    runs = lambda **kw: sorted(map(repr, stateful.alert_runs(m, 7, old, **kw).collect()))
    assert runs(hot_rows=100, scratch=scratch) == runs()


def test_a_hot_key_is_many_tasks(spark, tmp_path):
    """No window or join of the parts has a key's rows together: the largest group stays far under the key."""
    start = datetime(2024, 1, 1, tzinfo=UTC)
    m = spark.range(20_000).select(F.lit("r").alias("rule_id"), F.lit("k").alias("dedup"), F.lit("t").alias("title"), F.lit("LOW").alias("severity"), (F.lit(start) + F.make_dt_interval(secs=(F.col("id") * 7).cast("decimal(18,6)"))).alias("event_time"))
    out = stateful.alerted_in_parts(m, Scratch(spark, str(tmp_path / "s")), 60)
    assert out.where("_new").count() == out.select("_created").distinct().count() == 20_000 * 7 // 3605 + 1
    widest = out.groupBy(F.floor(F.col("_t") / (3_600_000_000 // 64))).count().agg(F.max("count")).first()[0]
    assert widest < 20
