"""Keyed state that sees a key's rows in the order of their event time, however they arrive.

Rows wait in list state until the watermark has passed them, so what comes out
over any order of arrival within the allowed lateness is what a sorted batch
gives. Keys are dealt into groups, each of which is one call in a micro-batch,
as a call for each key costs far more than its rows. A task packs the rows of a
group into one piece before they are shuffled, as Spark hands the processor one
row after the other. The memories of a group's
keys are packed into a few values; an event-time timer drops one once no row still to come can
depend on it, at the latest when half of those that lie between are due. State
is thus what lies between the watermark and the newest row, and memories within
reach of the watermark.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from vigilake.operators.stateful import micros

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, as this module's operators need it.

    Each partition of state is a worker, a store and a commit in every
    micro-batch, whatever it holds. ``partitions`` is how many a new checkpoint
    gets at most, in place of the session's number for shuffles.
    """
    settings = {_PROVIDER: ROCKSDB}
    if partitions is not None:
        settings[_PARTITIONS] = str(min(partitions, int(spark.conf.get(_PARTITIONS))))
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Fold:
    """What is done with a key's rows: one step for each, in order."""

    #: names and SQL types of what a step adds to a row; a memory is a tuple that JSON can say
    added: str = ""

    def step(self, key: tuple, memory: tuple | None, at: int) -> tuple[tuple, tuple | None]:
        """The new memory, and what is added to the row, or nothing if the row doesn't come out. at: microseconds."""
        raise NotImplementedError

    def until(self, key: tuple, memory: tuple) -> int | None:
        """The last time, in microseconds, of a row for which the memory matters; nothing for ever."""
        return None


#: keys of a stream are dealt into so many groups
GROUPS = 1024
#: and the memories of a group's keys into so many values
SLOTS = 16
#: a task packs them when it has so many rows, or bytes of them
_PACK_ROWS, _PACK_BYTES = 500_000, 1 << 26
_ROWS = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.string()), ("body", pa.string())])
_PIECES = "_group long, _ts timestamp, first long, rows binary"


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _ROWS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows packed by group, with the times of the last and the first of each piece."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _PACK_ROWS or size >= _PACK_BYTES:
            yield _by_group(pa.Table.from_batches(held))
            held, rows, size = [], 0, 0
    if rows:
        yield _by_group(pa.Table.from_batches(held))


def _by_group(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks().sort_by([("_group", "ascending"), ("at", "ascending")]).combine_chunks()
    group, at, rows = table["_group"].to_numpy(), table["at"].to_numpy(), table.select(_ROWS.names).cast(_ROWS)
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    end = np.append(start[1:], len(group))
    packed = [_packed(rows.slice(a, b - a)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return pa.record_batch([pa.array(group[start]), pa.array(at[end - 1]).cast(pa.timestamp("us", "UTC")), pa.array(at[start]), pa.array(packed, pa.binary())], ["_group", "_ts", "first", "rows"])


class _Held:
    """A group's memories while it is worked on: each slot is read once and written once at most, as each is a request to the store."""

    def __init__(self, state):
        self.state, self.slots, self.stored, self.changed, self.whole = state, {}, set(), set(), False

    def _put(self, n: int, text: str | None) -> None:
        self.slots[n] = {k: tuple(m) for k, m in json.loads(text).items()} if text is not None else {}
        if text is not None:
            self.stored.add(n)

    def of(self, wanted: set[int]) -> dict[int, dict[str, tuple]]:
        if len(wanted) > SLOTS // 4:
            return self.all()
        for n in wanted - set(self.slots):
            found = self.state.getValue((n,))
            self._put(n, None if found is None else found[0])
        return self.slots

    def all(self) -> dict[int, dict[str, tuple]]:
        if not self.whole:
            for (n,), (text,) in list(self.state.iterator()) if self.state.exists() else []:
                if n not in self.slots:
                    self._put(n, text)
            for n in range(SLOTS):
                self.slots.setdefault(n, {})
            self.whole = True
        return self.slots

    def write(self) -> None:
        for n in sorted(self.changed):
            if self.slots[n]:
                self.state.updateValue((n,), (json.dumps(self.slots[n]),))
            elif n in self.stored:
                self.state.removeKey((n,))


class _Processor(StatefulProcessor):
    """Works on a group of keys. Its waiting rows are pieces of the list, as tasks have packed them; it has one timer, for the first row or the next memories to go."""

    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getMapState("memory", "slot int", "memories string")
        self.forget = handle.getValueState("forget", "at long")
        self.passed = handle.getValueState("passed", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for df in rows:
            for at, piece in zip(df["first"], df["rows"], strict=True):
                self.waiting.appendValue((piece,))
                first = int(at) if first is None else min(first, int(at))
        timers = list(self.handle.listTimers())
        if first is not None and all(t * 1000 >= first for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pieces = [pa.ipc.open_stream(rows).read_all() for (rows,) in self.waiting.get()] if self.waiting.exists() else []
        table = pa.concat_tables([_ROWS.empty_table(), *pieces]).combine_chunks()
        ready = pc.less_equal(table["at"], passed)
        due, left = table.filter(ready), table.filter(pc.invert(ready))
        forget, out = self.forget.get()[0] if self.forget.exists() else None, []
        held = _Held(self.memory)
        if len(due):
            if len(left):
                self.waiting.put([(_packed(left),)])
            else:
                self.waiting.clear()
            if self.passed.exists():
                # Spark drops a piece by its last row; what else comes behind rows that have been folded is late, too
                due = due.filter(pc.greater(due["at"], self.passed.get()[0]))
        if len(due):
            out, until = self._folded(due.sort_by([(n, "ascending") for n in _ROWS.names]), held)
            if until and forget is None:
                forget = self._half(until)
                self.forget.update((forget,))
        if forget is not None and forget <= passed:
            forget = self._forgotten(passed, held)
        held.write()
        if self.memory.exists():
            self.passed.update((passed,))
        elif self.passed.exists():
            self.passed.clear()
        times = [*([pc.min(left["at"]).as_py()] if len(left) else []), *([] if forget is None else [forget])]
        if times:
            self._wake(min(times))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def _folded(self, due: pa.Table, memories: _Held) -> tuple[list[tuple], list[int]]:
        """The rows that come out of those due, by key and time, and until when the new memories matter."""
        slots = {k: zlib.crc32(k.encode()) % SLOTS for k in due["key"].unique().to_pylist()}
        held = memories.of(set(slots.values()))
        out, taken, until, now = [], [], [], None
        memory = key = None

        def settle() -> None:
            if now is not None and memory is not None and memory != held[slots[now]].get(now):
                held[slots[now]][now] = memory
                memories.changed.add(slots[now])
                end = self.fold.until(key, memory)
                if end is not None:
                    until.append(end)

        for n, (k, at) in enumerate(zip(due["key"].to_pylist(), due["at"].to_pylist(), strict=True)):
            if k != now:
                settle()
                now, key, memory = k, tuple(json.loads(k)), held[slots[k]].get(k)
            memory, more = self.fold.step(key, memory, at)
            if more is not None:
                taken.append(n)
                out.append((key, at, more))
        settle()
        bodies = due["body"].take(pa.array(taken, pa.int64())).to_pylist()
        return [(*key, at, body, *more) for (key, at, more), body in zip(out, bodies, strict=True)], until

    @staticmethod
    def _half(until: list[int]) -> int:
        # by then about half of them can go, so each is looked at a few times
        return (min(until) + max(until)) // 2 + 1

    def _forgotten(self, passed: int, memories: _Held) -> int | None:
        """Drops the memories that matter no more; when to do so again."""
        until = []
        for n, held in memories.all().items():
            ends = {k: self.fold.until(tuple(json.loads(k)), m) for k, m in held.items()}
            gone = [k for k, end in ends.items() if end is not None and end < passed]
            until += [end for end in ends.values() if end is not None and end >= passed]
            for k in gone:
                del held[k]
            if gone:
                memories.changed.add(n)
        if not until:
            self.forget.clear()
            return None
        again = max(self._half(until), passed + 1)
        self.forget.update((again,))
        return again

    def _wake(self, at: int) -> None:
        # a timer is due from the first watermark behind it
        self.handle.registerTimer(max(0, -(-at // 1000) - 1))

    def close(self) -> None:
        pass


def with_clock(df: DataFrame, ts: Column, late: str, ahead: str = "1 day") -> DataFrame:
    """A stream with ``_ts``, by which its watermark moves. A time over ``ahead`` beyond the clock is taken as the clock's, so a row dated in the future can't make all others late."""
    given, clock = ts.cast("timestamp"), F.current_timestamp()
    return df.withColumn("_ts", F.when(given > clock + F.expr(f"interval {ahead}"), clock).otherwise(given)).withWatermark("_ts", late)


def folded(df: DataFrame, keys: list[str], tie: str, fold: Fold, groups: int = GROUPS) -> DataFrame:
    """The rows of a stream that the fold lets out, with what it adds, and ``event_us``, their time.

    df comes from with_clock(). Rows of a key are taken by ``_ts`` and then
    ``tie``; those that are late are dropped, by pieces (a piece by its newest
    row) or behind what a remembered group was folded through. Keys are taken as text and dealt
    into ``groups``; what waits of one is held by a task, so take more of them
    for streams with over some 10^8 rows within ``late``. A checkpoint is bound
    to their number. Start the query within ``rocksdb(spark)``, in append mode.
    """
    watermark = df.schema["_ts"].metadata
    others = [c for c in df.columns if c not in (*keys, "_ts")]
    key = F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), key.alias("key"), "_ts", micros(F.col("_ts")).alias("at"), F.coalesce(F.col(tie).cast("string"), F.lit("")).alias("tie"), F.to_json(F.struct(*others), _JSON).alias("body")).where("at is not null")
    named = [*(f"`{k}` string" for k in keys), "at long", "body string", *([fold.added] if fold.added else [])]
    names = [*keys, "at", "body", *(x.split()[0] for x in fold.added.split(",") if x)]
    pieces = rows.mapInArrow(_pieces, _PIECES).select("_group", F.col("_ts").alias("_ts", metadata=watermark), "first", "rows")
    done = pieces.groupBy("_group").transformWithStateInPandas(_Processor(fold, names), ", ".join(named), "Append", "EventTime")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in others)
    whole = done.withColumn("body", F.from_json("body", kinds, _JSON))
    return whole.select(*keys, *(F.col("body")[c].alias(c) for c in others), *names[len(keys) + 2 :], F.col("at").alias("event_us"))


class Crossing(Fold):
    """Lets out the rows that make it exactly ``count`` rows in the window that ends with them. limits: (window in microseconds, count), or those by the key's first part."""

    def __init__(self, limits: tuple[int, int] | dict[str, tuple[int, int]]):
        self.limits = limits

    def _of(self, key: tuple) -> tuple[int, int]:
        return self.limits[key[0]] if isinstance(self.limits, dict) else self.limits

    def step(self, key: tuple, memory: tuple | None, at: int) -> tuple[tuple, tuple | None]:
        window, count = self._of(key)
        # whether just count of them lie in the window shows in the newest count + 1
        times = [*(memory[0] if memory else ()), at][-(count + 1) :]
        crossed = len(times) >= count and times[-count] >= at - window and (len(times) == count or times[0] < at - window)
        return (times,), () if crossed else None

    def until(self, key: tuple, memory: tuple) -> int | None:
        return memory[0][-1] + self._of(key)[0]


class First(Fold):
    """Lets out the first row of a key; ``keep`` is for how many microseconds behind a key's last row it counts as seen, for ever if none."""

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def step(self, key: tuple, memory: tuple | None, at: int) -> tuple[tuple, tuple | None]:
        known = memory is not None and (self.keep is None or at - memory[0] <= self.keep)
        return memory if known and self.keep is None else (at,), None if known else ()

    def until(self, key: tuple, memory: tuple) -> int | None:
        return None if self.keep is None else memory[0] + self.keep


class ByFirstPart(Fold):
    """Takes each key by the fold for its first part; none of them adds anything."""

    def __init__(self, folds: dict[str, Fold]):
        self.folds = folds

    def step(self, key: tuple, memory: tuple | None, at: int) -> tuple[tuple, tuple | None]:
        return self.folds[key[0]].step(key, memory, at)

    def until(self, key: tuple, memory: tuple) -> int | None:
        return self.folds[key[0]].until(key, memory)


class Alerting(Fold):
    """Lets out every row with the alert it belongs to, which takes in rows for ``period`` microseconds from its creation."""

    added = "created long, is_new_alert boolean"

    def __init__(self, period: int):
        self.period = period

    def step(self, key: tuple, memory: tuple | None, at: int) -> tuple[tuple, tuple | None]:
        new = memory is None or memory[0] < at - self.period
        created = at if new else memory[0]
        return (created,), (created, new)

    def until(self, key: tuple, memory: tuple) -> int | None:
        return memory[0] + self.period
