"""Monitors that keep state of their own by key and clear it with event-time timers: the newest ids of a feed, the last time
sent, mutes that come and go while the stream runs.

All three take a streaming DataFrame and return rows with its columns. Rows of a key are taken in order of time within a
micro-batch, micro-batches in the order in which they come; rows older than the watermark are left out. Rows without key, time,
id or a column of ``order`` drop out. State lives in the RocksDB store (``started`` sets it for the one query), so it need not fit into memory; what
a task holds is one key's rows of one micro-batch, which ``maxFilesPerTrigger`` bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def started(spark: SparkSession, begin: Callable[[], StreamingQuery]) -> StreamingQuery:
    """The query that ``begin`` starts, with the RocksDB store that keyed state wants; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return begin()
    finally:
        spark.conf.set(PROVIDER, before)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Ordered(StatefulProcessor):
    """Lets rows of a key through one by one in order of time; subclasses say which."""

    names: list[str]

    def __init__(self, at: str, order: list[str]):
        self.at, self.order = at, order

    def handleInputRows(self, key, rows, timerValues):
        # Frames come without names that are no Python names, such as "_x": they are given by place.
        frame = pd.concat([r.set_axis(self.names, axis=1) for r in rows], ignore_index=True)
        frame = self.ordered(frame).reset_index(drop=True)
        yield frame[self.keep(key, frame, micros(frame[self.at]), timerValues)]

    def ordered(self, frame):
        return frame.sort_values([self.at, *self.order], kind="stable")

    def close(self):
        pass


class NewestIds(_Ordered):
    """A row passes if its id is none of the ``bound`` newest ids of its feed. An id counts from its first sight; of ids over
    the bound the one with the oldest sight (ties: smaller id) is forgotten."""

    def __init__(self, at, id_, bound):
        super().__init__(at, [id_])
        self.id, self.bound = id_, bound

    def init(self, handle):
        self.seen = handle.getMapState("seen", "id string", "at long")

    def keep(self, key, frame, times, timers):
        stored = {k[0]: v[0] for k, v in self.seen.iterator()}
        known, out = dict(stored), []
        heap = [(t, i) for i, t in known.items()]
        heapq.heapify(heap)
        for t, i in zip(times, frame[self.id].astype(str)):
            out.append(i not in known)
            if out[-1]:
                known[i] = t
                heapq.heappush(heap, (t, i))
                if len(known) > self.bound:
                    del known[heapq.heappop(heap)[1]]
        for i in stored.keys() - known.keys():
            self.seen.removeKey((i,))
        for i, t in known.items():
            if stored.get(i) != t:
                self.seen.updateValue((i,), (t,))
        return out


class Throttle(_Ordered):
    """A row passes if nothing was sent within ``gap`` microseconds; a timer clears the last time sent when it can hold nothing back."""

    def __init__(self, at, order, gap):
        super().__init__(at, order)
        self.gap = gap

    def init(self, handle):
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def keep(self, key, frame, times, timers):
        before = last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in times:
            out.append(last is None or t - last >= self.gap)
            if out[-1]:
                last = t
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.gap) // 1000))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a timer of an earlier sending leaves the time of a later one alone
        if self.last.exists() and (self.last.get()[0] + self.gap) <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        yield pd.DataFrame()


class Mutes(_Ordered):
    """Rows with ``until`` true in ``command`` mute their key up to that time (null or past: unmute) and are themselves not
    passed on; other rows pass unless their time is before the mute's end. The newest command holds. Commands come before
    other rows of equal time, ``order`` settles the rest."""

    def __init__(self, at, order, command, until):
        super().__init__(at, order)
        self.command, self.until = command, until

    def ordered(self, frame):
        return frame.assign(_later=~frame[self.command].astype(bool)).sort_values([self.at, "_later", *self.order], kind="stable").drop(columns="_later")

    def init(self, handle):
        self.handle, self.muted = handle, handle.getValueState("muted", "until long")

    def keep(self, key, frame, times, timers):
        before = until = self.muted.get()[0] if self.muted.exists() else None
        ends = micros(frame[self.until])
        out = []
        for t, command, end, none in zip(times, frame[self.command], ends, frame[self.until].isna()):
            if command:
                until = None if none else end
            out.append(not command and (until is None or t >= until))
        if until is None:
            self.muted.clear()
        elif until != before:
            self.muted.update((until,))
            self.handle.registerTimer(-(-until // 1000))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.muted.exists() and self.muted.get()[0] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.muted.clear()
        yield pd.DataFrame()


def _passed(rows: DataFrame, by: str, at: str, need: list[str], late: str, processor: StatefulProcessor) -> DataFrame:
    sure = list(dict.fromkeys([by, at, *need]))
    own = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in sure)).withWatermark(at, late)
    # Whole numbers that may be null would pass through floating point: they travel as text.
    kinds = {f.name: f.dataType for f in own.schema.fields if f.name not in sure and f.dataType.typeName() in ("byte", "short", "integer", "long")}
    own = own.withColumns({c: F.col(c).cast("string") for c in kinds}) if kinds else own
    processor.names = own.columns
    out = own.groupBy(by).transformWithStateInPandas(processor, own.schema, "Append", "EventTime")
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}) if kinds else out


def newest_ids(entries: DataFrame, feed: str, id_: str, at: str, bound: int = 2000, late: str = "1 day") -> DataFrame:
    """Entries whose id is not among the ``bound`` newest ids seen of their feed: dedupe with a state of fixed size."""
    return _passed(entries, feed, at, [id_], late, NewestIds(at, id_, bound))


def throttled(alerts: DataFrame, by: str, at: str, order: list[str], hours: float = 6.0, late: str = "1 day") -> DataFrame:
    """Alerts that a throttle lets through which counts from the last one sent; ``order`` settles equal times."""
    return _passed(alerts, by, at, order, late, Throttle(at, order, int(hours * 3_600_000_000)))


def muted_by(entries: DataFrame, commands: DataFrame, by: str, at: str, until: str, order: list[str], late: str = "1 day") -> DataFrame:
    """``entries`` outside of their key's mute; ``commands`` (``by``, ``at``, ``until``) is a stream too and may change mutes while the monitor runs."""
    said = commands.select(by, at, until, *[F.lit("0" if c in order else None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c not in (by, at, until)])
    both = entries.withColumn(until, F.lit(None).cast(commands.schema[until].dataType)).withColumn("_command", F.lit(False)).unionByName(said.withColumn("_command", F.lit(True)))
    passed = _passed(both, by, at, order, late, Mutes(at, order, "_command", until))
    return passed.select(*entries.columns)

