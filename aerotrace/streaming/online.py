"""Streams that wait for event time: tracking, identities and readiness.

Rows of a mission arrive late and a frame may come in pieces. A processor therefore keeps what it receives by event time
and asks for a timer; when the watermark passes a frame, no more of it can come, and the closed frames run in order through the
step functions of the batch operators. What a stream emits is the batch result over the rows the watermark has closed, whatever
the micro-batches were. A mission that stays silent for ``idle`` loses its state.

Rows at or behind the watermark when they arrive are dropped by Spark and counted in ``numRowsDroppedByWatermark``. A NULL time never closes and
is dropped on entry. State stays in RocksDB. Each call to it is a round trip to the JVM, so received rows are kept in runs of up to ``RUN`` rows in order of time, with one timer
a run, at its first row; of a run that the watermark has passed in part, the rest becomes a run of its own. Closed runs are merged ``MERGE`` at a time, so a task
holds few rows of a mission, however many the watermark has passed at once and in whatever order they came.
"""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerotrace.operators import identity_pass, tracks
from aerotrace.streaming.streams import SIGNALS, use_rocksdb

RUN, MERGE = 1024, 64  # rows of a run, runs in memory at a time
IDENTITY_COLS = ("frame", "det_id", "x1", "y1", "x2", "y2", "conf", "sharpness", "lat", "lon")


def _millis(ts: pd.Timestamp) -> int:
    """The first whole millisecond at or after a time: timers and watermarks count those."""
    return -(-(ts.value // 1000) // 1000)


class ClosedFrames(StatefulProcessor):
    """Holds rows until the watermark has passed them, then runs ``step(rows, state) -> (rows, state)`` over them in time order."""

    def __init__(self, step, names: Sequence[str], key_name: str, idle_ms: int):
        self.step, self.names, self.key_name, self.idle_ms = step, list(names), key_name, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at bigint, n bigint", "rows string")  # one entry a run, by its first time
        self.state = handle.getValueState("state", "text string, arrivals bigint, closed bigint")

    def _state(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("", 0, -1)

    def _hold(self, n: int, columns: list, times: list, data: list, timer: bool = True) -> None:
        self.held.updateValue((times[0], n), (json.dumps([columns, times, data]),))
        if timer:
            self.handle.registerTimer(times[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, n, closed = self._state()
        for pdf in rows:
            times = [_millis(ts) for ts in pdf["ts"]]
            part = pdf.drop(columns=["ts", self.key_name]).astype(object)
            data = [[None if v is None or v != v else v for v in row] for row in part.to_numpy().tolist()]
            order = sorted(range(len(times)), key=times.__getitem__)
            for k in range(0, len(order), RUN):
                n += 1
                self._hold(n, list(part.columns), [times[i] for i in order[k:k + RUN]], [data[i] for i in order[k:k + RUN]])
        self.state.update((text, n, closed))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        text, n, closed = self._state()
        if expiredTimerInfo.getExpiryTimeInMs() <= closed:  # dealt with by an earlier timer of this batch
            return iter(())
        due = sorted(tuple(k) for k in self.held.keys() if k[0] <= now)
        if not due:
            if closed + self.idle_ms <= now and not self.held.exists():
                self.state.clear()
            return iter(())
        return self._run(key, due, now, text, n)

    def _run(self, key, due: list[tuple[int, int]], now: int, text: str, n: int) -> Iterator[pd.DataFrame]:
        """Runs the closed frames in order, ``MERGE`` runs in memory at a time; what may still be preceded by rows of other runs is held again in order."""
        most = MERGE
        while due:
            some, due = due[:most], due[most:]
            ready = []
            for k in some:
                columns, times, data = json.loads(self.held.getValue(k)[0])
                self.held.removeKey(k)
                ready += zip(times, data)
            ready.sort(key=lambda r: r[0])
            times = [at for at, _ in ready]
            end = bisect_left(times, min(now + 1, due[0][0]) if due else now + 1)
            # rows that other runs may precede go back as runs that do not overlap, so each is held again few times; more runs only where too many begin at one time
            most = MERGE if end else 2 * most
            close = bisect_right(times, now)
            for low, high in ((end, close), (close, len(ready))):
                for k in range(low, high, RUN):
                    n += 1
                    part = ready[k:min(k + RUN, high)]
                    self._hold(n, columns, [at for at, _ in part], [r for _, r in part], timer=low == close)
                    if low < close:
                        insort(due, (part[0][0], n))
            if not end:
                continue
            closed = times[end - 1]
            out, text = self.step(pd.DataFrame([r for _, r in ready[:end]], columns=columns), text)
            self.state.update((text, n, closed))
            out = out.reindex(columns=self.names)
            out.insert(0, self.key_name, key[0])
            yield out
        self.state.update((text, n, closed))
        self.handle.registerTimer(closed + self.idle_ms)

    def close(self) -> None:
        pass


def _closed_frames(rows: DataFrame, step, schema: str, by: str, delay: str, idle: dt.timedelta) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    names = [c.split()[0] for c in schema.split(",")]
    d = rows.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).groupBy(by)
    return d.transformWithStateInPandas(ClosedFrames(step, names, by, int(idle.total_seconds() * 1000)), f"{by} {dict(rows.dtypes)[by]}, {schema}", "append", "EventTime")


def stream_tracks(dets: DataFrame, by: str = "mission_id", mode: str = "greedy", delay: str = "2 seconds", idle: dt.timedelta = dt.timedelta(hours=6), **rules) -> DataFrame:
    """Track of each detection of the closed frames, or all tracker events (``mode='strict'``). Rows carry ``ts``, the time of their frame."""
    step, schema = (tracks.greedy_step(**rules), tracks.TRACK_SCHEMA) if mode == "greedy" else (tracks.strict_step(**rules), tracks.BUFFER_SCHEMA)
    return _closed_frames(dets.select(by, "ts", "frame", "det_id", "x1", "y1", "x2", "y2"), step, schema, by, delay, idle)


def identity_chain(**rules):
    """Detections of closed frames to identities: strict tracking, track numbers by birth, buffers with their detections' values, place-based assignment.

    The state is that of the tracker, the number of tracks so far, those still open with the values of their buffered detections, and the identities.
    """
    track, assign = tracks.strict_step(**rules), identity_pass.by_place_step()

    def step(rows: pd.DataFrame, text: str):
        st = json.loads(text) if text else {"t": "", "n": 0, "tid": {}, "val": {}, "id": ""}
        values = st["val"]
        for r in rows[["frame", "det_id", "conf", "sharpness", "lat", "lon"]].itertuples(index=False):
            if r.det_id == r.det_id and r.det_id is not None:
                values[f"{int(r.frame)}/{int(r.det_id)}"] = [None if v is None or v != v else float(v) for v in r[2:]]
        events, st["t"] = track(rows, st["t"])
        buffers, gone = [], set()
        for e in events.itertuples(index=False):
            born = f"{e.birth_frame}/{e.birth_det}"
            if e.kind == "new":
                st["n"] += 1
                st["tid"][born] = st["n"]
            elif e.kind == "flush":
                buffers.append((e.kind, st["tid"][born], e.flush_frame, e.frame, *values[f"{e.frame}/{e.det_id}"]))
            elif e.kind == "delete":
                buffers.append((e.kind, st["tid"][born], e.flush_frame, None, None, None, None, None))
                gone.add(born)
        for born in gone:
            del st["tid"][born]
        open_ = {f"{f}/{d}" for t in json.loads(st["t"] or "[]") for f, d in t["h"]}
        st["val"] = {k: v for k, v in values.items() if k in open_}
        out = pd.DataFrame([], columns=[c.split()[0] for c in identity_pass.IDENTITY_SCHEMA.split(", ")])
        if buffers:
            frame = pd.DataFrame(buffers, columns=["kind", "tid", "flush_frame", "frame", "conf", "sharpness", "lat", "lon"])
            out, st["id"] = assign(frame, st["id"])
        return out, json.dumps(st, separators=(",", ":"))
    return step


def stream_identities(dets: DataFrame, by: str = "mission_id", delay: str = "2 seconds", idle: dt.timedelta = dt.timedelta(hours=6), **rules) -> DataFrame:
    """Identity of every buffer of the closed frames, straight from located detections."""
    return _closed_frames(dets.select(by, "ts", *IDENTITY_COLS), identity_chain(**rules), identity_pass.IDENTITY_SCHEMA, by, delay, idle)


# ---- readiness ------------------------------------------------------------------------------

BOARD = "at timestamp, missing array<string>, ready boolean"


class Board(StatefulProcessor):
    """Which signals an aircraft lacks; a row whenever that changes, also when a signal merely grows stale."""

    def __init__(self, key_name: str, age_us: int, signals: Sequence[str]):
        self.key_name, self.age_us, self.signals = key_name, age_us, tuple(signals)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at bigint, n bigint", "rows string")  # not yet closed: runs of (time, signal), by the first time
        # what was shown, how far it goes, the number of runs so far, and the newest good row of each signal
        self.state = handle.getValueState("state", "missing string, closed bigint, arrivals bigint, last string")

    def _state(self) -> tuple[str | None, int, int, dict[str, int]]:
        missing, closed, n, last = self.state.get() if self.state.exists() else (None, -1, 0, "{}")
        return missing, closed, n, json.loads(last)

    def _hold(self, n: int, rows: list) -> None:
        self.held.updateValue((rows[0][0], n), (json.dumps(rows),))
        self.handle.registerTimer(-(-rows[0][0] // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        missing, closed, n, last = self._state()
        for pdf in rows:
            # any row tells that the aircraft is there
            seen = sorted({(ts.value // 1000, signal if ok and signal in self.signals else "") for ts, signal, ok in zip(pdf["ts"], pdf["signal"], pdf["ok"], strict=True)})
            for k in range(0, len(seen), RUN):
                n += 1
                self._hold(n, seen[k:k + RUN])
        self.state.update((missing, closed, n, json.dumps(last)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        shown, closed, n, last = self._state()
        if expiredTimerInfo.getExpiryTimeInMs() <= closed:  # dealt with by an earlier timer of this batch
            return iter(())
        arrivals, out = set(), []
        for k in sorted(tuple(k) for k in self.held.keys() if k[0] <= now):
            rows = [tuple(r) for r in json.loads(self.held.getValue(k)[0])]
            self.held.removeKey(k)
            arrivals.update(r for r in rows if r[0] <= now)
            if rows[-1][0] > now:
                self._hold(k[1], [r for r in rows if r[0] > now])
        arrivals = sorted(arrivals)
        stale = lambda: min((at + self.age_us for at in last.values()), default=None)

        def show(at: int) -> None:
            nonlocal shown
            missing = [s for s in self.signals if s not in last]
            if ",".join(missing) != shown:
                shown = ",".join(missing)
                out.append((key[0], pd.Timestamp(at * 1000), missing, not missing))

        def expire(until: int) -> None:
            while (first := stale()) is not None and first < until:
                for s in [s for s, at in last.items() if at + self.age_us == first]:
                    del last[s]
                show(first + 1)

        at = 0
        while at < len(arrivals):
            us, to = arrivals[at][0], at
            expire(us)
            while to < len(arrivals) and arrivals[to][0] == us:
                if arrivals[to][1]:
                    last[arrivals[to][1]] = us
                to += 1
            show(us)
            at = to
        expire(now)
        if (first := stale()) is not None:
            self.handle.registerTimer(first // 1000 + 1)
        self.state.update((shown, now // 1000, n, json.dumps(last)))
        return iter((pd.DataFrame(out, columns=[self.key_name, "at", "missing", "ready"]),) if out else ())

    def close(self) -> None:
        pass


def stream_readiness(signals: DataFrame, key: str = "uav_id", max_age: float = 2.0, delay: str = "1 second", required: Sequence[str] = SIGNALS) -> DataFrame:
    """The board of each aircraft whenever it changes: when a signal comes, comes back, or was last good more than ``max_age`` seconds ago.

    ``signals`` has ``signal``, ``ok`` and ``ts``. The last row of an aircraft is ``readiness_at`` of the watermark.
    """
    use_rocksdb(signals.sparkSession)
    d = signals.filter(F.col("ts").isNotNull()).select(key, "ts", F.coalesce("signal", F.lit("")).alias("signal"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return d.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(Board(key, int(max_age * 1e6), required), f"{key} {dict(signals.dtypes)[key]}, {BOARD}", "append", "EventTime")


def readiness_at(signals: DataFrame, at: Column, key: str = "uav_id", max_age: float = 2.0, required: Sequence[str] = SIGNALS) -> DataFrame:
    """The board of each aircraft heard of by the time ``at``, over a finished table."""
    seen = [F.max(F.when((F.col("signal") == s) & F.col("ok"), F.col("ts"))).alias(f"__{s}") for s in required]
    g = signals.filter(F.col("ts") <= at).groupBy(key).agg(*seen)
    fresh = lambda s: F.unix_micros(at) - F.unix_micros(f"__{s}") <= int(max_age * 1e6)
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(fresh(s), F.lit(False)), F.lit(s)) for s in required]))
    return g.select(key, missing.alias("missing")).withColumn("ready", F.size("missing") == 0)
