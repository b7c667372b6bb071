"""Structured Streaming forms of the per-frame loops.

`ordered_state` is the common shape: rows of a key arrive in any order, wait in state until the watermark
has passed them, and are then stepped in frame order through a small state machine. State per key is the
machine plus the rows newer than the watermark, so it is bounded by the allowed lateness. Waiting rows are cells of
their own, one for each short span of time, so a trigger writes the cells that got new rows, drops those that the
watermark has passed, and leaves all others alone; timers wake a key when its next rows are due or its time is up.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtloom import constants as C
from courtloom.operators import fusion
from courtloom.operators import tracking as T
from courtloom.session import cut_lineage, scratch_path


#: Event time of the rows that end a bounded replay; watermarks beyond LAST mean that all its rows are in.
END = "2200-01-01 00:00:00"
LAST_MS = int(pd.Timestamp("2199-01-01").timestamp() * 1000)


def watermarked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """A watermark that end marks move on, although they go no further."""
    return stream.withWatermark(time, delay).filter(F.col(time) < F.lit(END).cast("timestamp"))


def write_replay(df: DataFrame, path: str, time: str = "ts", least: int = 3, rows_per_file: int = 2_000_000) -> None:
    """A bounded table as files in time order, each of about `rows_per_file` rows, and two end marks: the first moves the
    watermark past every row, the second starts the micro-batch that lets go of what waits for it.

    The rows are dealt to a folder for each span of time in one pass; each file is then written from its own folder, so
    the work grows with the rows and not with rows times files."""
    df = cut_lineage(df)
    n, low, high = df.agg(F.count("*"), F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    parts = max(least, -(-n // rows_per_file))
    width = ((high or 0) - (low or 0)) // parts + 1
    slot = F.floor((F.unix_micros(time) - (low or 0)) / width)
    dealt = scratch_path(df.sparkSession, "replay")
    df.withColumn("_slot", slot).filter("_slot is not null").write.partitionBy("_slot").parquet(dealt)
    spans = df.select(slot.alias("s")).distinct().filter("s is not null").collect()      # at most `parts` rows
    for k in sorted(r["s"] for r in spans):
        df.sparkSession.read.schema(df.schema).parquet(f"{dealt}/_slot={k}").coalesce(1).write.mode("append").parquet(path)
    mark = df.sparkSession.range(1).select(*[F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    for _ in range(2):
        mark.coalesce(1).write.mode("append").parquet(path)


def event_time(frame: str, fps: float = C.FPS):
    """Frame number as a timestamp. Frame 0 is one day after the epoch: a first watermark of 0 would count a
    row at the epoch itself as late."""
    return F.timestamp_micros(((F.col(frame) / F.lit(fps) + 86_400) * 1_000_000).cast("long"))


#: State cells need the RocksDB provider; it is part of Spark.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NEVER = -1


class FrameSteps(StatefulProcessor):
    """Steps a machine through the complete frames of a key, in order.

    State: `waiting`, a map from a span of `span_ms` to its rows that the watermark has not passed; `machine`, the stepper
    and the time of the one timer that is set. Rows are named tuples all the way, since a table for each frame costs more
    than its step; `walk` takes all complete rows at once, in order, for steppers that work on tables."""

    def __init__(self, keys: list[str], time: str, order: str, columns: list[str], names: list[str], machine: Callable[[], object],
                 step: Callable[[object, int, list[tuple]], list[tuple]] | None, expire_ms: int, span_ms: int,
                 walk: Callable[[object, pd.DataFrame], list[tuple]] | None = None):
        self.keys, self.time, self.order, self.columns, self.names = keys, time, order, columns, names
        self.fresh_machine, self.step, self.expire_ms, self.span_ms, self.walk = machine, step, expire_ms, span_ms, walk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.machine = handle.getValueState("machine", "stepper binary, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            due = batch[self.time].to_numpy().astype("datetime64[ms]").astype("int64")
            spans = due // self.span_ms
            if (spans[1:] < spans[:-1]).any():
                order = np.argsort(spans, kind="stable")
                batch, due, spans = batch.iloc[order], due[order], spans[order]
            rows_of = list(zip(due.tolist(), *[batch[c].tolist() for c in self.columns], strict=True))
            cuts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(rows_of)] if rows_of else []
            for lo, hi in zip(cuts, cuts[1:]):
                span, cells = int(spans[lo]), rows_of[lo:hi]
                held = self.waiting.getValue((span,))
                self.waiting.updateValue((span,), (pickle.dumps(pickle.loads(held[0]) + cells if held is not None else cells),))
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs(), False)

    def _ready(self, mark: int) -> tuple[list[tuple], int | None]:
        """(rows before `mark`, time of the first row that goes on waiting); passed spans are dropped."""
        ready, left = [], None
        for span in sorted(s for (s,) in self.waiting.keys()):
            if span * self.span_ms >= mark:
                return ready, min(r[0] for r in pickle.loads(self.waiting.getValue((span,))[0]))
            cells = pickle.loads(self.waiting.getValue((span,))[0])
            later = [r for r in cells if r[0] >= mark]
            ready += [r for r in cells if r[0] < mark]
            if later:
                if len(later) < len(cells):
                    self.waiting.updateValue((span,), (pickle.dumps(later),))
                return ready, min(r[0] for r in later)
            self.waiting.removeKey((span,))
        return ready, left

    def _stepped(self, stepper: object, ready: list[tuple]) -> list[tuple]:
        """What the stepper says to complete rows, frame by frame; rows without a frame are in none."""
        at = self.columns.index(self.order)
        row = namedtuple("Row", self.columns, rename=True)
        rows = [row._make(r[1:]) for r in ready if not pd.isna(r[at + 1])]
        rows.sort(key=itemgetter(at))
        if self.walk is not None:
            return self.walk(stepper, pd.DataFrame(rows, columns=self.columns)) if rows else []
        out: list[tuple] = []
        lo = 0
        for hi in range(1, len(rows) + 1):
            if hi == len(rows) or rows[hi][at] != rows[lo][at]:
                out += self.step(stepper, int(rows[lo][at]), rows[lo:hi])
                lo = hi
        return out

    def _advance(self, key: tuple, mark: int, fresh: bool) -> pd.DataFrame:
        ready, first = self._ready(mark)
        held = self.machine.get() if self.machine.exists() else None
        stepper, timer = (pickle.loads(held[0]), held[1]) if held is not None else (self.fresh_machine(), NEVER)
        out: list[tuple] = []
        if ready:
            out = self._stepped(stepper, ready)
        silent = first is None and not ready and not fresh
        if first is None and (mark >= LAST_MS or (silent and timer <= mark)):
            self._wake(timer, NEVER)
            self.machine.clear()                # silent for the retention time, or the end: forget the key
        else:
            at = max(first, mark) + 1 if first is not None else timer if silent else mark + self.expire_ms
            self._wake(timer, at)
            if ready or held is None or at != timer:
                self.machine.update((pickle.dumps(stepper), at))
        frame = pd.DataFrame(out, columns=self.names)
        for k, v in zip(self.keys, key, strict=True):
            frame[k] = v
        return frame[[*self.keys, *self.names]]

    def _wake(self, timer: int, at: int) -> None:
        if at != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if at != NEVER:
                self.handle.registerTimer(at)


def ordered_state(stream: DataFrame, keys: Sequence[str], time: str, order: str, machine: Callable[[], object],
                  step: Callable[[object, int, list[tuple]], list[tuple]] | None, schema: str, delay: str, expire_ms: int = 600_000, span_ms: int = 10_000,
                  walk: Callable[[object, pd.DataFrame], list[tuple]] | None = None) -> DataFrame:
    """Step `machine` over complete frames in order. `step(state, frame, rows)` gets the rows of a frame as named tuples and
    returns output tuples; `walk(state, rows)`, in its place, gets those of all complete frames, in order, as one table. A
    key that stays silent for `expire_ms` (a chunk's length by default) is forgotten, at the latest when the end mark has passed."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    names = [p.split()[0] for p in schema.split(", ")]
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    stream.sparkSession.conf.set(*PROVIDER)
    columns = [c for c in stream.columns if c not in (*keys, time)]
    steps = FrameSteps(keys, time, order, columns, names, machine, step, expire_ms, span_ms, walk)
    return watermarked(stream, time, delay).groupBy(*keys).transformWithStateInPandas(steps, f"{head}, {schema}", "append", "EventTime")


# --- trackers -------------------------------------------------------------------------------------------------
def fuse_online(groups: DataFrame, delay: str = "1 seconds", **params) -> DataFrame:
    """Cross-camera fusion per (game, chunk); rows as in `fusion.fuse_groups`, ids as they were when reported."""
    def walk(tracks: fusion.CourtTracks, rows: pd.DataFrame) -> list[tuple]:
        return [r[:6] for f in fusion.frames(rows) for r in fusion.report(tracks, f)]

    return ordered_state(groups, ["game", "chunk"], "ts", "frame", lambda: fusion.CourtTracks(**params), None,
                         "frame long, gid long, cx double, cy double, team string, jersey long", delay, walk=walk)


class _Ball:
    def __init__(self, limits: dict):
        self.state, self.last = T.BallState(**limits), None


def track_ball_online(cands: DataFrame, delay: str = "1 seconds", **limits) -> DataFrame:
    """Ball tracker per (game, chunk): candidates frame, cx, cy, score, ts."""
    def step(ball: _Ball, frame: int, rows: list[tuple]) -> list[tuple]:
        out, none = [], np.zeros((0, 3))
        points = np.array([(r.cx, r.cy, r.score) for r in rows], dtype=float)
        points = points[np.lexsort((points[:, 1], points[:, 0], -points[:, 2]))]
        for f in range(ball.last + 1 if ball.last is not None else frame, frame + 1):
            p = ball.state.step(points if f == frame else none)
            if p is not None:
                out.append((f, T.tenth(p[0]), T.tenth(p[1])))
        ball.last = frame
        return out

    return ordered_state(cands, ["game", "chunk"], "ts", "frame", lambda: _Ball(limits), step, "frame long, bx double, by double", delay)


class _Holder:
    def __init__(self):
        self.current, self.rival, self.streak, self.flight = None, None, 0, None


def hold_online(observed: DataFrame, switch_k: int = C.SWITCH_K, catch_k: int = C.CATCH_K, delay: str = "1 seconds") -> DataFrame:
    """Holder machine per (game, chunk) over rows (frame, state, top, ts): emits each takeover."""
    def step(h: _Holder, frame: int, rows: list[tuple]) -> list[tuple]:
        row = rows[0]
        if row.state == "FLIGHT":
            h.flight = frame
        if row.state != "HOLD":
            return []
        top = row.top
        fresh = h.flight is not None and frame - h.flight <= C.SINCE_FLIGHT
        if top == h.current:
            h.streak = 0
            return []
        h.streak = h.streak + 1 if top == h.rival else 1
        h.rival = top
        if h.streak < (catch_k if fresh else switch_k):
            return []
        h.current, h.streak = top, 0
        return [(frame, top)]

    return ordered_state(observed, ["game", "chunk"], "ts", "frame", _Holder, step, "frame long, holder string", delay)


class _Reader:
    def __init__(self):
        self.seen = None
        self.forget()

    def forget(self) -> None:
        self.votes, self.claim, self.last, self.hot = {}, None, None, -1


def triggered_reads(boxes: DataFrame, heartbeat: int = 30, burst: int = 15, min_votes: int = 2, share: float = 0.6, delay: str = "1 seconds",
                    forget_after: int = 18_000) -> DataFrame:
    """Which boxes to read, per (game, cam, track): while unclaimed, when the heartbeat is due, or while hot
    (contact, or a read that contradicts the claim). Rows: frame, ts, num (what a read would return), conf,
    contact. The claim needs enough votes and share; a track away for `forget_after` frames starts anew."""
    def step(r: _Reader, frame: int, rows: list[tuple]) -> list[tuple]:
        row = rows[0]
        if r.seen is not None and frame - r.seen > forget_after:
            r.forget()
        r.seen = frame
        if row.contact:
            r.hot = max(r.hot, frame + burst)
        due = r.last is None or frame - r.last >= heartbeat
        if not (r.claim is None or due or frame <= r.hot):
            return []
        r.last = frame
        if pd.notna(row.num):
            n = int(row.num)
            r.votes[n] = r.votes.get(n, 0) + 1
            top = max(r.votes, key=r.votes.get)
            if r.votes[top] >= min_votes and r.votes[top] / sum(r.votes.values()) >= share:
                if r.claim is not None and r.claim != top:
                    r.hot = frame + burst
                r.claim = top
            elif r.claim is not None and n != r.claim and row.conf >= 0.8:
                r.hot = frame + burst
        return [(frame, r.claim)]

    return ordered_state(boxes, ["game", "cam", "track_id"], "ts", "frame", _Reader, step, "frame long, claim long", delay, int(forget_after / C.FPS * 1000) + 1000)


class _Seen:
    def __init__(self):
        self.last = None


def expire_tracks(tracks: DataFrame, lost_after: int = 60, delay: str = "1 seconds", forget_after: int = 300) -> DataFrame:
    """Per (game, gid): a gap of more than `lost_after` frames retires the track, its return is a re-entry;
    a track that stays away for more than `forget_after` frames is forgotten and enters anew."""
    def step(s: _Seen, frame: int, rows: list[tuple]) -> list[tuple]:
        gap = None if s.last is None or frame - s.last > forget_after else frame - s.last
        s.last = frame
        kind = "enter" if gap is None else "reentry" if gap > lost_after else None
        return [(frame, kind)] if kind else []

    return ordered_state(tracks, ["game", "gid"], "ts", "frame", _Seen, step, "frame long, event string", delay, int(forget_after / C.FPS * 1000) + 1000)


# --- stateless and windowed forms -------------------------------------------------------------------------------
def align_cameras(left: DataFrame, right: DataFrame, tolerance: str = "0 seconds", delay: str = "1 seconds") -> DataFrame:
    """Camera streams joined pair by pair on the reference frame; both sides are watermarked so state is released."""
    a = left.withWatermark("ts", delay).alias("a")
    b = right.withWatermark("ts", delay).alias("b")
    on = (F.col("a.game") == F.col("b.game")) & (F.col("a.ref") == F.col("b.ref")) & (F.col("a.cam") < F.col("b.cam"))
    on = on & F.col("b.ts").between(F.col("a.ts") - F.expr(f"interval {tolerance}"), F.col("a.ts") + F.expr(f"interval {tolerance}"))
    return a.join(b, on, "inner").select(F.col("a.game"), F.col("a.ref"), F.col("a.cam").alias("left_cam"), F.col("b.cam").alias("right_cam"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


def possession_sessions(holders: DataFrame, gap: str, delay: str) -> DataFrame:
    """Possession runs as session windows per (game, holder)."""
    return watermarked(holders, "ts", delay).groupBy("game", "holder", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "game", "holder", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a Parquet table (one file set per micro-batch, exactly once)
    and return the table. `path` must be shared storage on a cluster."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_ckpt").trigger(availableNow=True).format("parquet").start(f"{path}/out")
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def run_batches(df: DataFrame, path: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Buffered flush: hand every micro-batch to `sink` (an idempotent write keyed by the batch id)."""
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/_ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
