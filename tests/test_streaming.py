"""Streams must give the batch result for everything the watermark has passed."""

import random

import pandas as pd

from courtloom.operators import tracking as T
from courtloom.streaming import stateful as Z


def as_stream(spark, df, tmp_path, files=1):
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_online_ball_equals_batch(spark, tmp_path):
    """Frames arrive out of order over two micro-batches (within the allowed lateness); a third moves the
    watermark past them."""
    rng = random.Random(2)
    rows = [(0, 0, f, 400.0 + 20 * f + rng.random(), 500.0 + rng.random(), 0.3) for f in range(90) if f % 11]
    late = {f for f in range(30, 60) if rng.random() < 0.5}
    parts = [[r for r in rows if r[2] < 60 and r[2] not in late], [r for r in rows if r[2] >= 60 or r[2] in late], [(9, 9, 4000, 0.0, 0.0, 0.3)]]
    schema = "game long, chunk long, frame long, cx double, cy double, score double"
    for p in parts:
        spark.createDataFrame(p, schema).withColumn("ts", Z.event_time("frame")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = Z.run_available(Z.track_ball_online(stream, "2 seconds"), str(tmp_path / "o"))
    got = {(r.frame, r.bx, r.by) for r in out.filter("game = 0").collect()}
    want = {(r.frame, r.bx, r.by) for r in T.track_ball(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) > 80


def test_online_holder_in_order(spark, tmp_path):
    rows = [(0, 0, f, "HOLD", "a" if f < 10 else "b") for f in range(20)] + [(9, 9, 4000, "GAP", None)]
    df = spark.createDataFrame(rows, "game long, chunk long, frame long, state string, top string").withColumn("ts", Z.event_time("frame"))
    out = Z.run_available(Z.hold_online(as_stream(spark, df, tmp_path), 6, 3), str(tmp_path / "o"))
    assert sorted((r.frame, r.holder) for r in out.collect()) == [(5, "a"), (15, "b")]


def test_expired_track_re_enters(spark, tmp_path):
    rows = [(0, 1, f) for f in (0, 1, 2, 100, 101)] + [(9, 9, 4000)]
    df = spark.createDataFrame(rows, "game long, gid long, frame long").withColumn("ts", Z.event_time("frame"))
    out = Z.run_available(Z.expire_tracks(as_stream(spark, df, tmp_path), 60), str(tmp_path / "o"))
    assert sorted((r.frame, r.event) for r in out.filter("game = 0").collect()) == [(0, "enter"), (100, "reentry")]


def test_reads_stop_after_the_claim(spark, tmp_path):
    rows = [(0, 0, 1, f, 7.0, 0.9, f == 20) for f in range(40)] + [(9, 0, 1, 4000, None, 0.0, False)]
    df = spark.createDataFrame(rows, "game long, cam long, track_id long, frame long, num double, conf double, contact boolean").withColumn("ts", Z.event_time("frame"))
    out = Z.run_available(Z.triggered_reads(as_stream(spark, df, tmp_path), heartbeat=30, burst=3), str(tmp_path / "o"))
    assert [r.frame for r in out.filter("game = 0").orderBy("frame").collect()] == [0, 1, 20, 21, 22, 23]


class Cells:
    """Keyed state in memory, counting the bytes that are written."""

    def __init__(self, count):
        self.values, self.count, self.value = {}, count, None

    def getValue(self, key):
        return self.values.get(key)

    def updateValue(self, key, value):
        self.count["bytes"] += len(value[0])
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def keys(self):
        return iter(list(self.values))

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.count["bytes"] += len(value[0])
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.count, self.timers, self.cells = {"bytes": 0}, set(), {}

    def getMapState(self, name, *_):
        return self.cells.setdefault(name, Cells(self.count))

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def steps_of(handle, step=lambda s, f, rows: [(f, len(rows))], expire=60_000):
    steps = Z.FrameSteps(["game"], "ts", "frame", ["frame", "x"], ["at", "n"], list, step, expire, 1000)
    steps.init(handle)
    return steps


def frames(numbers, wide=50):
    return pd.DataFrame({"game": 0, "ts": pd.to_datetime([f * 100 for f in numbers], unit="ms"), "frame": list(numbers), "x": ["x" * wide] * len(numbers)})


def test_a_trigger_writes_what_is_new(spark):
    """Rows wait for a watermark that is far behind; the bytes of a trigger follow its own rows and not those that wait."""
    handle, written = Handle(), []
    steps = steps_of(handle)
    for k in range(20):
        before = handle.count["bytes"]
        out = list(steps.handleInputRows((0,), iter([frames(range(100 * k, 100 * k + 100))]), Mark(0)))
        assert not len(out[0])
        written.append(handle.count["bytes"] - before)
    assert max(written) < 1.2 * min(written)
    before = handle.count["bytes"]
    (out,) = steps.handleExpiredTimer((0,), Mark(150_050), None)
    assert out["at"].tolist() == list(range(1501)) and handle.count["bytes"] - before < max(written)      # one span is split, the machine is written
    assert len(handle.timers) == 1 and sorted(handle.cells["waiting"].values) == [(k,) for k in range(150, 200)]


def test_rows_in_any_order_are_stepped_once_and_keys_are_forgotten(spark):
    rng = random.Random(1)
    numbers = list(range(300))
    rng.shuffle(numbers)
    handle, seen = Handle(), []
    steps = steps_of(handle)
    for k in range(0, 300, 60):
        part = numbers[k : k + 60]
        seen += list(steps.handleInputRows((0,), iter([frames(part[:30]), frames(part[30:])]), Mark(-1 if k < 240 else 15_000)))[0]["at"].tolist()
    assert seen == list(range(150))
    at = min(handle.timers)
    seen += list(steps.handleExpiredTimer((0,), Mark(40_000), None))[0]["at"].tolist()
    assert seen == list(range(300)) and not handle.cells["waiting"].values and at not in handle.timers
    (retire,) = handle.timers
    assert handle.cells["machine"].exists() and not len(list(steps.handleExpiredTimer((0,), Mark(retire - 1), None))[0]) and handle.cells["machine"].exists()
    list(steps.handleExpiredTimer((0,), Mark(retire), None))
    assert not handle.cells["machine"].exists() and not handle.timers
