"""Windows of streams against windows of the same bars read at once."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barlane.streaming.live_windows import live_windows

SCHEMA = "series_id long, time_step long, close double, event_time timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = (None, None, None, START + timedelta(days=900))


def bar(series, step):
    return series, step, float(series * 1000 + step), START + timedelta(minutes=step)


class Stream:
    """A folder of files, a checkpoint and an output; run() reads what is new, a file a batch."""

    def __init__(self, spark, folder, **options):
        self.spark, self.at, self.options, self.files = spark, f"{folder}/{uuid.uuid4().hex}", options, 0

    def add(self, rows):
        import os
        import time

        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.at}/new{self.files}")
        os.makedirs(f"{self.at}/in", exist_ok=True)
        [name] = [f for f in os.listdir(f"{self.at}/new{self.files}") if f.startswith("part-")]
        os.rename(f"{self.at}/new{self.files}/{name}", f"{self.at}/in/{self.files:03d}.parquet")
        now = time.time() - 10_000 + self.files
        os.utime(f"{self.at}/in/{self.files:03d}.parquet", (now, now))
        self.files += 1

    def run(self):
        bars = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/in")
        out = live_windows(bars, window=7, input_len=6, **self.options)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{self.at}/checkpoint").option("path", f"{self.at}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(f"{self.at}/out").collect()


def windows(rows):
    return sorted((r["series_id"], r["start"], r["last_input"], r["last_target"]) for r in rows if r["kind"] == "window")


def late(rows):
    return sorted((r["series_id"], r["time_step"], r["close"]) for r in rows if r["kind"] == "late")


def expected(bars):
    out = []
    for s in {b[0] for b in bars}:
        closes = [c for _, c in sorted((b[1], b[2]) for b in bars if b[0] == s)]
        out += [(s, i, closes[i + 5], closes[i + 6]) for i in range(len(closes) - 6)]
    return sorted(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("streams"))


def test_bars_out_of_order_and_a_restart(spark, folder):
    bars = [bar(s, t) for s, n in ((1, 60), (2, 6), (3, 7), (4, 33)) for t in range(n)]
    rng = random.Random(1)
    arriving = sorted(bars, key=lambda b: b[1] + rng.uniform(0, 8))
    s = Stream(spark, folder, wait=timedelta(minutes=10), told=timedelta(hours=1))
    cuts = [0, 30, 31, 60, 80, len(bars)]
    for a, b in zip(cuts[:3], cuts[1:4], strict=False):
        s.add(arriving[a:b])
    first = s.run()
    assert windows(first) and set(windows(first)) < set(expected(bars)) and not late(first)
    for a, b in zip(cuts[3:], cuts[4:], strict=False):
        s.add(arriving[a:b])
    s.add([END])
    done = s.run()
    assert windows(done) == expected(bars) and not late(done)


def test_late_bars_are_told(spark, folder):
    bars = [bar(1, t) for t in range(40)]
    s = Stream(spark, folder, wait=timedelta(minutes=5), told=timedelta(hours=1))
    s.add([b for b in bars if b[1] not in (10, 39)])
    s.add([bar(2, 50)])  # moves the clock past steps up to 38 of series 1
    s.add([bars[10], bars[39]])  # one too late, the other in time
    s.add([END])
    rows = s.run()
    assert late(rows) == [(1, 10, 1010.0)]
    assert windows(rows) == expected([b for b in bars if b[1] != 10])


def test_equal_steps_and_null_closes(spark, folder):
    bars = [bar(1, t) for t in range(10)]
    s = Stream(spark, folder, wait=timedelta(minutes=5), told=timedelta(hours=1))
    s.add([*bars, bars[4], bars[4]])
    s.add([END])
    assert windows(s.run()) == expected([*bars, bars[4], bars[4]])


def test_a_closing_row_in_the_batch_of_the_bars(spark, folder):
    bars = [bar(s, t) for s in range(16) for t in range(9)]
    s = Stream(spark, folder, wait=timedelta(minutes=5), told=timedelta(hours=1))
    s.add([*bars, END])
    assert windows(s.run()) == expected(bars)


def test_waiting_longer_than_telling_is_refused(spark):
    with pytest.raises(ValueError):
        live_windows(spark.range(1).select(F.col("id").alias("series_id")), wait=timedelta(hours=2), told=timedelta(hours=1))


def test_the_processor_needs_no_import_path():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from barlane.streaming.live_windows import LiveWindows

    sent = cloudpickle.dumps(LiveWindows(7, 6, 1, 2))
    code = "import sys; from pyspark import cloudpickle; print(cloudpickle.loads(sys.stdin.buffer.read()).window, 'barlane' in sys.modules)"
    assert subprocess.run([sys.executable, "-P", "-c", code], input=sent, capture_output=True, cwd="/", env={}).stdout.split() == [b"7", b"False"]


def test_a_part_of_many_files_loses_no_window(spark, sf_dir, monkeypatch):
    from barlane.operators.windows import window_arrays
    from barlane.plans import queries
    from barlane.sources import fixtures

    monkeypatch.setattr(queries, "FILES", 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a file for each of 4 partitions
    try:
        got = queries.streaming_windows(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = window_arrays(fixtures.bars(spark, sf_dir)).select("series_id", "start").collect()
    assert sorted((r["series_id"], r["start"]) for r in got) == sorted(map(tuple, want))
