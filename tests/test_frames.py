"""Frames that can be read again, admission by number and age, and a batch that fails."""

import zlib

import pytest

from orrery.sources import feeds, frames


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now


def reader(tmp_path, pending, clock, **options):
    def connect():
        return lambda: [pending.pop(0) for _ in range(min(len(pending), 150))]

    return frames.FrameReader(connect, frames.FrameLog(str(tmp_path / "log")), frames.Admission(clock=clock, **options), sleep=lambda s: None)


def test_flush_by_rows_or_time(tmp_path):
    clock, pending = Clock(), [b"%d" % i for i in range(330)]
    r = reader(tmp_path, pending, clock)
    at = r.initialOffset()
    sizes = []
    for tick in (0.0, 0.1, 0.2, 0.3, 0.9, 1.3, 1.4):
        clock.now = tick
        got, at = r.read(at)
        sizes.append(len(list(got)))
    # 150 wait; 300 have come, so that 200 go; 130 wait until one second after the oldest of them came
    assert sizes == [0, 200, 0, 0, 0, 130, 0] and at == {"n": 330}


def test_queue_is_bounded(tmp_path):
    clock, pending = Clock(), [b"x"] * 5000
    r = reader(tmp_path, pending, clock, rows=10, queue=300)
    at = r.initialOffset()
    for _ in range(20):
        _, at = r.read(at)
        assert len(r.admission.waiting) < 300 + 150
    assert len(pending) >= 5000 - 200 - 450


def test_log_survives_a_reader(tmp_path):
    clock, pending = Clock(), [b"%d" % i for i in range(40)]
    r = reader(tmp_path, pending, clock, rows=15, seconds=0.0)
    got, one = r.read(r.initialOffset())
    got, two = r.read(one)
    assert [n for n, _ in got] == list(range(15, 30))
    r.commit(one)
    # a new reader: the batch from one on is read again, before anything new
    again = reader(tmp_path, [b"new"], clock, rows=15, seconds=0.0)
    assert again.initialOffset() == {"n": 15}
    assert list(again.readBetweenOffsets(one, two)) == [(n, b"%d" % n) for n in range(15, 30)]
    rows, end = again.read(one)
    assert (list(rows), end) == ([(n, b"%d" % n) for n in range(15, 30)], two)
    rows, end = again.read(two)
    assert (list(rows), end) == ([(30, b"new")], {"n": 31})
    again.commit(end)
    assert again.log.span() == (0, 0)


def test_reconnects_with_longer_waits(tmp_path):
    waits, tries = [], []

    def connect():
        tries.append(1)
        raise OSError("no network")

    r = frames.FrameReader(connect, frames.FrameLog(str(tmp_path / "log")), frames.Admission(), sleep=waits.append)
    for _ in range(8):
        assert list(r.read({"n": 0})[0]) == []
    assert waits == [1, 2, 4, 8, 16, 32, 60, 60] and r.reconnects == len(tries) == 8


def test_failed_batch_gets_the_same_frames(spark, tmp_path):
    sent = [zlib.compress(b'{"n":%d}' % i) for i in range(25)]
    folder = str(tmp_path / "feed")

    def connect(sent=sent):
        # each process that connects is sent everything once
        left = list(sent)
        return lambda: [left.pop(0) for _ in range(len(left))]

    spark.dataSource.register(frames.frame_source("test_frames", connect, folder + "/log", rows=10, seconds=0.1))
    seen = {}

    def run(fail):
        def batch(df, n):
            rows = [(r.seq, r.json) for r in df.select("seq", feeds.inflate("frame").alias("json")).orderBy("seq").collect()]
            seen.setdefault(n, []).append(rows)
            if fail and n == 1:
                raise RuntimeError("lost")

        stream = spark.readStream.format("test_frames").load()
        return stream.writeStream.option("checkpointLocation", folder + "/checkpoint").trigger(processingTime="0 seconds").foreachBatch(batch).start()

    query = run(True)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(60)
    spark.dataSource.register(frames.frame_source("test_frames", lambda: lambda: [], folder + "/log", rows=10, seconds=0.1))
    query = run(False)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen[0] == [[(i, '{"n":%d}' % i) for i in range(10)]]
    assert len(seen[1]) == 2 and seen[1][0] == seen[1][1] == [(i, '{"n":%d}' % i) for i in range(10, 20)]
