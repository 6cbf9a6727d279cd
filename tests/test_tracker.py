"""T1 from raw hits, S10 and T2: exactly once, also after crashes, replays and restarts."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from lureline.operators import attribution
from lureline.sources import fixtures as fx
from lureline.sources.commits import CommitLog
from lureline.streaming import tracker
from lureline.streaming.attribution import OUTPUT_SCHEMA, run_folder
from tests.conftest import SF_SMALL

LOG = "id long, v string"


def local(folder):
    return folder.removeprefix("file://").removeprefix("file:")


@pytest.fixture()
def base(spark):
    return run_folder(spark, "test-tracker")


def test_a_batch_is_published_once_and_whole(spark, base):
    log = CommitLog(spark, base)
    rows = lambda *r: spark.createDataFrame(list(r), LOG)
    assert log.read("events", LOG).count() == 0 and log.batches() == [] and log.latest("events", LOG).count() == 0
    assert log.append(0, rows((1, "a"), (2, "b")))
    assert not log.append(0, rows((1, "a"), (2, "b")))  # the same batch again
    staged = log.stage(rows((9, "lost")), "events")  # killed before it was published
    assert sorted(r.id for r in log.read("events", LOG).collect()) == [1, 2]
    assert log.append(7, rows((3, "c")))
    assert not log.publish(7, {"events": staged})  # another attempt of the batch came first
    assert sorted(r.id for r in CommitLog(spark, base).read("events", LOG).collect()) == [1, 2, 3]
    assert [r.id for r in log.latest("events", LOG).collect()] == [3]
    assert log.batches() == [0, 7] and log.vacuum() == 1 and log.vacuum() == 0
    assert log.read("events", LOG).count() == 3 and log.read("absent", LOG).count() == 0


def test_a_write_that_fails_half_way_leaves_nothing(spark, base):
    log = CommitLog(spark, base)
    broken = spark.range(10).select("id", F.when(F.col("id") == 9, F.raise_error(F.lit("killed"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="killed"):
        log.append(0, broken)
    assert log.read("events", LOG).count() == 0 and not log.has(0)
    assert log.append(0, spark.range(10).select("id", F.lit("x").alias("v"))) and log.read("events", LOG).count() == 10


def given(spark):
    log, hits, targets = fx.event_log(spark, SF_SMALL), fx.hits(spark, SF_SMALL), fx.targets(spark, SF_SMALL)
    parsed = attribution.parse_hits(hits)
    want = attribution.attribute_hits(attribution.resolve_uids(parsed, targets), log)
    unknown = attribution.unknown_uid_hits(parsed, targets).select("hit_id", "uid", "event_type", "ts")
    return log, hits, targets, want, unknown


def results(spark, base):
    log = CommitLog(spark, f"{base}/tables")
    got = tracker.local_time(log.read("attributed", OUTPUT_SCHEMA), "occurred_at")
    lost = tracker.local_time(log.read("quarantine", tracker.QUARANTINE), "ts")
    return sorted(map(tuple, got.collect())), sorted(map(tuple, lost.collect()))


def test_crashes_replays_and_restarts_change_nothing(spark, base, monkeypatch):
    log, hits, targets, want, unknown = given(spark)
    rows = tracker.raw_rows(log, hits)
    publish, stage, crashes = CommitLog.publish, CommitLog.stage, []

    def run():
        return tracker.start_tracker(spark, f"{base}/in", base, targets)

    def crash_before(self, batch, tables):
        if batch == 1 and not crashes:
            crashes.append(batch)
            raise RuntimeError("killed before the publication")
        return publish(self, batch, tables)

    def crash_after(self, batch, tables):
        done = publish(self, batch, tables)
        if batch == 2 and len(crashes) == 1:
            crashes.append(batch)
            raise RuntimeError("killed after the publication, before the stream took note")
        return done

    class Retried:
        """A stream that its owner starts again after a crash."""
        def __init__(self):
            self.query = run()

        def awaitTermination(self):
            for _ in range(3):
                try:
                    return self.query.awaitTermination()
                except Exception:
                    self.query = run()
            raise AssertionError("the stream never ended")

    monkeypatch.setattr(CommitLog, "publish", lambda self, b, t: crash_after(self, b, t) if crashes else crash_before(self, b, t))
    tracker.feed(spark, rows, f"{base}/in", Retried, ranges=4)
    assert crashes == [1, 2] and CommitLog(spark, f"{base}/tables").batches() == [0, 1, 2, 3]
    expected = sorted(map(tuple, want.collect())), sorted(map(tuple, unknown.collect()))
    assert results(spark, base) == expected and len(expected[0]) > 0 and len(expected[1]) > 0
    # the stream forgets its last batch and runs it again
    commits = sorted(glob.glob(f"{local(base)}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    os.remove(os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc"))
    run().awaitTermination()
    assert results(spark, base) == expected
    # nothing new: nothing happens
    run().awaitTermination()
    assert results(spark, base) == expected


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def delivery(target, minute, event, campaign=1):
    return (0, at(minute), event, target, campaign, campaign * 10, None)


def hit(uid, minute, number):
    return (1, at(minute), number, None, None, None, f"https://t.example/click?uid={uid}")


def stream(spark, base, batches, **settings):
    targets = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "id long, uid string")
    for rows in batches:
        spark.createDataFrame(rows, tracker.RAW_SCHEMA).write.mode("append").parquet(f"{base}/in")
        tracker.start_tracker(spark, f"{base}/in", base, targets, **settings).awaitTermination()
    log = CommitLog(spark, f"{base}/tables")
    got = sorted((r.hit_id, r.delivery_id) for r in log.read("attributed", OUTPUT_SCHEMA).collect())
    lost = sorted(r.hit_id for r in log.read("quarantine", tracker.QUARANTINE).collect())
    return got, lost, log.latest("state", tracker.STATE)


def routes():
    from lureline.constants import HIT_ROUTES
    return next(iter(HIT_ROUTES))


def test_state_over_micro_batches(spark, base):
    path = routes()
    h = lambda uid, minute, n: (*hit(uid, minute, n)[:6], f"https://t.example{path}?uid={uid}")
    batches = [
        [delivery(1, 0, 10), h("u1", -1, 99)],  # a hit before any delivery
        [delivery(1, 60, 11), h("u1", 30, 20), h("nobody", 31, 21), delivery(2, 61, 12)],
        [h("u1", 59, 22), h("u1", 60, 23), h("u2", 60, 24), h("u2", 61, 25)],
        [delivery(1, 300, 13), h("u1", 299, 26), h("u1", 900, 27), (1, None, 28, None, None, None, "x")],
    ]
    got, lost, state = stream(spark, base, batches)
    assert got == [(20, 10), (22, 10), (23, 11), (25, 12), (26, 11), (27, 13)] and lost == [21, 28]
    assert sorted((r.target_id, r.id) for r in state.collect()) == [(1, 11), (1, 13), (2, 12)]


def test_ttl_forgets_targets(spark, base):
    day = 24 * 60
    path = routes()
    h = lambda uid, minute, n: (*hit(uid, minute, n)[:6], f"https://t.example{path}?uid={uid}")
    got, _, state = stream(spark, base, [[delivery(1, 0, 10)], [delivery(2, 40 * day, 11)], [h("u1", 41 * day, 20), h("u2", 41 * day, 21)]],
                           ttl="30 days")
    assert got == [(21, 11)] and [r.target_id for r in state.collect()] == [2]


def test_totals_survive_replays_and_crashes(spark, base, monkeypatch):
    log = fx.event_log(spark, SF_SMALL)
    want = sorted(map(tuple, log.groupBy("event_type").count().collect()))
    rows = log.select("id", "event_type", F.col("occurred_at").cast("timestamp").alias("ts"))
    publish, crashes = CommitLog.publish, []

    def crash(self, batch, tables):
        if batch in (1, 2) and crashes.count(batch) == 0:
            crashes.append(batch)
            if batch == 2:
                publish(self, batch, tables)
            raise RuntimeError("killed")
        return publish(self, batch, tables)

    class Retried:
        def __init__(self):
            self.query = tracker.start_totals(spark, f"{base}/in", base)

        def awaitTermination(self):
            try:
                self.query.awaitTermination()
            except Exception:
                tracker.start_totals(spark, f"{base}/in", base).awaitTermination()

    monkeypatch.setattr(CommitLog, "publish", crash)
    tracker.feed(spark, rows, f"{base}/in", Retried, ranges=3)
    assert crashes == [1, 2]
    got = CommitLog(spark, f"{base}/tables").latest("totals", tracker.TOTALS)
    assert sorted(map(tuple, got.select("event_type", "events").collect())) == want
