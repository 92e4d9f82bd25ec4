"""Streams over several micro-batches: state carries over, late rows are dropped, replays pass once."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from trendloom.streaming import jobs as J
from trendloom.streaming import stateful as S
from trendloom.streaming.tables import COMPACT, MergedTable

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def at(h, m=0, s=0):
    return d.datetime(2024, 1, 1) + d.timedelta(hours=h, minutes=m, seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    """A function from lists of rows, one list a micro-batch, to a streaming DataFrame."""
    import os
    import time

    def make(*batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            for f in (tmp_path / f"b{i}").glob("*.parquet"):
                os.utime(f, (time.time() - 1000 + i * 10,) * 2)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b*"))

    return make


def row(i, t, user=1, kind="view", value=1.0):
    return (i, t, user, kind, value, "{}")


def test_hour_archive_drops_late_rows_and_keeps_open_hours(stream):
    got = J.drain(J.hour_archive(stream([row(1, at(0, 5)), row(2, at(0, 50))], [row(3, at(5))], [row(5, at(5, 1))], [row(4, at(0, 55)), row(6, at(5, 2))]))).collect()
    assert [(r.n, r.first_sample, r.last_sample) for r in got] == [(2, 1, 2)]  # the late row and hour 5 are missing


def test_replays_pass_once(stream):
    batch = [row(1, at(0)), row(2, at(0, 1), user=2)]
    assert J.drain(J.once_per_key(stream(batch, batch, [row(3, at(1))]), ["event_type", "user_id"])).count() == 2


def test_session_gap_of_exactly_ninety_minutes(stream):
    got = J.drain(J.sessions(stream([row(1, at(0)), row(2, at(1, 30)), row(3, at(3, 0, 1))], [row(4, at(20))]))).orderBy("first_at").collect()
    assert [r.n for r in got] == [2, 1]


CHANGE = "2030-01-01"


class Feed:
    """A folder of event files; ``more`` adds rows, and the stream reads what is new since its last run."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def more(self, *rows):
        import os
        import time

        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(f"{self.folder}/b{self.n}")
        for f in self.folder.glob(f"b{self.n}/*.parquet"):
            os.utime(f, (time.time() - 1000 + self.n * 10,) * 2)
        self.n += 1
        return self

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/b*")


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


END = row(99, at(1000), user=99)  # moves the watermark past all other rows


def growth(feed, path):
    return {r.obs_id: (r.state, r.growth, r.per_hour) for r in J.drain(S.chained_growth(feed.stream(), CHANGE), path=path).collect()}


def test_growth_goes_on_over_restarts_and_breaks_at_errors(feed, tmp_path):
    path = str(tmp_path / "job")
    growth(feed.more(row(1, at(0), value=5.0), row(2, at(2), value=8.5)), path)
    growth(feed.more(row(3, at(3), value=7.0), row(4, at(4), kind="error")), path)  # a new run of the job, from its state
    got = growth(feed.more(row(5, at(5), value=20.0), row(6, at(5), value=21.0)).more(END), path)
    assert got == {1: ("chain_start", None, None), 2: ("measured", 3, 1.5), 3: ("counter_correction", -1, None), 4: ("failed", None, None), 5: ("chain_start", None, None), 6: ("not_comparable", None, None)}


def test_growth_takes_rows_in_the_order_of_time(feed, tmp_path):
    got = growth(feed.more(row(2, at(0, 4), value=8.0), row(9, at(0, 1), user=2, value=1.0)).more(row(1, at(0), value=5.0)).more(END), str(tmp_path / "job"))
    assert got[1] == ("chain_start", None, None) and got[2] == ("measured", 3, 45.0) and got[9][0] == "chain_start"


def test_growth_is_not_compared_over_a_change_of_the_metric(feed, tmp_path):
    feed.more(row(1, d.datetime(2029, 12, 31), value=5.0), row(2, d.datetime(2030, 1, 2), value=9.0), row(3, d.datetime(2030, 2, 1), user=9))
    assert growth(feed, str(tmp_path / "job"))[2] == ("not_comparable", None, None)


def test_silent_keys_are_forgotten(feed, tmp_path):
    path = str(tmp_path / "job")
    growth(feed.more(row(1, at(0), value=5.0)).more(row(2, at(24 * 100), user=2)), path)
    got = growth(feed.more(row(3, at(24 * 101), value=9.0)).more(row(4, at(24 * 102), user=2)), path)
    assert got[3] == ("chain_start", None, None)


def test_merge_keeps_the_newest_over_restarts(feed, tmp_path):
    path = str(tmp_path / "latest")
    latest = lambda: {r.user_id: r.event_id for r in J.merge_latest(feed.stream().select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], path).collect()}
    feed.more(row(1, at(0)), row(2, at(3), user=2))
    assert latest() == {1: 1, 2: 2}
    feed.more(row(3, at(1)), row(4, at(2), user=2), row(5, at(3), user=2))
    assert latest() == {1: 3, 2: 5}
    assert latest() == {1: 3, 2: 5}  # nothing new


def test_a_batch_is_merged_once_and_parts_are_brought_together(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(n % 3, n)], "k long, n long")
    total = lambda r: r.groupBy("k").agg(F.sum("n").alias("n"))
    path = str(tmp_path / "t")
    for n in range(1, 21):
        table = MergedTable(spark, path, "k long, n long", total)  # each batch by a new process
        assert table.apply(rows(n), n)
        assert not table.apply(rows(n), n)
    assert {r.k: r.n for r in table.read().collect()} == {k: sum(n for n in range(1, 21) if n % 3 == k) for k in range(3)}
    assert len(table.parts()) <= COMPACT + 1
    (tmp_path / "t/parts/torn").mkdir()  # left by a run that broke off: no manifest names it
    assert {r.k for r in table.read().collect()} == {0, 1, 2}
    assert MergedTable(spark, str(tmp_path / "none"), "k long", lambda r: r).read().collect() == []


def test_late_rows_widen_the_archive_and_are_listed(feed, tmp_path):
    path = str(tmp_path / "late")
    run = lambda: J.late_audit(feed.stream(), path)
    run_1, audit_1 = run() if feed.more(row(1, at(24 * 100, 30)), row(2, at(24 * 100, 40))) else None
    assert audit_1.collect() == [] and [(r.n, r.first_sample, r.last_sample) for r in run_1.collect()] == [(2, 1, 2)]
    feed.more(row(3, at(24 * 100, 20)), row(4, at(24 * 100, 29)), row(5, at(24 * 100, 45)), row(6, at(24 * 90)), row(7, at(24)))
    archive, audit = run()  # a restart
    assert {r.bucket_at: (r.n, r.first_sample, r.last_sample) for r in archive.collect()} == {at(24 * 100): (5, 3, 5), at(24 * 90): (1, 6, 6)}
    assert {r.event_id: (r.state, r.widened) for r in audit.collect()} == {3: ("fresh", "first"), 4: ("fresh", "first"), 6: ("archived", "new"), 7: ("expired", "none")}


def test_notices_by_mode_and_once_per_session_and_key(spark, feed, tmp_path):
    day = lambda n, h=1: at(24 * n + h)
    runs = spark.createDataFrame([("view", day(0, 0), None), ("view", day(1, 0), day(0, 0)), ("view", day(3, 0), day(1, 0)), ("view", day(4, 0), day(3, 0))], "platform string, run_at timestamp, before_at timestamp")  # day 2 failed
    sessions = spark.createDataFrame([("a", "all"), ("f", "following"), ("late", "following"), ("o", "off")], "session string, mode string")
    follows = spark.createDataFrame([("f", 2, day(0)), ("late", 2, day(9)), ("o", 2, day(0))], "session string, key long, created_at timestamp")
    path, job = str(tmp_path / "notices"), lambda: J.notifications(S.new_keys(feed.stream(), runs), sessions, follows, path)
    feed.more(row(1, day(0), user=1), row(2, day(1), user=1), row(3, day(1), user=2), row(4, day(2), user=3))
    job()
    feed.more(row(5, day(3), user=1), row(6, day(4), user=1), row(7, day(4), user=2)).more(END)
    got = sorted((r.session, r.key, r.detected_at) for r in job().collect())
    # key 1 was in the first run and all later ones; key 2 is new on day 1, and again on day 4, which is told once; day 2 does not count
    assert got == [("a", 2, day(1)), ("f", 2, day(1))]


def test_more_rows_of_a_run_do_not_make_a_key_new(spark, feed, tmp_path):
    day = lambda n, h=1: at(24 * n + h)
    runs = spark.createDataFrame([("view", day(0, 0), None), ("view", day(1, 0), day(0, 0))], "platform string, run_at timestamp, before_at timestamp")
    sessions = spark.createDataFrame([("a", "all")], "session string, mode string")
    follows = spark.createDataFrame([], "session string, key long, created_at timestamp")
    job = lambda: J.notifications(S.new_keys(feed.stream(), runs), sessions, follows, str(tmp_path / "notices"))
    feed.more(row(1, day(0), user=1), row(2, day(1), user=1), row(3, day(1, 5), user=9))
    job()  # key 1 is known from day 0
    feed.more(row(4, day(1, 6), user=1), row(5, day(1, 7), user=2)).more(END)  # the stream is cut within day 1
    assert sorted((r.key, r.detected_at) for r in job().collect()) == [(2, day(1, 7)), (9, day(1, 5))]
    assert S.NewKeys.columns[2][0] == "key"  # keys are rows of a group and no groups of their own
