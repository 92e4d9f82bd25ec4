"""Stateful operators over event time: rows of a key are taken in their order whatever the order in which they arrive.

A processor holds rows back until the watermark has passed them, so results do not depend on how a stream is cut into micro-batches. State
of a key that has been silent for long is dropped by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEPT_DAYS = 90  #: days after which the state of a silent key is dropped


def _millis(ts: pd.Series) -> pd.Series:
    return ts.map(lambda x: int(x.timestamp() * 1000))


class InOrder(StatefulProcessor):
    """Rows (ts, event_id, ...) of a key, handed to ``advance`` in the order of ts and event_id once the watermark has passed them."""

    columns: list[tuple[str, str]]  #: names and types of the rows that are held back, ts and event_id first
    kept: str  #: type of what is known of the key, when it was learned first
    kept_days = KEPT_DAYS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.known = handle.getValueState("known", self.kept)
        self.wakes = handle.getMapState("wakes", "at long", "why string")  # timers, so that a stale one is told apart

    def advance(self, key: tuple, known: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None]:
        """What the rows give, and what is known of the key from now on; None drops it."""
        raise NotImplementedError

    def _tuples(self, rows: pd.DataFrame) -> list[tuple]:
        """The held columns as rows of plain values; pandas makes whole numbers with nulls to floats."""
        plain = {"long": int, "timestamp": lambda x: x.to_pydatetime(), "string": str}
        columns = [[None if pd.isna(x) else plain[t](x) for x in rows[n]] for n, t in self.columns]
        return list(zip(*columns))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the API
        new = pd.concat(list(rows))
        self.held.appendList(self._tuples(new))
        self.handle.registerTimer(int(_millis(new["ts"]).min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.held.get())
        known = self.known.get() if self.known.exists() else None
        if not held:  # a timer of rows that went with an earlier one, or the last of a silent key
            if known and now - _millis(pd.Series([known[0]])).iloc[0] > self.kept_days * 86_400_000:
                self.known.clear()
            return
        rows = pd.DataFrame(held, columns=[n for n, _ in self.columns])
        ready = _millis(rows["ts"]) <= now
        later, rows = rows[~ready], rows[ready].sort_values(["ts", "event_id"], ignore_index=True)
        if not len(rows):
            return
        self.held.clear()
        if len(later):
            self.held.put(self._tuples(later))
            self.handle.registerTimer(int(_millis(later["ts"]).min()))
        if known and rows["ts"].iloc[0] - known[0] > pd.Timedelta(days=self.kept_days):
            known = None  # whether or not the timer has come first
        out, known = self.advance(key, known, rows)
        if known is None:
            self.known.clear()
        else:
            self.known.update(known)
            self.handle.registerTimer(int(_millis(rows["ts"]).max()) + self.kept_days * 86_400_000 + 1)
        if len(out):
            yield out

    def close(self) -> None:
        pass


class Growth(InOrder):
    """The change of a counter since the reading before, if that was good; an error breaks the chain."""

    columns = [("ts", "timestamp"), ("event_id", "long"), ("counter", "long"), ("version", "string")]
    kept = "ts timestamp, counter long, version string"
    output = "entity long, obs_id long, state string, growth long, hours double, per_hour double"

    def advance(self, key, known, rows):
        first = pd.DataFrame([known or (pd.NaT, None, None)], columns=["ts", "counter", "version"])
        every = pd.concat([first, rows[["ts", "counter", "version"]]], ignore_index=True).astype({"counter": "Int64"})
        before, now = every.shift(1).iloc[1:], every.iloc[1:]
        hours = (pd.to_datetime(now["ts"]) - pd.to_datetime(before["ts"])).dt.total_seconds() / 3600
        good, chained = now["counter"].notna(), before["counter"].notna()
        comparable = good & chained & (now["version"] == before["version"]) & (hours > 0)
        growth = (now["counter"] - before["counter"]).where(comparable)
        state = pd.Series("measured", index=now.index)
        state[comparable & (growth < 0).fillna(False)] = "counter_correction"
        state[good & chained & ~comparable] = "not_comparable"
        state[good & ~chained] = "chain_start"
        state[~good] = "failed"
        rate = (growth / hours).where(comparable & (growth >= 0).fillna(False)).astype("float64")
        out = pd.DataFrame({"entity": key[0], "obs_id": rows["event_id"].to_numpy(), "state": state.to_numpy(), "growth": growth.to_numpy(), "hours": hours.where(good & chained).to_numpy(), "per_hour": rate.to_numpy()})
        out["growth"] = out["growth"].astype("Int64")
        last = rows.iloc[-1]
        return out, None if pd.isna(last["counter"]) else (last["ts"], int(last["counter"]), last["version"])


BUCKETS = 256  #: parts that the keys of a platform are dealt into; fixed, since a state is found again by it


class NewKeys(InOrder):
    """A trend key that a successful run has and the successful run before it had not; the first run of a platform is its baseline.

    A group is a platform and a part of its keys, so that calls and timers do not grow with the keys; within it all keys are taken side by side.
    """

    columns = [("ts", "timestamp"), ("event_id", "long"), ("key", "long"), ("run_at", "timestamp"), ("before_at", "timestamp")]
    output = "platform string, key long, run_at timestamp, detected_at timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.last = handle.getListState("last", "key long, run_at timestamp")  # the last run of every key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the API
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        return super().handleInputRows(key, iter([new.drop_duplicates(["key", "run_at"])]), timerValues)  # the first row of a run is when it is detected

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        kept = pd.Timedelta(days=self.kept_days)
        last = {k: at for k, at in self.last.get() if now - at <= kept}
        rows = pd.DataFrame(list(self.held.get()), columns=[n for n, _ in self.columns]).astype({"ts": "datetime64[us]", "run_at": "datetime64[us]", "before_at": "datetime64[us]"})
        ready = rows["ts"].dt.floor("ms") <= now
        later, runs = rows[~ready], rows[ready].sort_values(["ts", "event_id"]).drop_duplicates(["key", "run_at"], ignore_index=True)
        if len(runs):
            known = pd.to_datetime(runs["key"].map(last)).astype("datetime64[us]")
            told = runs["run_at"] == known  # rows of a run that was begun before
            runs, known = runs[~told], known[~told]
            before = runs.groupby("key")["run_at"].shift(1)
            before = before.fillna(known.where(~runs["key"].duplicated()))
            fresh = runs[runs["before_at"].notna() & (before != runs["before_at"])]
            last.update(zip(runs["key"].tolist(), (t.to_pydatetime() for t in runs["run_at"])))
            if len(fresh):
                yield pd.DataFrame({"platform": key[0], "key": fresh["key"], "run_at": fresh["run_at"], "detected_at": fresh["ts"]})
            self.held.clear()
            if len(later):
                self.held.put(self._tuples(later))
                self.handle.registerTimer(int(_millis(later["ts"]).min()))
        self.last.clear()
        if last:
            self.last.put(list(last.items()))
            self.handle.registerTimer(int(_millis(pd.Series([max(last.values())])).iloc[0]) + self.kept_days * 86_400_000 + 1)


def with_state(rows: DataFrame, by: list[str], processor: InOrder) -> DataFrame:
    """Rows with a watermark through a processor, which is kept in a store that every executor can restore."""
    rows.sparkSession.conf.set(PROVIDER, ROCKS)
    return rows.select(*by, *[n for n, _ in processor.columns]).groupBy(*by).transformWithStateInPandas(processor, processor.output, "Append", "EventTime")


def chained_growth(events: DataFrame, change: str, delay: str = "10 minutes") -> DataFrame:
    """Growth of each entity's counter, the event's value in whole units; from ``change`` on it counts another way and is not comparable."""
    counter = F.when(F.col("event_type") != "error", F.floor("value").cast("long"))
    version = F.when(F.col("ts") < F.lit(change).cast("timestamp"), "v1").otherwise("v2")
    return with_state(events.select("user_id", "ts", "event_id", counter.alias("counter"), version.alias("version")).withWatermark("ts", delay), ["user_id"], Growth())


def new_keys(events: DataFrame, runs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """New (platform, key) of each successful run; ``runs`` is (platform, run_at, before_at): successful runs and the one before."""
    day = F.date_trunc("day", "ts")
    rows = events.withWatermark("ts", delay).select(F.col("event_type").alias("platform"), F.col("user_id").alias("key"), "ts", "event_id", day.alias("run_at"))
    rows = rows.join(runs, ["platform", "run_at"]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return with_state(rows, ["platform", "bucket"], NewKeys())


def for_watchers(found: DataFrame, sessions: DataFrame, follows: DataFrame) -> DataFrame:
    """(session, platform, key, detected_at) by the mode of each session: all, following what it follows since before, or off."""
    mine = follows.select("session", "key", "created_at")
    following = found.join(mine, "key").where("created_at <= detected_at").join(sessions.where("mode = 'following'").select("session"), "session")
    firsts = found.groupBy("platform", "key").agg(F.min("detected_at").alias("detected_at"))  # only the first is told, so no other is multiplied by the sessions
    everyone = firsts.join(sessions.where("mode = 'all'").select("session"), F.lit(True))
    columns = ["session", "platform", "key", "detected_at"]
    return everyone.select(columns).unionByName(following.select(columns))  # a session may get one twice; what stores them keeps the first
