"""Live features and counterparty history: what the batch operators give, from state of bounded size.

Both run as stateful processors, one state a key. Features keep the ticks of the long window; history keeps counts for
each time at which labels become known, until the watermark has passed it and the next timer adds them to the totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..deploy import ship
from ..operators.features import CORE, LONG, PRIOR_RATE, PRIOR_WEIGHT, SHORT
from ..plans.series import DAY_NS, seconds

#: What is kept of a tick.
_KEPT = ("ts_ns", "seq", "mid", "spread", "obi", "micro_dev", "volume", "square")
_TICK_STATE = "ts_ns long, seq long, mid double, spread double, obi double, micro_dev double, volume double, square double"
#: Columns of a stream of ticks and fills, see ticks_and_fills().
EVENTS = "symbol string, kind int, ts_ns long, seq long, bid double, ask double, bid_size double, ask_size double, volume double, fill_id long, size double"


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the store on disk; its files go to the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LiveFeatures:
    """The trailing window of one instrument's ticks, and features of fills from it.

    Ticks older than ``long_seconds`` (and ``grace_seconds`` more, for fills that come late) before the newest event are
    let go, but for the last two, which say what the quote is and when it changed. Sums are taken over the window's
    ticks, never carried from one eviction to the next, so nothing drifts.
    """

    def __init__(self, short_seconds: float = SHORT, long_seconds: float = LONG, grace_seconds: float = 0.0, kept: Sequence[tuple] = ()):
        self.short_seconds, self.short, self.long = short_seconds, seconds(short_seconds), seconds(long_seconds)
        self.reach = self.long + seconds(grace_seconds)
        columns = zip(*kept, strict=True) if kept else [()] * len(_KEPT)
        kinds = (np.int64, np.int64, *[np.float64] * 6)
        self.t = {name: np.array(values, kind) for name, values, kind in zip(_KEPT, columns, kinds)}
        self.late = 0
        self.missing_before: int | None = None

    def extend(self, ts: np.ndarray, seq: np.ndarray, bid: np.ndarray, ask: np.ndarray, bid_size: np.ndarray, ask_size: np.ndarray, volume: np.ndarray) -> None:
        """Adds ticks; those at or before the last one kept are counted as late and dropped."""
        order = np.lexsort((seq, ts))
        if len(self.t["ts_ns"]):
            last = (self.t["ts_ns"][-1], self.t["seq"][-1])
            new = (ts[order] > last[0]) | ((ts[order] == last[0]) & (seq[order] > last[1]))
            self.late += int((~new).sum())
            order = order[new]
        ts, seq, bid, ask, bid_size, ask_size, volume = (x[order] for x in (ts, seq, bid, ask, bid_size, ask_size, volume))
        mid, spread, depth = (bid + ask) / 2, ask - bid, bid_size + ask_size
        before = np.concatenate((self.t["mid"][-1:] if len(self.t["mid"]) else mid[:1], mid[:-1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            returns = np.where((before > 0) & (mid > 0), np.log(mid / before), 0.0)
            obi = np.where(depth > 0, (bid_size - ask_size) / depth, 0.0)
            micro = np.where((depth > 0) & (spread > 0), ((bid * ask_size + ask * bid_size) / depth - mid) / spread, 0.0)
        new = (ts, seq, mid, spread, obi, micro, volume, returns * returns)
        self.t = {name: np.concatenate((self.t[name], values)) for name, values in zip(_KEPT, new)}

    def snapshot(self, at: np.ndarray, size: np.ndarray, seen: np.ndarray | None = None) -> pd.DataFrame:
        """A row of CORE for each time; ``seen`` is how many of the kept ticks count (all up to the time by default).

        Without a tick at or before the time all are missing, and so they are for times whose window is no longer kept.
        """
        ts, n = self.t["ts_ns"], len(self.t["ts_ns"])
        seen = np.searchsorted(ts, at, "right") if seen is None else seen
        if not n:
            return pd.DataFrame({c: np.full(len(at), np.nan) for c in CORE})
        last, known = np.maximum(seen - 1, 0), seen > 0
        if self.missing_before is not None:
            known &= at - self.long >= self.missing_before
        sums = {c: np.concatenate(([0.0], np.cumsum(self.t[c]))) for c in ("square", "volume", "spread")}
        near, far = (np.minimum(np.searchsorted(ts, at - w, "left"), seen) for w in (self.short, self.long))

        def over(column: str, start: np.ndarray) -> np.ndarray:
            return np.maximum(sums[column][seen] - sums[column][start], 0.0)

        count = seen - near
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(count > 0, over("spread", near) / count, np.nan)
            vol_short = over("volume", near)
            out = {
                "spread": self.t["spread"][last],
                "obi": self.t["obi"][last],
                "micro_dev": self.t["micro_dev"][last],
                "rv_short": np.sqrt(np.where(count > 0, over("square", near), 0.0)),
                "rv_long": np.sqrt(np.where(seen > far, over("square", far), 0.0)),
                "vol_short": vol_short,
                "vol_long": over("volume", far),
                "size_rel_vol": np.where(vol_short > 0, size / vol_short, np.nan),
                "tick_rate": count / self.short_seconds,
                "spread_mean": mean,
                "spread_rel": np.where(mean > 0, self.t["spread"][last] / mean, np.nan),
                "dt_last_tick": np.where(last > 0, (ts[last] - ts[np.maximum(last - 1, 0)]) / 1e9, np.nan),
                "sec_of_day": (ts[last] % DAY_NS) / 1e9,
            }
        return pd.DataFrame({c: np.where(known, out[c], np.nan) for c in CORE})

    def evict(self, now: int) -> None:
        ts = self.t["ts_ns"]
        first = min(int(np.searchsorted(ts, now - self.reach, "left")), max(len(ts) - 2, 0))
        if first > 0:
            self.missing_before = now - self.reach
            self.t = {name: values[first:] for name, values in self.t.items()}

    def rows(self) -> list[tuple]:
        return list(zip(*[self.t[name].tolist() for name in _KEPT]))


_FEATURE_ROWS = "symbol string, fill_id long, ts_ns long, " + ", ".join(f"{c} double" for c in CORE)


class _FeatureProcessor(StatefulProcessor):
    def __init__(self, short_seconds: float, long_seconds: float, grace_seconds: float):
        self.widths = (short_seconds, long_seconds, grace_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("ticks", _TICK_STATE)
        self.marks = handle.getValueState("marks", "late long, newest long, missing_before long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        late, newest, missing = self.marks.get() if self.marks.exists() else (0, None, None)
        live = LiveFeatures(*self.widths, [tuple(r) for r in self.kept.get()])
        live.late, live.missing_before = late, missing
        ticks = batch[batch["kind"] == 0]
        if len(ticks):
            live.extend(*(ticks[c].to_numpy(np.int64 if c in ("ts_ns", "seq") else np.float64) for c in ("ts_ns", "seq", "bid", "ask", "bid_size", "ask_size", "volume")))
        fills = batch[batch["kind"] == 1].sort_values(["ts_ns", "fill_id"])
        newest = max(int(batch["ts_ns"].max()), newest if newest is not None else -(1 << 62))
        if len(fills):
            at = fills["ts_ns"].to_numpy(np.int64)
            found = live.snapshot(at, fills["size"].to_numpy(np.float64))
            found.insert(0, "symbol", key[0])
            found.insert(1, "fill_id", fills["fill_id"].to_numpy(np.int64))
            found.insert(2, "ts_ns", at)
            yield found
        live.evict(newest)
        self.kept.put(live.rows())
        self.marks.update((live.late, newest, live.missing_before))

    def close(self) -> None:
        pass


def ticks_and_fills(ticks: DataFrame, fills: DataFrame) -> DataFrame:
    """One stream of both, with the columns EVENTS. Crossed and locked quotes are left out, null volumes and sizes are 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    quotes = ticks.where("ask > bid").select(
        "symbol", F.lit(0).alias("kind"), "ts_ns", "seq", "bid", "ask", zero("bid_size"), zero("ask_size"), zero("volume"), none("fill_id", "long"), none("size", "double")
    )
    prices = [none(c, "double") for c in ("bid", "ask", "bid_size", "ask_size", "volume")]
    return quotes.unionByName(fills.select("symbol", F.lit(1).alias("kind"), "ts_ns", F.col("fill_id").alias("seq"), *prices, "fill_id", F.col("size").cast("double")))


def feature_stream(events: DataFrame, short_seconds: float = SHORT, long_seconds: float = LONG, grace_seconds: float = 0.0) -> DataFrame:
    """symbol, fill_id, ts_ns and the features CORE of each fill in a stream of ticks and fills (see ticks_and_fills).

    A fill sees the ticks of its time and before that came in its own or an earlier batch; then its row equals
    core_features(). Fills that come later than ``grace_seconds`` after the newest event of earlier batches, whose
    window is no longer kept, have no features. Ticks that come after later ones have been seen are dropped.
    Missing features are null. Bound the files of a trigger at the source: a batch of one symbol is held in memory.
    """
    spark = events.sparkSession
    ship(spark)
    use_state_store(spark)
    processor = _FeatureProcessor(short_seconds, long_seconds, grace_seconds)
    out = events.groupBy("symbol").transformWithStateInPandas(processor, _FEATURE_ROWS, "append", "none")
    return out.select("symbol", "fill_id", "ts_ns", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in CORE])


#: Timers of a key's batch, at most: each reads all counts that wait, so there are few, spread over the batch's labels.
TIMERS = 8


def _by_time(times: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct times in order, and the sums of the counts of each."""
    distinct, place = np.unique(times, return_inverse=True)
    sums = [np.zeros(len(distinct), np.int64) for _ in counts]
    for s, c in zip(sums, counts):
        np.add.at(s, place, c)
    return [distinct, *sums]


class _HistoryProcessor(StatefulProcessor):
    def __init__(self, rate: float, weight: float):
        self.rate, self.weight = rate, weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "toxic long, total long")
        self.pending = handle.getListState("pending", "known_ns long, toxic long, total long")

    def _totals(self) -> tuple[int, int]:
        return tuple(self.totals.get()) if self.totals.exists() else (0, 0)

    def _waiting(self) -> list[np.ndarray]:
        """The times at which labels become known, in order, and how many toxic and in all do then."""
        kept = np.array([tuple(r) for r in self.pending.get()], np.int64).reshape(-1, 3)
        return [kept[:, i].copy() for i in range(3)]

    def _wait(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.pending.put(list(zip(*[c.tolist() for c in columns])))
        else:
            self.pending.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        toxic, total = self._totals()
        self.totals.update((toxic + int(initialState["toxic"].sum()), total + int(initialState["total"].sum())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        labels = batch[(batch["kind"] == 1) & (batch["label"] >= 0)]
        times, toxic_at, total_at = self._waiting()
        if len(labels):
            new, place = np.unique(labels["known_ns"].to_numpy(np.int64), return_inverse=True)
            bad = np.bincount(place, labels["label"].to_numpy() == 1, len(new)).astype(np.int64)
            times, toxic_at, total_at = _by_time(np.concatenate((times, new)), np.concatenate((toxic_at, bad)), np.concatenate((total_at, np.bincount(place, minlength=len(new)))))
            self._wait(times, toxic_at, total_at)
            # Whole milliseconds at or after that time: no fill before it is still to come when the timer fires.
            for known in np.unique(new[np.linspace(0, len(new) - 1, TIMERS).astype(int)]).tolist():
                self.handle.registerTimer(-(-known // 1_000_000))
        fills = batch[batch["kind"] == 0].sort_values(["ts_ns", "fill_id"])
        if len(fills):
            toxic, total = self._totals()
            bad, n = (np.concatenate(([0], np.cumsum(x))) for x in (toxic_at, total_at))
            at = fills["ts_ns"].to_numpy(np.int64)
            seen = np.searchsorted(times, at, "right")
            counts = total + n[seen]
            yield pd.DataFrame(
                {
                    "counterparty_id": key[0],
                    "fill_id": fills["fill_id"].to_numpy(np.int64),
                    "ts_ns": at,
                    "cp_fill_count": counts.astype(np.int64),
                    "cp_toxic_rate_hist": (toxic + bad[seen] + self.rate * self.weight) / (counts + self.weight),
                }
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        times, toxic_at, total_at = self._waiting()
        over = times <= until
        if over.any():
            toxic, total = self._totals()
            self.totals.update((toxic + int(toxic_at[over].sum()), total + int(total_at[over].sum())))
            self._wait(times[~over], toxic_at[~over], total_at[~over])
        return iter([])

    def close(self) -> None:
        pass


_HISTORY = "counterparty_id string, fill_id long, ts_ns long, cp_fill_count long, cp_toxic_rate_hist double"


def fills_and_labels(fills: DataFrame, labels: DataFrame, delay_seconds: float) -> DataFrame:
    """One stream of fills and of their labels: counterparty_id, kind, fill_id, ts_ns, label, known_ns, event_time.

    ``labels`` has counterparty_id, fill_id, ts_ns (the fill's) and label; it is known ``delay_seconds`` after the fill.
    """
    known = F.col("ts_ns") + seconds(delay_seconds)

    def when(ns: Column) -> Column:
        return F.timestamp_micros(F.floor(ns / 1000).cast("long")).alias("event_time")

    none = F.lit(None).cast("long").alias("known_ns")
    first = fills.select("counterparty_id", F.lit(0).alias("kind"), "fill_id", "ts_ns", F.lit(-1).alias("label"), none, when(F.col("ts_ns")))
    later = labels.select("counterparty_id", F.lit(1).alias("kind"), "fill_id", "ts_ns", F.col("label").cast("int"), known.alias("known_ns"), when(known))
    return first.unionByName(later)


def history_stream(
    events: DataFrame, rate: float = PRIOR_RATE, weight: float = PRIOR_WEIGHT, lateness: str = "1 minute", seeds: DataFrame | None = None
) -> DataFrame:
    """fill_id with cp_fill_count and cp_toxic_rate_hist: the counterparty's labels known by then, and their toxic rate.

    ``events`` is a stream as fills_and_labels() makes it. A label waits for its time in state and is added to the
    totals once the watermark (``lateness`` behind the newest event) has passed it; rows older than the watermark are
    dropped. A fill sees the labels that came in its own or an earlier batch; then its row equals counterparty_history().
    ``seeds`` has counterparty_id, toxic and total of an earlier run. Undecided labels count for nothing.
    """
    spark = events.sparkSession
    ship(spark)
    use_state_store(spark)
    start = None if seeds is None else seeds.select("counterparty_id", "toxic", "total").groupBy("counterparty_id")
    keyed = events.withWatermark("event_time", lateness).groupBy("counterparty_id")
    return keyed.transformWithStateInPandas(_HistoryProcessor(rate, weight), _HISTORY, "append", "eventTime", start)
