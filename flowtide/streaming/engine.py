"""The realtime engine: ticks in, gated quotes out, with the batch operators' numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..deploy import ship
from ..operators.gate import GateConfig, RiskGate
from ..operators.vpin import PERCENTILE_BINS, PERCENTILE_WARMUP, WINDOW
from .live import use_state_store
from .ranks import Ranks

OUTPUT = "symbol string, bucket long, ts_end long, price_end double, v_buy double, order_imbalance double, vpin double, vpin_pctile double, action string, multiplier double, spread double"
#: What is kept for each symbol between batches, beside the pages of the percentile's counts: of a size that the settings fix.
STATE = "filled double, base_mid double, n long, mean double, m2 double, bucket long, ring array<double>, gate int, since long, late long, last_ts long, last_seq long, ranked long"
PAGES = "counts array<bigint>"


@dataclass
class Settings:
    bucket_volume: float
    window: int = WINDOW
    pctile_warmup: int = PERCENTILE_WARMUP
    bins: int = PERCENTILE_BINS
    gate: GateConfig = GateConfig()
    base_spread: float | None = None


class Clock:
    """The fold over one symbol's ticks; its state is a tuple of plain values and the counts of its readings."""

    def __init__(self, settings: Settings, state: tuple | None = None):
        self.s = settings
        first = (0.0, None, 0, 0.0, 0.0, 0, [], 1, None, 0, None, None, Ranks(settings.bins))
        (self.filled, self.base_mid, self.n, self.mean, self.m2, self.bucket, ring, gate, since, self.late, self.last_ts, self.last_seq, self.ranks) = state or first
        self.ring = list(ring)
        self.gate = RiskGate(settings.gate, gate, since)

    def state(self) -> tuple:
        return (self.filled, self.base_mid, self.n, self.mean, self.m2, self.bucket, self.ring, self.gate.state, self.gate.since, self.late, self.last_ts, self.last_seq, self.ranks)

    def tick(self, ts: int, seq: int, bid: float, ask: float, volume: float) -> Iterator[tuple]:
        """Rows of the buckets that the tick closes. Ticks out of order are counted and dropped."""
        if self.last_ts is not None and (ts, seq) <= (self.last_ts, self.last_seq):
            self.late += 1
            return
        self.last_ts, self.last_seq = ts, seq
        mid = (bid + ask) / 2
        if self.base_mid is None:
            self.base_mid = mid
        if not volume > 0:
            return
        v = self.s.bucket_volume
        self.filled += volume
        while self.filled >= v:
            self.filled -= v
            dp = mid - self.base_mid
            sigma = math.sqrt(self.m2 / self.n) if self.n >= 2 else 0.0
            share = 0.5 * math.erfc(-dp / sigma / math.sqrt(2)) if sigma > 0 else 0.5
            self.n += 1
            step = dp - self.mean
            self.mean += step / self.n
            self.m2 += step * (dp - self.mean)
            self.base_mid, self.bucket = mid, self.bucket + 1
            imbalance = abs(2 * share - 1)
            self.ring = [*self.ring, imbalance][-self.s.window :]
            vpin = rank = None
            if len(self.ring) == self.s.window:
                vpin = sum(self.ring) / self.s.window
                rank = self.ranks.observe(vpin)
                if self.ranks.total < self.s.pctile_warmup:
                    rank = None
            action, multiplier, spread, _ = self.gate.update(ts, rank, self.s.base_spread if self.s.base_spread is not None else ask - bid) if vpin is not None else (None, None, None, False)
            yield (self.bucket, ts, mid, v * share, imbalance, vpin, rank, action, multiplier, spread)


class _Engine(StatefulProcessor):
    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("clock", STATE)
        self.pages = handle.getMapState("ranks", "page int", PAGES)

    def _page(self, number: int) -> list[int] | None:
        return list(self.pages.getValue((number,))[0]) if self.pages.containsKey((number,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = None
        if self.values.exists():
            *plain, ranked = self.values.get()
            state = (*plain, Ranks(self.settings.bins, ranked, self._page))
        clock = Clock(self.settings, state)
        if state is None:
            clock.ranks = Ranks(self.settings.bins, 0, self._page)
        batch = pd.concat(list(rows)).sort_values(["ts_ns", "seq"])
        out = []
        for tick in batch[["ts_ns", "seq", "bid", "ask", "volume"]].itertuples(index=False):
            out.extend((key[0], *row) for row in clock.tick(*tick))
        for number in clock.ranks.dirty:
            self.pages.updateValue((number,), (clock.ranks.pages[number],))
        self.values.update((*clock.state()[:-1], clock.ranks.total))
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def stream(ticks: DataFrame, settings: Settings) -> DataFrame:
    """Closed buckets of a stream of ticks (symbol, ts_ns, seq, bid, ask, volume), one state for each symbol.

    The state does not grow: a reading's percentile comes from counts in ``settings.bins`` equal steps, as
    vpin.percentile() gives it with these bins. Crossed, locked and incomplete quotes are dropped before; the query's
    progress counts them under the observation ``engine`` (rows, rejected). Within a batch ticks are put in order; those
    older than the last one seen are counted in the state and dropped. A batch of one symbol is held in memory: bound
    the files of a trigger at the source.
    """
    spark = ticks.sparkSession
    ship(spark)
    use_state_store(spark)
    sound = F.coalesce(F.col("ask") > F.col("bid"), F.lit(False)) & F.col("ts_ns").isNotNull()
    counted = ticks.observe("engine", F.count("*").alias("rows"), F.count_if(~sound).alias("rejected"))
    quotes = counted.where(sound).select("symbol", "ts_ns", F.coalesce("seq", F.lit(0)).alias("seq"), "bid", "ask", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    return quotes.groupBy("symbol").transformWithStateInPandas(_Engine(settings), OUTPUT, "append", "none")
