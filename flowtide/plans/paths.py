"""What a series does after each of many rows: time slices with a look ahead, searched in numpy.

A slice holds the probes of its time, its ticks, those of the horizon after it and the last one before it. So each probe
finds all that it asks for in one slice, and both sides are moved once, whatever the number of ticks in a horizon.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..deploy import ship
from .series import _SLICE, SLICE_NS

#: Horizons in a slice, at least: ticks of one in so many are in two slices. Slices in ``slice_ns``, at most.
HORIZONS, PARTS = 4, 24


def levels(values: np.ndarray) -> list[np.ndarray]:
    """The largest value of each aligned block of 1, 2, 4, ... values, up to one block of all; padded with -inf."""
    size = 1 << max(len(values) - 1, 0).bit_length()
    out = [np.concatenate((values, np.full(size - len(values), -np.inf)))]
    while len(out[-1]) > 1:
        out.append(out[-1].reshape(-1, 2).max(axis=1))
    return out


def first_reach(tree: list[np.ndarray], start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each start, the first place at or after it whose value is at least ``level``; the padded length without one.

    Blocks that don't reach it are stepped over, larger and larger ones and then smaller and smaller ones.
    """
    top, at = len(tree) - 1, start.astype(np.int64)
    size = 1 << top
    open_ = at < size
    for k in range(top):
        odd = np.flatnonzero(open_ & ((at >> k) & 1 == 1))
        reached = tree[k][at[odd] >> k] >= level[odd]
        open_[odd[reached]] = False
        at[odd[~reached]] += 1 << k
        open_ &= at < size
    for k in range(top, -1, -1):
        here = np.flatnonzero((at < size) & (at & ((1 << k) - 1) == 0))
        at[here[~(tree[k][at[here] >> k] >= level[here])]] += 1 << k
    return at


def largest(tree: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest value of the places from each start to before its end; -inf where there is none."""
    low, high, out = start.astype(np.int64), np.maximum(start, end).astype(np.int64), np.full(len(start), -np.inf)
    for row in tree:
        odd = np.flatnonzero((low < high) & (low & 1 == 1))
        out[odd] = np.maximum(out[odd], row[low[odd]])
        low[odd] += 1
        odd = np.flatnonzero((low < high) & (high & 1 == 1))
        high[odd] -= 1
        out[odd] = np.maximum(out[odd], row[high[odd]])
        low, high = low >> 1, high >> 1
    return out


class Path:
    """The ticks of a slice in order. Nulls are passed over by ``up`` and ``down``; nan is above everything."""

    def __init__(self, ts: pa.Array, seq: pa.Array, mid: pa.Array):
        ts_, seq_ = ts.to_numpy(zero_copy_only=False), seq.to_numpy(zero_copy_only=False)
        order = np.lexsort((seq_, ts_))
        self.ts, self.known = ts_[order], pc.is_valid(mid).to_numpy(zero_copy_only=False)[order]
        self.mid = mid.to_numpy(zero_copy_only=False).astype(np.float64)[order]
        high = np.where(np.isnan(self.mid), np.inf, self.mid)
        self.up, self.down = (levels(np.where(self.known, x, -np.inf)) for x in (high, -high))

    def after(self, at: np.ndarray) -> np.ndarray:
        """The place of the first tick after each time."""
        return np.searchsorted(self.ts, at, "right")

    def now(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mid of the last tick at or before each time, and whether there is one."""
        place = self.after(at) - 1
        if not len(self.ts):
            return np.full(len(at), np.nan), np.zeros(len(at), bool)
        return self.mid[place], (place >= 0) & self.known[place]


def along(probes: DataFrame, ticks: DataFrame, horizon_ns: int, find: Callable[[Path, np.ndarray, dict[str, pa.Array]], pa.Array], name: str, kind: DataType, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``probes`` (with ts_ns) with the column ``name``: what ``find`` gives for the path, times and columns of a slice's
    probes. It sees every tick from the last one before a probe to ``horizon_ns`` after it."""
    ship(probes.sparkSession)
    probes = probes.drop(name)
    width = max(HORIZONS * horizon_ns, slice_ns // PARTS, 1)
    slice_ = F.expr(f"(_at - pmod(_at, {width}L)) div {width}L")  # exact: a double holds no nanoseconds
    p = probes.select(*by, F.col("ts_ns").alias("_at"), F.struct(*probes.columns).alias("_p")).withColumn(_SLICE, slice_)
    t = ticks.select(*by, F.col("ts_ns").alias("_at"), F.col("seq").cast("long").alias("_seq"), F.col("mid").cast("double").alias("_mid")).withColumn(_SLICE, slice_)
    last = t.groupBy(*by, _SLICE).agg(F.max(F.struct("_at", "_seq", "_mid")).alias("_t"))
    slices = p.select(*by, _SLICE).distinct().withColumn("_mine", F.lit(True)).unionByName(last, allowMissingColumns=True)
    earlier = Window.partitionBy(*by).orderBy(_SLICE).rangeBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("_t", F.last("_t", ignorenulls=True).over(earlier)).where("_mine AND _t IS NOT NULL").select(*by, _SLICE, "_t.*")
    ahead = F.col("_at") - F.col(_SLICE) * width < horizon_ns
    t = t.withColumn(_SLICE, F.explode(F.when(ahead, F.array(F.col(_SLICE), F.col(_SLICE) - 1)).otherwise(F.array(_SLICE))))
    both = t.unionByName(before).unionByName(p, allowMissingColumns=True)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        mine = pc.is_valid(rows["_p"])
        asked, path = rows.filter(mine), rows.filter(pc.invert(mine))
        held = asked["_p"].combine_chunks()
        columns = dict(zip((f.name for f in held.type), held.flatten(), strict=True)) if len(asked) else {f.name: pa.array([], f.type) for f in held.type}
        if len(asked):
            ts = pc.fill_null(asked["_at"], 0).to_numpy()
            found = find(Path(path["_at"].combine_chunks(), path["_seq"].combine_chunks(), path["_mid"].combine_chunks()), ts, columns)
        else:
            found = pa.array([], to_arrow_type(kind))
        return pa.Table.from_arrays([*columns.values(), found], names=[*columns, name])

    schema = StructType([*probes.schema.fields, StructField(name, kind)])
    return both.groupBy(*by, _SLICE).applyInArrow(run, schema)
