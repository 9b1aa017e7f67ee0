"""Line deduplication by probing sharded minimal perfect hashes.

Distinct line hashes that occur in two documents or more are dealt into shards. Each shard gets a minimal
perfect hash (a cascade of collision-free bit arrays) that indexes three compact arrays: a 64-bit fingerprint,
the number of documents and the document that keeps the line. Documents send (id, hash) probes to the shard
arrays, and only the hashes to drop come back; no line text is shuffled or joined.

Lines that occur in more than one in ``HOT_SHARE`` of all probes are at most ``HOT_SHARE`` many, so their
entries are broadcast and their probes never leave the task: no shard gets a hot line's probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, mix64, packed_row, partitions, slices, unpacked, written

#: Keys shorter than this many code points are never dropped.
MIN_CHARS = 10
#: Expected keys and probes of one shard.
SHARD_KEYS, SHARD_PROBES = 100_000, 300_000
#: At most this many line keys are broadcast as hot.
HOT_SHARE = 2000
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z lower-cased."""
    return [line.strip(_SPACE) for line in text.lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys; keys that share all 64 bits get no slot (index() says -1)."""

    LEVELS = 40

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))) % np.uint64(m)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest) and len(levels) < cls.LEVELS:
            m = max(8, 2 * len(rest))
            at = cls._place(rest, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has one; a foreign key may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, dumped: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")).astype(bool) for b in dumped])


def distinct_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the 128-bit hashes of each document's distinct keys."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, digests = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), binaries(part.column(1)), strict=True):
                    if doc is None or not text:
                        continue
                    keys = {k for k in line_keys(text) if _long_enough(k, min_chars)}
                    ids.append(doc)
                    sizes.append(len(keys))
                    digests += map(xxhash.xxh3_128_digest, keys)
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc", "h1", "h2"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).mapInArrow(explode, "doc long, h1 long, h2 long")


def shard_index(shared: DataFrame) -> DataFrame:
    """One row a shard: the perfect hash of its keys and the arrays that it indexes."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = rows["h1"].to_numpy(np.int64).view(np.uint64), rows["h2"].to_numpy(np.int64)
        keys = h1 ^ mix64(h2.view(np.uint64))
        hashed = PerfectHash.of(keys)
        at = hashed.index(keys)
        size = hashed.size
        arrays = [np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)]
        for array, name in zip(arrays, ("h2", "n_docs", "owner"), strict=True):
            array[at[at >= 0]] = rows[name].to_numpy(np.int64)[at >= 0]
        # Keys without a slot are listed as they are.
        rest = rows.loc[at < 0, ["h1", "h2", "owner"]].to_numpy(np.int64)
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "levels": [hashed.dump()], "prints": [arrays[0].tobytes()], "counts": [arrays[1].astype(np.uint32).tobytes()], "owners": [arrays[2].tobytes()], "rest": [rest.tobytes()]})

    return shared.groupBy("shard").applyInPandas(build, "shard long, levels array<binary>, prints binary, counts binary, owners binary, rest binary")


def _probe(probes: pa.Table, index: pa.Table) -> pa.Table:
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    if not probes.num_rows or not index.num_rows:
        return schema.empty_table()
    entry = index.slice(0, 1).to_pylist()[0]
    doc, h1, h2 = (probes.column(c).to_numpy() for c in ("doc", "h1", "h2"))
    at = PerfectHash.load(entry["levels"]).index(h1.view(np.uint64) ^ mix64(h2.view(np.uint64)))
    prints, counts, owners = (np.frombuffer(entry[c], k) for c, k in (("prints", np.int64), ("counts", np.uint32), ("owners", np.int64)))
    hit = (at >= 0) & (prints[at] == h2) & (counts[at] >= 2) & (owners[at] != doc) if len(prints) else np.zeros(len(doc), bool)
    for k1, k2, owner in np.frombuffer(entry["rest"], np.int64).reshape(-1, 3):
        hit |= (h1 == k1) & (h2 == k2) & (owner != doc)
    return pa.table([pa.array(x[hit]) for x in (doc, h1, h2)], schema=schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with each line whose key an earlier document (by id) also holds taken out of its text.

    Adds n_lines (before dropping) and n_dropped (long), replacing columns of these names. A key of at least
    ``min_chars`` code points that two documents or more hold stays in the smallest id alone, there with all its
    repeats. Null texts stay null and count one empty line, of which none is dropped; empty texts likewise. Rows
    with a null id keep all their lines and hold none against others. Rows that share an id are one document.
    All other columns pass unchanged, whatever their names; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    keys = written(distinct_keys(docs, id_col, text_col, min_chars), "line-keys")
    shared = written(
        keys.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n_docs")).where("owner < last").drop("last"),
        "shared-lines",
    )
    n_probes, n_shared = keys.count(), shared.count()
    hot = shared.where(F.col("n_docs") * HOT_SHARE > F.lit(n_probes)).select("h1", "h2", "owner")
    n_shards = max(4 * partitions(spark), math.ceil(n_shared / SHARD_KEYS), math.ceil(n_probes / SHARD_PROBES))
    shard = F.pmod(F.col("h1"), F.lit(n_shards)).alias("shard")

    index = shard_index(shared.where(F.col("n_docs") * HOT_SHARE <= F.lit(n_probes)).select("*", shard))
    probes = keys.join(F.broadcast(hot), ["h1", "h2"], "left")
    at_once = probes.where("owner is not null and owner <> doc").select("doc", "h1", "h2")
    routed = probes.where("owner is null").select("doc", "h1", "h2", shard)
    found = routed.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(lambda p, i: _probe(p, i), "doc long, h1 long, h2 long")
    drops = at_once.union(found).groupBy("doc").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    passed = [c for c in kept if c != text_col]
    numbered = docs.select(packed_row(passed), F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    joined = numbered.join(drops, numbered["key"] == drops["doc"], "left").select("row", "text", "drop")
    text_type = docs.schema[text_col].dataType

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, lines, dropped = [], [], []
                drop = part.column(2)
                for i, text in enumerate(binaries(part.column(1))):
                    parts = (text or b"").split(b"\n")
                    lines.append(len(parts))
                    if text is not None and drop[i].is_valid:
                        gone = drop[i].values
                        gone = set(zip(gone.field(0).to_pylist(), gone.field(1).to_pylist(), strict=True))
                        stay = []
                        for line in parts:
                            key = line.lower().strip(_SPACE)
                            if not _long_enough(key, min_chars) or tuple(np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist()) not in gone:
                                stay.append(line)
                        text, parts = b"\n".join(stay), stay
                        dropped.append(lines[-1] - len(stay))
                    else:
                        dropped.append(0)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([T.StructField("row", numbered.schema["row"].dataType), T.StructField("text", text_type), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = joined.mapInArrow(rewrite, schema)
    found = dict(zip(passed, unpacked(passed), strict=True))
    return done.select(*[found.get(c, F.col("text").alias(c)) for c in kept], "n_lines", "n_dropped")
