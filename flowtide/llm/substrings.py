"""Removal of repeated byte strings by sorting sampled suffixes and merging the others through them.

The classical difference cover samples positions so that any two suffixes meet sampled ones at a common small shift.
Here the cover is chosen by content: of each run of ``GAP`` starting positions the one with the least hash of its next
bytes, so equal windows have the same sample at the same shift, and about one byte in a hundred is a sample. Names of
sampled suffixes (digests of what follows them, as far as every window through them reaches) are sorted and counted
first. A sample whose name is its own rules out all windows that lead to it; where all its surroundings repeat, all its
windows do. Only windows of samples that are left in between are named themselves: by their shift, the bytes before the
sample and the name behind it. These are sorted, and neighbours in that order with equal prefixes repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, discard, mix64, packed_row, partitions, slices, text_bytes, unpacked, written

#: Bytes of a string that must not repeat.
LENGTH = 400
#: Bytes that a sample's hash sees, and positions of which one is a sample. With them every window reaches at least
#: LENGTH - GAP + 1 bytes beyond its sample.
SEEN, GAP = 8, 192
_PLACE = (1 << 32) - 1


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, from the minima of prefixes and suffixes of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def samples(raw: np.ndarray, offsets: np.ndarray, length: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, at): windows of ``length`` bytes that start at low to high lead to the sample at ``at``."""
    none = (np.zeros(0, np.int64),) * 3
    if len(raw) < length:
        return none
    padded = np.concatenate((raw, np.zeros(SEEN, np.uint8)))
    seen = np.lib.stride_tricks.as_strided(padded, (len(raw), SEEN), (1, 1)).copy().view(np.uint64).ravel()
    # Equal hashes: the last position counts, which depends on nothing outside the window either.
    ordered = (mix64(seen) & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(raw), dtype=np.uint64))
    chosen = (np.uint64(_PLACE) - (_least_in_windows(ordered, gap) & np.uint64(_PLACE))).astype(np.int64)
    change = np.zeros(len(raw) + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    if not len(starts):
        return none
    at = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | np.isin(starts[1:], offsets)
    first = np.flatnonzero(new)
    return starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _names(spans: Spans, low: np.ndarray, high: np.ndarray, at: np.ndarray, length: int, gap: int) -> list[np.ndarray]:
    """Of each sample the name behind it, which all its windows share, and two of all that its windows reach."""
    behind = spans.hashes(at, at + length - gap + 1)
    return [behind, spans.hashes(low, at) ^ mix64((high - low).astype(np.uint64)), spans.hashes(at, high + length)]


def _sampled(texts: DataFrame, length: int, gap: int) -> DataFrame:
    """doc, low, size (windows), shift, behind, all1, all2 of every sample; positions count within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(1))
                low, high, at = samples(raw, offsets, length, gap)
                if len(low):
                    doc = np.searchsorted(offsets, low, side="right") - 1
                    names = _names(Spans(raw), low, high, at, length, gap)
                    key = part.column(0).to_numpy()[doc]
                    sizes = [(high - low + 1).astype(np.int32), (at - low).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(low - offsets[doc]), *map(pa.array, sizes), *map(_longs, names)], ["doc", "low", "size", "shift", "behind", "all1", "all2"])

    return texts.mapInArrow(run, "doc long, low long, size int, shift int, behind long, all1 long, all2 long")


_ALL = ("behind", "all1", "all2")


def _windows(texts: DataFrame, regions: DataFrame, length: int) -> DataFrame:
    """k1, k2 (names), region and shift of every window of the regions; those found equal within a batch have known true,
    and all but one of these carry names of their own, so that a very common window is sent once a batch."""
    wanted = regions.groupBy("doc").agg(F.collect_list(F.struct("low", "size", "region")).alias("regions"))
    joined = texts.join(wanted, "doc").select("text", "regions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(0))
                spans = Spans(raw)
                lists = part.column(1)
                flat = lists.flatten()
                n = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), n)
                low = flat.field("low").to_numpy() + offsets[doc]
                size, region = flat.field("size").to_numpy().astype(np.int64), flat.field("region").to_numpy()
                shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = np.repeat(low, size) + shift
                half = length // 2
                k1, k2 = spans.hashes(start, start + half), spans.hashes(start + half, start + length)
                order = np.lexsort((k2, k1))
                same = np.zeros(len(start), bool)
                same[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
                known = same.copy()
                known[order[:-1]] |= same[order[1:]]
                own = np.repeat(region, size)
                k1[same], k2[same] = mix64(own[same].astype(np.uint64)), mix64((own[same] ^ shift[same]).astype(np.uint64))
                for a in range(0, len(start), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([_longs(k1[b]), _longs(k2[b]), pa.array(own[b]), pa.array(shift[b].astype(np.int32)), pa.array(known[b])], ["k1", "k2", "region", "shift", "known"])

    return joined.mapInArrow(run, "k1 long, k2 long, region long, shift int, known boolean")


def _repeated(windows: DataFrame, gap: int) -> DataFrame:
    """region and bits (one for each shift): the windows whose name a neighbour in sorted order shares, or known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # the row before the batch: names, region, shift, whether it repeats
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, region, shift, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            equal = np.zeros(len(k1), bool)
            equal[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            found = known | equal
            found[:-1] |= equal[1:]
            out_region, out_shift = [region[found]], [shift[found]]
            if last is not None and last[0] == k1[0] and last[1] == k2[0]:
                if not last[4]:
                    out_region.append(np.array([last[2]]))
                    out_shift.append(np.array([last[3]], np.int32))
                if not found[0]:
                    found[0] = True
                    out_region.append(region[:1])
                    out_shift.append(shift[:1])
            last = [k1[-1], k2[-1], region[-1], shift[-1], found[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_region)), pa.array(np.concatenate(out_shift))], ["region", "shift"])

    ordered = windows.repartition(partitions(windows.sparkSession), "k1").sortWithinPartitions("k1", "k2")
    found = ordered.mapInArrow(run, "region long, shift int")
    bits = [F.bit_or(F.when(F.floor(F.col("shift") / 64) == k, F.expr("shiftleft(1L, shift % 64)")).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(-(-gap // 64))]
    return found.groupBy("region").agg(*bits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gap: int = GAP) -> DataFrame:
    """``docs`` with kept (binary: the UTF-8 bytes that stay), spans (array of start and length of the maximal runs of
    bytes taken out), n_bytes and n_removed (long).

    Taken out is each byte covered by a string of ``length`` bytes that also starts anywhere else, in another text or
    the same, on the texts as they are; strings never cross texts. Null texts are empty. Rows that are alike in id and
    text count as so many texts, so nothing of them stays if they are long enough; ids may be null. Columns named like
    the new ones give way to them, others pass. An empty table gives an empty table.
    """
    new = ("kept", "spans", "n_bytes", "n_removed")
    passed = [c for c in docs.columns if c not in new]
    others = [c for c in passed if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(packed_row(others), F.xxhash64(F.col(f"`{id_col}`"), text).alias("doc"), text.alias("text"))
    texts = rows.select("doc", "text")
    sampled = written(_sampled(texts, length, gap), "samples")
    # Samples whose name is their own end here.
    # Written, so that the join deals both sides anew and a very common name can be split among tasks.
    shared = written(sampled.groupBy("behind").agg(F.count("*").alias("of")).where("of > 1").select("behind"), "shared")
    candidates = written(sampled.join(shared, "behind"), "candidates")
    discard(sampled)
    names = written(candidates.groupBy(*_ALL).agg(F.count("*").alias("n")), "names")
    kinds = written(names.groupBy("behind").agg(F.count("*").alias("kinds")), "kinds")
    counted = written(names.join(kinds, "behind"), "counted")
    hits = written(candidates.join(counted, list(_ALL)), "hits")
    discard(candidates)

    # One sample of each name stands for all of that name.
    named = F.xxhash64(*_ALL).alias("region")
    mixed = hits.where("kinds > 1").groupBy(*_ALL).agg(F.min(F.struct("doc", "low", "size")).alias("one")).select(named, "one.*")
    found = written(_repeated(_windows(texts, mixed, length), gap), "repeats")
    bits = [f"bits{k}" for k in range(-(-gap // 64))]
    marked = hits.where("n > 1").select("doc", "low", "size", *[F.lit(-1).cast("long").alias(b) for b in bits])
    marked = marked.union(hits.where("n = 1").withColumn("region", F.xxhash64(*_ALL)).join(found, "region").select("doc", "low", "size", *bits))
    # The same text in many rows has the same marks; one set of them is enough.
    per_doc = marked.distinct().groupBy("doc").agg(F.collect_list(F.struct("low", "size", *bits)).alias("marks"))
    joined = rows.join(per_doc, "doc", "left").select("row", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column(1))
                marks = part.column(2).to_pylist()
                kept, spans, removed = [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    change = np.zeros(b - a + 1, np.int64)
                    for m in marks[i] or ():
                        flags = np.unpackbits(np.array([m[k] for k in bits], np.int64).view(np.uint8), bitorder="little")[: m["size"]]
                        starts = m["low"] + np.flatnonzero(flags)
                        change[starts] += 1
                        change[starts + length] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                    removed.append(int(gone.sum()))
                    kept.append(raw[a:b][~gone].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), part.column(1)], ["row", "kept", "spans", "n_bytes", "n_removed", "text"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept binary, spans array<struct<start:bigint,length:bigint>>, n_bytes long, n_removed long, text string"
    done = joined.mapInArrow(cut, schema)
    found = dict(zip(others, unpacked(others), strict=True))
    return done.select(*[found.get(c, F.col("text").alias(c)) for c in passed], *new)
