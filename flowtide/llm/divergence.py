"""How far sources of a language lie apart in their words, from dense tiles of groups by terms.

Terms are counted by source and language, those in too few documents of their language go, and the rest are dealt to
blocks by hash. A tile is a numpy int64 matrix of the shares of up to GROUPS sources in one block of TERMS terms; all its
pairs of sources are compared by broadcasting, slab by slab. Partial pair sums add up over blocks; each block also gives
each source's best terms, which are merged. So no task holds more than a tile, whatever the number of terms, sources
or documents, and a language with a third of all rows spreads over its blocks.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, written

#: Sources on a side of a tile, and terms in it.
GROUPS = 256
TERMS = 256
#: A term has to be in so many documents of its language.
MIN_DOCS = 30
#: Added to every count, and the whole that shares are parts of.
PRIOR = 5
WHOLE = 1_000_000_000
TOP = 50
#: Counts held before a task passes them on.
HELD = 400_000
#: Entries of a broadcast slab.
SLAB = 1 << 22

#: ASCII letters and all that is not ASCII, over lower-cased UTF-8.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = HELD) -> DataFrame:
    """lang, source, term, count and docs (documents with the term); null texts, languages and sources are ''.

    A task passes its counts on when it holds ``most`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    size -= len(counts)
                    found = Counter(_TERM.findall(text.as_buffer().to_pybytes().lower()))
                    counts.update(found)
                    seen.update(found.keys())
                    size += len(counts)
                if size >= most:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    def flushed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, seen) in held.items():
            terms = list(counts)
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))),
                        pa.array([source], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([counts[t] for t in terms], pa.int64()),
                        pa.array([seen[t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "docs"],
                )

    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    found = docs.select(*names).mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * counts / totals), exact for totals below 9 * 10**15: long division, three digits at a time."""
    quotient, rest = np.divmod(counts, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digits
    return quotient + 1


def pair_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sums over terms of |left[i] - right[j]| for all pairs of rows, by broadcasting over slabs of bounded size."""
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, SLAB // max(1, right.size))
    for i in range(0, len(left), step):
        out[i : i + step] = np.abs(left[i : i + step, None, :] - right[None, :, :]).sum(axis=2)
    return out


_TILE = "part string, place int, other int, term string, value long"


def _tile(key: tuple, terms: pa.Table, groups: pa.Table, side: int) -> pa.Table:
    """Pair sums of one tile, and the best terms of its sources where the tile is on the diagonal."""
    row_tile, column_tile = key[2].as_py(), key[3].as_py()
    places = groups.column("group_place").to_numpy()
    order = np.argsort(places, kind="stable")
    places = places[order]
    totals = groups.column("group_total").to_numpy()[order] + PRIOR * groups.column("n_terms").to_numpy()[order]
    names = terms.column("term").combine_chunks().dictionary_encode() if terms.num_rows else pa.array([], pa.string()).dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    codes, kinds = np.asarray(names.indices), names.dictionary
    counts = np.zeros((len(places), len(kinds)), np.int64)
    counts[np.searchsorted(places, terms.column("place").to_numpy()), codes] = terms.column("count").to_numpy()
    p = shares(counts + PRIOR, np.maximum(totals, 1)[:, None])
    rows, columns = places // side == row_tile, places // side == column_tile
    sums = pair_sums(p[rows], p[columns])
    first, second = np.meshgrid(places[rows], places[columns], indexing="ij")
    other = first != second
    first, second, sums = first[other], second[other], sums[other]
    if row_tile != column_tile:
        first, second, sums = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([sums, sums])
    parts = [("pair", first, second, pa.nulls(len(first), pa.string()), sums)]
    if row_tile == column_tile and len(kinds):
        whole = np.zeros(len(kinds), np.int64)
        whole[codes] = terms.column("whole").to_numpy()
        lang_total = groups.column("lang_total")[0].as_py() + PRIOR * groups.column("n_terms")[0].as_py()
        above = np.where(counts > 0, p - shares(whole + PRIOR, np.int64(lang_total)), 0)
        texts = [t.encode() for t in kinds.to_pylist()]
        for i, place in enumerate(places):
            best = heapq.nsmallest(TOP, np.flatnonzero(above[i] > 0), key=lambda t: (-above[i, t], texts[t]))
            here = np.full(len(best), place)
            parts.append(("term", here, here, kinds.take(pa.array(best, pa.int64())), above[i, best]))
    sizes = [len(x[1]) for x in parts]
    return pa.table(
        {
            "part": pa.array([x[0] for x, n in zip(parts, sizes) for _ in range(n)], pa.string()),
            "place": pa.array(np.concatenate([x[1] for x in parts]).astype(np.int32)),
            "other": pa.array(np.concatenate([x[2] for x in parts]).astype(np.int32)),
            "term": pa.concat_arrays([x[3].cast(pa.string()) for x in parts]),
            "value": pa.array(np.concatenate([x[4] for x in parts]).astype(np.int64)),
        }
    )


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", side: int = GROUPS, block_terms: int = TERMS, most: int = HELD
) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance to every other source of its language (part
    ``pair``), and its TOP terms whose share lies furthest above the language's (part ``term``).

    A language keeps the terms of at least MIN_DOCS of its documents. A share is 1 + floor(10**9 (count + 5) / (N + 5 V)).
    Tiles are of ``side`` by ``side`` sources and about ``block_terms`` terms. Null texts, languages and sources are ''. Repeated rows count as often as they occur, ids are not looked at. Groups
    without terms are compared too, and a language without kept terms gives distances of 0; an empty table no rows.
    Ranks order by value, falling, then by the item's UTF-8 bytes.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col, most), "term-counts")
    per_term = counts.groupBy("lang", "term").agg(F.sum("count").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS)
    kept = written(counts.join(per_term.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "count", "whole"), "kept-terms")
    discard(counts)

    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    group_totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    lang_totals = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.countDistinct("term").alias("n_terms"))
    by_lang = Window.partitionBy("lang")
    groups = docs.select(*names).distinct().join(group_totals, ["lang", "source"], "left").join(lang_totals, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "n_terms"]).withColumns(
        {"place": F.row_number().over(by_lang.orderBy("source")) - 1, "n_groups": F.count("*").over(by_lang)}
    )
    groups = written(groups, "groups")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / block_terms)).cast("int")
    tiles = F.ceil(F.col("n_groups") / side).cast("int")
    tile = F.floor(F.col("place") / side).cast("int")
    # A source of tile t meets those of every tile: as a row in pairs (t, j >= t), as a column in pairs (i < t, t).
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda j: F.struct(F.least(j, tile).alias("i"), F.greatest(j, tile).alias("j")),
    )
    located = groups.select("lang", "source", "place", "total", "lang_total", "n_terms", blocks.alias("blocks"), pairs.alias("pairs"))
    right = located.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select(
        "lang", "block", F.inline("pairs"), F.col("place").alias("group_place"), F.col("total").alias("group_total"), "lang_total", "n_terms"
    )
    left = kept.join(located.select("lang", "source", "place", "blocks", "pairs"), ["lang", "source"]).select(
        "lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), F.inline("pairs"), "place", "term", "count", "whole"
    )

    def lang_tile(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        out = _tile(key, terms, groups, side)
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    key = ["lang", "block", "i", "j"]
    made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lang_tile, "lang string, " + _TILE)
    made = written(made, "tiles")

    names = groups.select("lang", "source", "place")
    sums = made.where("part = 'pair'").groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    other = names.select("lang", F.col("source").alias("item"), F.col("place").alias("other"))
    distances = sums.join(names, ["lang", "place"]).join(other, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = made.where("part = 'term'").join(names, ["lang", "place"]).select("lang", "source", "part", F.col("term").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return distances.withColumn("rank", ranked).unionByName(best.withColumn("rank", ranked).where(F.col("rank") <= TOP))
