"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings, all that stand in the examples, a bounded sample of labelled rows. Document
frequencies count over all documents. The index keeps rare terms as postings and common ones as rows of a matrix, both in blocks of examples, with
the largest weight of each common term in each block; a search opens a text's blocks in the order of their upper bounds
and stops when no closed block can reach the k-th best cosine, so the neighbours are exact. Their votes are weighted by
cosine. A few telling words hardly move the cosine of a long text, so a second search, over the terms that tell the
labels apart, votes too where a text holds such terms. Votes are calibrated on the examples themselves, each left out
in turn. Neither ids nor labels of a text play a part in its score: examples are picked and ordered by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Spans, add_columns, mix64, runs_of, text_bytes, written

#: Labelled examples of each class, at most (those with the lowest hashes of their texts), and telling terms.
EXAMPLES, TERMS = 2000, 2000
NEIGHBOURS, BLOCK = 15, 64
#: Bytes of the beginnings of words that count as terms; a telling term stands in at least so many examples.
BEGINNINGS, LEAST_EXAMPLES = (5, 6), 4
#: Terms that stand in more than one in so many examples are common.
COMMON = 8
#: Texts, and postings of their rare terms, that are gone through together; a text of more postings stands alone.
BATCH, POSTINGS = 256, 1 << 21
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every term of every text: its words, as runs of letters, A-Z lower-cased, and their beginnings."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends = runs_of(_LETTER[raw], offsets)
    spans = Spans(raw)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    hashes, docs = [spans.hashes(starts, ends)], [doc]
    for n in BEGINNINGS:
        longer = ends - starts > n
        hashes.append(mix64(spans.hashes(starts[longer], starts[longer] + n) ^ np.uint64(n)))
        docs.append(doc[longer])
    return np.concatenate(docs), np.concatenate(hashes)


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, term), in this order, and how often each stands there."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], term[starts], np.diff(np.append(starts, len(doc)))


def telling_terms(doc: np.ndarray, at: np.ndarray, size: int, toxic: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """The sorted places, of ``size`` terms, of those with the largest chi-square against the labels."""
    n, pos = len(toxic), int(toxic.sum())
    both, df = np.bincount(at, weights=toxic[doc], minlength=size), np.bincount(at, minlength=size)
    expected = df * pos / n
    spread = np.maximum(df * (n - df) / n * (pos / n) * (1 - pos / n), 1e-12)
    score = (both - expected) ** 2 / spread
    # Bounds the chance that one of all the terms looks so telling by luck.
    good = (df >= LEAST_EXAMPLES) & (score > 2 * np.log(max(size, 2)) + 8)
    best = np.argsort(-score, kind="stable")
    return np.sort(best[good[best]][:terms])


def chosen_counts(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the vocabulary, count) of the terms of every text that it holds, in this order."""
    doc, term = term_hashes(column)
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == term
    keys, counts = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
    return keys // len(vocabulary), keys % len(vocabulary), counts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, so many as its length."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


@dataclass
class BlockMaxIndex:
    """Examples by term, in narrow types, as it travels to every task. Columns are examples, filled up to whole blocks."""

    doc_ids: np.ndarray
    labels: np.ndarray
    offsets: np.ndarray  # of each rare term's postings
    examples: np.ndarray
    weights: np.ndarray
    row: np.ndarray  # of each common term, -1 for rare ones
    common: np.ndarray  # common terms x columns
    tops: np.ndarray  # common terms x blocks: the largest weight

    @classmethod
    def build(cls, doc_ids: np.ndarray, labels: np.ndarray, offsets: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> BlockMaxIndex:
        """``term`` and ``weight`` (of unit length for each example) from offsets[i] on are those of example i."""
        n = len(labels)
        blocks = max(1, -(-n // BLOCK))
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        df = np.bincount(term, minlength=terms)
        row = np.full(terms, -1, np.int32)
        often = np.flatnonzero(df * COMMON > n)
        row[often] = np.arange(len(often))
        common, weight = np.zeros((len(often), blocks * BLOCK), np.float32), weight.astype(np.float32)
        dense = row[term] >= 0
        common[row[term[dense]], example[dense]] = weight[dense]
        order = np.argsort(term[~dense], kind="stable")
        postings = np.concatenate(([0], np.cumsum(np.where(row < 0, df, 0))))
        tops = common.reshape(len(often), blocks, BLOCK).max(2, initial=0.0)
        return cls(doc_ids, labels, postings.astype(np.int32), example[~dense][order], weight[~dense][order], row, common, tops)

    @cached_property
    def wide(self) -> np.ndarray:
        return self.common.astype(float)

    def search(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As _search(), in parts of bounded memory."""
        n = len(offsets) - 1
        before = np.concatenate(([0], np.cumsum(self.offsets[terms + 1] - self.offsets[terms], dtype=np.int64)))[offsets]
        out, start = [], 0
        while start < n:
            stop = int(np.searchsorted(before, before[start] + POSTINGS, side="right")) - 1
            stop = min(n, max(stop, start + 1), start + BATCH)
            part = slice(offsets[start], offsets[stop])
            out.append(self._search(offsets[start : stop + 1] - offsets[start], terms[part], weights[part], k, None if without is None else without[start:stop]))
            start = stop
        return np.concatenate([x for x, _ in out] or [np.zeros((0, k), int)]), np.concatenate([x for _, x in out] or [np.zeros((0, k))])

    def _search(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (its terms and weights start at its offset) the k examples of the largest cosines above 0, best
        first, ties to the earlier example: places (-1 where there are fewer) and cosines.

        ``without`` names an example for each text that is left out.
        """
        n, (blocks, width) = len(offsets) - 1, (self.tops.shape[1], self.common.shape[1])
        text = np.repeat(np.arange(n), np.diff(offsets))
        rare = self.row[terms] < 0
        lengths = (self.offsets[terms[rare] + 1] - self.offsets[terms[rare]]).astype(np.int64)
        at = _ranges(self.offsets[terms[rare]], lengths)
        cells = np.repeat(text[rare] * width, lengths) + self.examples[at]
        sparse = np.bincount(cells, np.repeat(weights[rare], lengths) * self.weights[at], minlength=n * width).reshape(n, width)
        dense = np.zeros((n, len(self.common)))
        dense[text[~rare], self.row[terms[~rare]]] = weights[~rare]
        bounds = sparse.reshape(n, blocks, BLOCK).max(2) + dense @ self.tops
        best, ids = np.zeros((n, k)), np.full((n, k), -1)
        closed = bounds > 0

        def open_block(mine: np.ndarray, b: int) -> None:
            closed[mine, b] = False
            here = np.arange(b * BLOCK, (b + 1) * BLOCK)
            cosines = np.round(sparse[mine, here[0] : here[-1] + 1] + dense[mine] @ self.wide[:, here[0] : here[-1] + 1], 12)
            if without is not None:
                gone = np.flatnonzero(without[mine] // BLOCK == b)
                cosines[gone, without[mine[gone]] % BLOCK] = 0
            better = ((cosines > 0) & (cosines >= best[mine, -1:])).any(1)
            mine, cosines = mine[better], cosines[better]
            names = np.concatenate((ids[mine], np.where(cosines > 0, here, -1)), axis=1)
            values = np.concatenate((best[mine], cosines), axis=1)
            # Places without an example come after all others.
            first = np.lexsort((np.where(names < 0, width, names), -values), axis=1)[:, :k]
            row = np.arange(len(mine))[:, None]
            best[mine], ids[mine] = values[row, first], names[row, first]

        # The two blocks of the highest bounds first; then those that could still hold a neighbour.
        for turn in np.argsort(-bounds, axis=1, kind="stable")[:, :2].T:
            for b in np.unique(turn):
                mine = np.flatnonzero((turn == b) & closed[:, b])
                if len(mine):
                    open_block(mine, b)
        for b in range(blocks):
            mine = np.flatnonzero(closed[:, b] & (bounds[:, b] >= best[:, -1] - 1e-11))
            if len(mine):
                open_block(mine, b)
        return ids, np.where(ids >= 0, best, 0.0)

    def votes(self, ids: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The share of label 1 among the neighbours, by cosine; nan without neighbours."""
        total = cosines.sum(1)
        return np.where(total > 0, (cosines * np.append(self.labels, 0)[ids]).sum(1) / np.where(total > 0, total, 1), np.nan)


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    place: np.ndarray  # of each term among the telling ones, -1 for the others
    telling: BlockMaxIndex
    calibrations: dict[bool, tuple[np.ndarray, np.ndarray]]  # votes and what they mean, with and without telling terms
    silent: float  # the score of a text without neighbours
    k: int

    def vectors(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Weights of unit length of all terms, and offsets, places and weights of the telling ones."""
        w = (1 + np.log(counts.astype(float))) * self.idf[terms]
        told = self.place[terms] >= 0
        before = np.concatenate(([0], np.cumsum(told)))[offsets]
        return _unit(offsets, w), (before, self.place[terms[told]], _unit(before, w[told]))

    def vote(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The votes (nan without neighbours), if telling terms took part, and the neighbours by all terms with their cosines."""
        w, (told_at, told, told_w) = self.vectors(offsets, terms, counts)
        ids, cosines = self.index.search(offsets, terms, w, self.k, without)
        value = self.index.votes(ids, cosines)
        second = self.telling.votes(*self.telling.search(told_at, told, told_w, self.k, without))
        took_part = ~np.isnan(value) & ~np.isnan(second)
        return np.where(took_part, (value + second) / 2, value), took_part, ids, cosines

    def score(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, told, ids, cosines = self.vote(offsets, terms, counts)
        of = {t: np.interp(np.nan_to_num(value), *self.calibrations[t]) for t in (False, True)}
        return np.where(np.isnan(value), self.silent, np.where(told, of[True], of[False])), ids, cosines


def _unit(offsets: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights scaled so that those of each text have length 1."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    return w / np.sqrt(np.bincount(text, w * w, minlength=len(n)))[text]


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: a rising step function of x, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([b * w, w, a * w])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _examples(docs: DataFrame, labels: DataFrame, eligible: Column | None, id_col: str, text_col: str, label_col: str, examples: int) -> tuple[pa.Table, dict[int, int]]:
    """terms and counts (binary), label, key and mark of the examples, and how many labelled rows each class has."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label")).where("key is not null")
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    if eligible is not None:
        known = known.where(eligible)
    texts = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    marks = texts.select("key", F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(1), "text").alias("mark2")).join(known, "key")
    sizes = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    few = [marks.where(F.col("label") == v).orderBy("mark", "mark2", "key").limit(examples) for v in (0, 1)]
    picked = written(few[0].union(few[1]), "examples")  # at most twice ``examples`` rows
    chosen = texts.withColumns({"mark": F.xxhash64("text"), "mark2": F.xxhash64(F.lit(1), "text")}).join(F.broadcast(picked), ["key", "mark", "mark2"])

    def hashed(column: pa.Array) -> list:
        doc, term, counts = distinct(*term_hashes(column))
        ends = np.searchsorted(doc, np.arange(len(column) + 1))
        parts = list(zip(ends[:-1], ends[1:], strict=True))
        return [[term[a:b].tobytes() for a, b in parts], [counts[a:b].astype("<u4").tobytes() for a, b in parts]]

    found = add_columns(chosen, "text", hashed, "terms binary, counts binary", keep=["key", "label", "mark", "mark2"]).toArrow()
    return found.sort_by([(c, "ascending") for c in ("mark", "mark2", "label", "key")]), sizes


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, terms: int = TERMS, k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model, and the counts of known terms in each document (key, terms, counts), written once and used twice.

    At most ``examples`` labelled rows of each class are learned from, those with the least hashes of their texts among
    the ids for which ``eligible`` (an expression over the id column, named key) holds. Labels other than 0 and 1, null
    ids and ids whose labels contradict each other are not learned from; repeated rows of a document are an example
    each. Null and empty texts are examples without terms. Ties between neighbours go to the example whose text has the
    lower hash, of equal texts to label 0. Without a row of either class, and so for empty tables, every text scores the
    same. Ids of ``docs`` and ``labels`` have one type; other columns play no part.
    """
    spark = docs.sparkSession
    found, sizes = _examples(docs, labels, eligible, id_col, text_col, label_col, examples)
    mark = found["label"].to_numpy().astype(int)
    names = np.array(found["key"].to_pylist())
    term = np.frombuffer(b"".join(found["terms"].to_pylist()), np.uint64)
    often = np.frombuffer(b"".join(found["counts"].to_pylist()), "<u4")
    lengths = np.array([len(x) // 8 for x in found["terms"].to_pylist()], int)
    if len(set(mark)) < 2:
        mark, names, term, often, lengths = mark[:0], names[:0], term[:0], often[:0], lengths[:0]
    vocabulary = np.unique(term)

    def counted(column: pa.Array) -> list:
        doc, at, counts = chosen_counts(column, vocabulary)
        ends = pa.array(np.searchsorted(doc, np.arange(len(column) + 1)), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))]

    texts = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = written(add_columns(texts, "text", counted, "terms array<int>, counts array<int>", keep=["key"]), "term-counts")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row a term and task, not one a term and document.
        n = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(n))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held])], ["term", "n"])

    df = np.zeros(len(vocabulary))
    if len(vocabulary):
        per_term = counts.select("terms").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[per_term["term"].to_numpy()] = per_term["n"].to_numpy()
    idf = (np.log((1 + counts.count()) / (1 + df)) + 1).astype(np.float32)

    # Examples that say the same word most often stand together: blocks of like texts have low bounds for others.
    at, starts = np.searchsorted(vocabulary, term), np.concatenate(([0], np.cumsum(lengths)))
    example = np.repeat(np.arange(len(lengths)), lengths)
    leading = np.full(len(lengths), -1)
    strongest = np.lexsort((df[at], often, example))  # the last of each example
    leading[example[strongest]] = at[strongest]
    order = np.argsort(leading, kind="stable")
    take = _ranges(starts[:-1][order], lengths[order])
    at, often, lengths, mark, names = at[take].astype(np.int32), often[take].astype(np.float32), lengths[order], mark[order], names[order]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    place = np.full(len(vocabulary), -1, np.int32)
    if len(mark):
        told = telling_terms(np.repeat(np.arange(len(mark)), lengths), at, len(vocabulary), mark, terms)
        place[told] = np.arange(len(told))
    model = Model(vocabulary, idf, None, place, None, {}, 0.5, k)
    w, (told_at, told, told_w) = model.vectors(starts, at, often)
    model.index = BlockMaxIndex.build(names, mark, starts, at, w, len(vocabulary))
    model.telling = BlockMaxIndex.build(names, mark, told_at, told, told_w, int((place >= 0).sum()))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                own = batch.column(0).to_numpy()[a : a + BATCH]
                here = _ranges(starts[own], lengths[own])
                value, told, _, _ = model.vote(np.concatenate(([0], np.cumsum(lengths[own]))), at[here], often[here], own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(value), pa.array(told)], ["i", "value", "told"])

    votes = spark.range(len(mark), numPartitions=max(1, -(-len(mark) // BATCH))).mapInArrow(left_out, "i long, value double, told boolean").toArrow().sort_by("i")
    value, told = votes["value"].to_numpy(), votes["told"].to_numpy().astype(bool)
    # Each class weighs as all its labelled rows do.
    weight = np.array([sizes.get(v, 0) / max(1, int((mark == v).sum())) for v in (0, 1)])[mark] if len(mark) else np.zeros(0)
    for t in (False, True):
        mine = ~np.isnan(value) & (told == t)
        # Half a case of either kind at the ends keeps scores off 0 and 1 without evidence.
        model.calibrations[t] = _isotonic(np.append(value[mine], (0.0, 1.0)), np.append(mark[mine], (0.5, 0.5)), np.append(weight[mine], (1.0, 1.0)))
    silent = np.isnan(value)
    model.silent = float((0.5 + (weight * mark)[silent].sum()) / (1 + weight[silent].sum()))
    return model, counts


def score(docs_counts: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """key, score (double), predicted (int) and evidence: the nearest examples' ids, labels and cosines.

    Takes the counts that fit() returns, so each row of the documents gives one row; null and empty texts, and texts
    that share no term with the examples, have no neighbours and get the score that such examples have. Model and index
    are bounded by the number and length of the examples, and go to the tasks with the function.
    """
    kind = docs_counts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                terms, counts = part.column(1), part.column(2)
                offsets = terms.offsets.to_numpy().astype(np.int64)
                flat = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
                value, ids, cosines = model.score(offsets - offsets[0], flat[0], flat[1].astype(float))
                ids, cosines = ids[:, :evidence], cosines[:, :evidence]
                there = ids >= 0
                near = pa.StructArray.from_arrays([pa.array(model.index.doc_ids[ids[there]], part.column(0).type), pa.array(model.index.labels[ids[there]], pa.int32()), pa.array(cosines[there])], ["example", "label", "cosine"])
                ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(ends, near)], ["key", "score", "predicted", "evidence"])

    return docs_counts.select("key", "terms", "counts").mapInArrow(run, f"key {kind}, score double, predicted int, evidence array<struct<example:{kind},label:int,cosine:double>>")
