"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

Viterbi decoding finds the best marks of a document's lines together; the share of words on content lines decides
whether the document stays. Plain counts (words, symbols, repeated lines, repeated 5-word windows) come along and
reject documents that are too short or too repetitive before that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Spans, add_columns, counts_between, text_bytes, windows, word_spans

#: Labelled documents of each class, at most, that the field is fitted on; those with the lowest hashes of their ids.
FIT_DOCS = 1500
#: A document stays if at least so many of its words are on content lines.
CONTENT_SHARE = 0.5
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(ord("A"), ord("Z") + 1)))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_STOP = np.isin(np.arange(256), list(b".?!;:,"))
_SHOUT = np.isin(np.arange(256), list(b"!"))
_CONT = np.arange(256) & 0xC0 == 0x80
FEATURES = ("bias", "few_words", "log_words", "upper", "digits", "symbols", "symbol_heavy", "shouts", "stops", "seen_before", "repeated", "all_repeated", "word_length", "long_words")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class Lines:
    """The lines that hold words, of a slice of texts: their features, words, and where each text's lines begin."""

    features: np.ndarray
    words: np.ndarray
    offsets: np.ndarray


def _seen_before(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the same key came earlier in the same group."""
    order = np.lexsort((keys, group))
    same = np.zeros(len(keys), bool)
    same[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    return same


def _seen_twice(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, group))
    same = (keys[order[1:]] == keys[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def measure(column: pa.Array) -> tuple[list[np.ndarray], Lines]:
    """The base counts of each text, and its lines."""
    raw, offsets = text_bytes(column)
    spans = Spans(raw)
    starts, ends, first = word_spans(raw, offsets)
    n_words = np.diff(first)
    in_word = ~SPACES[raw]
    word_chars = counts_between(in_word & ~_CONT[raw], offsets)
    n_symbols = counts_between(_SYMBOLS[raw], offsets)

    doc_of_word = np.repeat(np.arange(len(n_words)), n_words)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= WINDOW:
        whole = doc_of_word[: len(starts) - WINDOW + 1] == doc_of_word[WINDOW - 1 :]
        keys = windows(spans.hashes(starts, ends), WINDOW)
        at = np.flatnonzero(whole)
        at = at[_seen_twice(doc_of_word[at], keys[at])]
        for k in range(WINDOW):
            repeated[at + k] = True
    n_repeat = counts_between(repeated, first)

    # Lines: the bytes between line ends and texts' ends.
    ends_of_lines = np.flatnonzero(raw == 0x0A)
    line_starts = np.concatenate((offsets[:-1], ends_of_lines + 1))
    line_ends = np.concatenate((ends_of_lines, offsets[1:]))
    line_starts, line_ends = np.sort(line_starts), np.sort(line_ends)
    of_line = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = of_line[1] > of_line[0]
    line_starts, line_ends, word_from, word_to = line_starts[full], line_ends[full], of_line[0][full], of_line[1][full]
    doc_of_line = np.searchsorted(offsets, line_starts, side="right") - 1
    again = _seen_before(doc_of_line, spans.hashes(line_starts, line_ends))
    n_dup = np.bincount(doc_of_line[again], minlength=len(n_words)).astype(np.int64)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[line_ends] - sums[line_starts]) / np.maximum(of, 1)

    n = word_to - word_from
    chars = share(in_word & ~_CONT[raw], np.ones(1))
    symbols = share(_SYMBOLS[raw], n)
    rep = np.concatenate(([0], np.cumsum(repeated)))
    rep = (rep[word_to] - rep[word_from]) / np.maximum(n, 1)
    length = chars / np.maximum(n, 1)
    features = np.column_stack(
        [np.ones(len(n)), n < 4, np.log1p(n) / 5, share(_UPPER[raw], chars), share(_DIGIT[raw], chars), np.minimum(symbols, 2), symbols > 0.3, np.minimum(share(_SHOUT[raw], n), 2), np.minimum(share(_STOP[raw], n), 2), again, rep, rep > 0.9, length / 10, length > 9]
    ).astype(float)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat], Lines(features, n, np.searchsorted(doc_of_line, np.arange(len(n_words) + 1)))


@dataclass
class ChainField:
    """A linear-chain conditional random field of two marks: 0 boilerplate, 1 content."""

    weights: np.ndarray  # features x 2
    moves: np.ndarray  # from x to

    @classmethod
    def plain(cls) -> ChainField:
        """Weights for use without labels: symbols, shouting and repeats speak against content."""
        w = dict.fromkeys(FEATURES, 0.0) | {"bias": 2.0, "upper": -4.0, "symbol_heavy": -3.0, "shouts": -3.0, "seen_before": -1.0, "all_repeated": -2.0}
        return cls(np.column_stack([np.zeros(len(FEATURES)), [w[f] for f in FEATURES]]), np.eye(2))

    @classmethod
    def fit(cls, lines: list[np.ndarray], marks: list[np.ndarray], steps: int = 150, ridge: float = 1e-3, stiff: float = 0.1) -> ChainField:
        """Maximises the mean log-likelihood of the marks; each document weighs the same.

        Marks that hold for whole documents would make any change of marks impossible, so ``stiff`` bounds the moves.
        """
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        lines, marks = [lines[i] for i in order], [marks[i] for i in order]
        n = np.array([len(x) for x in lines])
        # Line t of every document that has one, then line t + 1 of them: documents of more lines come first.
        live = [int(np.searchsorted(-n, -t, side="left")) for t in range(n[0])]
        place = np.argsort(np.concatenate([np.arange(k) for k in n]), kind="stable")
        x, truth = np.concatenate(lines)[place], np.eye(2)[np.concatenate(marks).astype(int)[place]]
        weight = (1 / n / len(n))[np.repeat(np.arange(len(n)), n)[place]]
        at = np.concatenate(([0], np.cumsum(live)))
        left = np.concatenate([np.arange(at[t - 1], at[t - 1] + live[t]) for t in range(1, n[0])] or [np.zeros(0, int)])
        right = np.arange(at[1], at[-1])
        ends = at[n - 1] + np.arange(len(n))
        doc = np.concatenate([np.arange(k) for k in live])
        w, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
        m = [np.zeros_like(w), np.zeros_like(moves)]
        v = [np.zeros_like(w), np.zeros_like(moves)]
        for step in range(1, steps + 1):
            scores = x @ w
            ahead, back = scores.copy(), np.zeros_like(scores)
            for t in range(1, n[0]):
                before = ahead[at[t - 1] : at[t - 1] + live[t]]
                ahead[at[t] : at[t + 1]] += np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
            for t in range(n[0] - 2, -1, -1):
                after = scores[at[t + 1] : at[t + 2]] + back[at[t + 1] : at[t + 2]]
                back[at[t] : at[t] + live[t + 1]] = np.logaddexp(after[:, :1] + moves[:, 0], after[:, 1:] + moves[:, 1])
            total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])[doc]
            odds = np.exp(ahead + back - total[:, None])
            grad_w = x.T @ ((truth - odds) * weight[:, None]) - ridge * w
            pair = np.exp(ahead[left][:, :, None] + moves + (scores + back)[right][:, None, :] - total[right][:, None, None])
            grad_m = ((truth[left][:, :, None] * truth[right][:, None, :] - pair) * weight[right][:, None, None]).sum(0) - stiff * moves
            for k, (value, grad) in enumerate(((w, grad_w), (moves, grad_m))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                value += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return cls(w, moves)

    def viterbi(self, lines: Lines) -> np.ndarray:
        """The best marks of every line, document by document; of equal paths the one with more content at its end."""
        scores = lines.features @ self.weights
        n = np.diff(lines.offsets)
        order = np.argsort(-n, kind="stable")
        at, n = lines.offsets[:-1][order], n[order]
        best = np.zeros((len(n), 2))
        came = np.zeros((len(scores), 2), np.int8)
        for t in range(n[0] if len(n) else 0):
            live = int(np.searchsorted(-n, -t, side="left"))  # documents of more than t lines
            now = at[:live] + t
            if t:
                paths = best[:live, :, None] + self.moves
                came[now] = paths[:, 1] >= paths[:, 0]
                best[:live] = np.maximum(paths[:, 0], paths[:, 1]) + scores[now]
            else:
                best[:live] = scores[now]
        marks = np.zeros(len(scores), np.int8)
        mark = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range((n[0] if len(n) else 0) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            now = at[:live] + t
            marks[now] = mark[:live]
            mark[:live] = came[now, mark[:live]]
        return marks


def fit_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS) -> ChainField:
    """Fits the field on at most ``fit_docs`` labelled documents of each class.

    Lines of documents labelled 1 count as content, those of documents labelled 0 as boilerplate. Where one of the
    classes has no document with words, the result is ``ChainField.plain()``. Null ids and other labels are passed over; an
    id labelled both ways counts as 1, whatever the order of the rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("mark")).where("key is not null").groupBy("key").agg(F.max("mark").alias("mark"))
    chosen = None
    for mark in (0, 1):
        few = known.where(F.col("mark") == mark).orderBy(F.xxhash64("key"), "key").limit(fit_docs)
        chosen = few if chosen is None else chosen.union(few)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key")

    def lines(column: pa.Array) -> list:
        _, found = measure(column)
        return [[found.features[a:b].tobytes() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]]

    rows = add_columns(texts, "text", lines, "lines binary", keep=["key", "mark"]).collect()
    rows = sorted((r for r in rows if r["lines"]), key=lambda r: r["key"])
    if len({r["mark"] for r in rows}) < 2:
        return ChainField.plain()
    features = [np.frombuffer(r["lines"], float).reshape(-1, len(FEATURES)) for r in rows]
    return ChainField.fit(features, [np.full(len(f), r["mark"]) for f, r in zip(features, rows, strict=True)])


def judge(docs: DataFrame, field: ChainField, text_col: str = "text", content_share: float = CONTENT_SHARE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed (boolean),
    line_marks (array of 0 boilerplate, 1 content; lines without words have none), content_share (double) and kept.

    Null and empty texts have no words, so they fail the base rules. Repeated rows are judged each on its own;
    columns with the names of the new ones give way to them, all others pass (``keep`` names fewer). A text is judged
    whole, however long. An empty table gives an empty table.
    """

    def compute(column: pa.Array) -> list:
        counts, lines = measure(column)
        marks = field.viterbi(lines)
        n_words, n_repeat = counts[0], counts[4]
        failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
        sums = np.concatenate(([0], np.cumsum(lines.words * marks)))
        share = (sums[lines.offsets[1:]] - sums[lines.offsets[:-1]]) / np.maximum(n_words, 1)
        listed = pa.ListArray.from_arrays(pa.array(lines.offsets, pa.int32()), pa.array(marks, pa.int8()))
        return [*counts, failed, listed, share, ~failed & (share >= content_share)]

    return add_columns(docs, text_col, compute, f"{BASE}, base_failed boolean, line_marks array<byte>, content_share double, kept boolean", keep)
