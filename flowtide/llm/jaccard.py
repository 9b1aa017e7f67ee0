"""Exact set-similarity join of documents on word shingles, and the components of its links.

Equal sets are one class. A class is indexed under the first tokens of its set in one global order (frequent tokens
last, else by hash): two sets similar enough share one of these. Relations between sets save most of the work:

* Index level: long lists are cut into blocks by set size and by the token's position in the set. Pairs of blocks whose
  sizes or positions are too far apart are skipped, and so are pairs of entries.
* Answer level: sets with almost the same tokens (twins) are found first, through a few tokens each. A twin is not
  looked up under the tokens that its leader is looked up under too: what the leader meets there, widened by the
  number of tokens in which they differ, holds all that the twin can meet. Only the tokens in which they differ are
  looked up for the twin itself, and it is compared with those answers of the leader that the difference leaves open.
* Sets that links join already need no answers from each other; lists within one component are not read again.

Pairs are ruled out by parity sketches, which never overstate a difference; those let through are compared set against
set. A group of similar sets in a list passes on a spanning forest of its likely links instead of all its pairs; where
one of these turns out not to be a link, all pairs of that block that are still open are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Spans, add_columns, discard, mix64, partitions, settings, slices, text_bytes, windows, word_spans, written

WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
#: A token is frequent if more than one in so many classes, and more than FEW, are indexed under it. At most that many
#: times the mean prefix length of tokens can be frequent, which bounds what is broadcast, whatever the input.
FREQUENT_SHARE, FEW = 1000, 64
#: Members of a block, about, and classes of positions in a long list.
BLOCK, POSITION_CLASSES = 512, 2
#: Tokens of each set through which twins are looked for; twins differ in at most one in TWIN of their tokens.
SEEDS, TWIN = 6, 16
#: Up to so many ids (8 bytes each) are broadcast to pick their texts; more are joined.
FEW_IDS = 1_000_000
#: Bits of a parity sketch. Sets of more than twice as many tokens also have a finer one.
BITS = 2048
#: Rows of an Arrow batch where rows hold whole sets.
SET_ROWS = 500
_GROUP = ["token", "i", "j"]


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; a shorter text is one shingle, one without words none."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets)
    hashes = Spans(raw).hashes(starts, ends)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(windows(hashes[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64)


def in_order(tokens: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """The first n of a set's tokens: those that aren't frequent by hash, then the frequent ones by hash."""
    if not len(frequent):
        return tokens[:n]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    return np.concatenate((tokens[~often], tokens[often]))[:n]


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each bucket of hashes: whether it has an odd number of the tokens. Differing bits never outnumber
    differing tokens."""
    return np.packbits(np.bincount((mix64(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)


def sketches(tokens: np.ndarray) -> tuple[bytes, bytes | None]:
    """A sketch of BITS, and for a large set a finer one, of half as many bits as it has tokens or more."""
    bits = BITS << max(0, (len(tokens) // 2).bit_length() - (BITS - 1).bit_length())
    fine = parity(tokens, bits)
    return folded(fine, BITS // 8).tobytes(), fine.tobytes() if bits > BITS else None


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch as one of fewer bytes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0) if len(sketch) > size else sketch


def differing_bits(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _prefixes(docs: DataFrame, words: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """key, n, h1, h2 (a digest of the set), prefix (tokens as longs), sketch and fine."""

    def compute(column: pa.Array) -> list:
        n, h1, h2, prefix, coarse, finer = [], [], [], [], [], []
        for s in shingle_sets(column, words):
            n.append(len(s))
            h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            h2.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)) if len(s) else 0)
            prefix.append(in_order(s, frequent, _prefix_length(len(s), num, den)).view(np.int64))
            both = sketches(s) if len(s) else (b"\0" * (BITS // 8), None)
            coarse.append(both[0])
            finer.append(both[1])
        ends = np.concatenate(([0], np.cumsum([len(p) for p in prefix])))
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix or [np.zeros(0, np.int64)]), pa.int64()))
        return [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), listed, pa.array(coarse, pa.binary()), pa.array(finer, pa.binary())]

    return add_columns(docs, "text", compute, "n long, h1 long, h2 long, prefix array<long>, sketch binary, fine binary", keep=["key"])


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _batches_by_list(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Sorted rows again, in tables that never cut a group of equal ``by``."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in by:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if kept and kept[-1].column(c)[-1].as_py() != v[0]:
                change[0] = True
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            if kept or last:
                yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


class _Forest:
    """Which entries of a batch of lists hang together, by numbers of their groups; likely links join groups."""

    def __init__(self, list_of: np.ndarray, component: np.ndarray):
        order = np.lexsort((component, list_of))
        new = np.ones(len(order), bool)
        new[1:] = (list_of[order][1:] != list_of[order][:-1]) | (component[order][1:] != component[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.root = np.arange(int(new.sum()))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def joined(self) -> np.ndarray:
        """The root of each entry."""
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return self.root[self.group]
            self.root = up

    def join(self, left: np.ndarray, right: np.ndarray) -> list[int]:
        """The pairs, by their places in the arguments, that join two groups."""
        out = []
        for k, (x, y) in enumerate(zip(self.group[left].tolist(), self.group[right].tolist(), strict=True)):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out.append(k)
        return out


def _compare(entries: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """token, i, j, a, b (a > b) and crew: pairs of one list and of different components that may be links.

    ``entries`` has token, i, j (its two blocks), side (which of them holds the entry), key, component, n, p (the
    token's position), low and high (sizes of the set and the twins it leads), radius (tokens in which these differ from
    it, at most), sketch and fine. ``crew`` marks pairs that can't be links themselves, but whose twins may be. With
    ``forest`` only as many pairs come as it takes to tie a list's likely links together.
    """
    slack, whole = den - num, den + num

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches_by_list(batches, _GROUP):
            c = {name: table.column(name).to_numpy() for name in (*_GROUP, "side", "key", "component", "n", "p", "low", "high", "radius")}
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
            fine = table.column("fine")
            large = fine.is_valid().to_numpy()
            new = np.ones(table.num_rows, bool)
            new[1:] = np.any([c[name][1:] != c[name][:-1] for name in _GROUP], axis=0)
            starts, of_list = np.flatnonzero(new), np.cumsum(new) - 1
            sizes = np.diff(np.append(starts, table.num_rows))
            room = starts[of_list] + sizes[of_list] - np.arange(table.num_rows)
            held = _Forest(of_list, c["component"])
            root, live, found, crews = held.joined(), np.arange(table.num_rows), [], []
            for lag in range(1, int(sizes.max())):
                live = live[room[live] > lag]
                left, right = live, live + lag
                fit = root[left] != root[right]
                fit &= (c["side"][left] != c["side"][right]) | (c["i"][left] == c["j"][left])
                fit &= (den * c["high"][left] >= num * c["low"][right]) & (den * c["high"][right] >= num * c["low"][left])
                left, right = left[fit], right[fit]
                total, wide = c["n"][left] + c["n"][right], c["radius"][left] + c["radius"][right]
                most = (c["high"][left] + c["high"][right]) * slack
                # The tokens before the shared one and those behind it: so many can be common at most.
                common = 1 + np.minimum(c["p"][left], c["p"][right]) + np.minimum(c["n"][left] - c["p"][left], c["n"][right] - c["p"][right]) - 1
                apart = total - 2 * common
                fit = (apart - wide) * whole <= most
                left, right, total, wide, most, apart = (x[fit] for x in (left, right, total, wide, most, apart))
                if not len(left):
                    continue
                apart = np.maximum(apart, np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1, dtype=np.int64))
                for k in np.flatnonzero(large[left] & large[right] & ((apart - wide) * whole <= most)):
                    apart[k] = max(apart[k], differing_bits(fine[int(left[k])].as_py(), fine[int(right[k])].as_py()))
                direct = apart * whole <= total * slack
                if forest and direct.any():
                    kept = held.join(left[direct], right[direct])
                    found.append((left[direct][kept], right[direct][kept]))
                    root = held.joined()
                elif direct.any():
                    found.append((left[direct], right[direct]))
                widened = (wide > 0) & ((apart - wide) * whole <= most)
                if widened.any():
                    crews.append((left[widened], right[widened]))
            root = held.joined()
            open_ = [(x[root[x] != root[y]], y[root[x] != root[y]]) for x, y in crews]
            out = [(x, y, crew) for pairs, crew in ((found, False), (open_, True)) for x, y in pairs]
            if out:
                left, right = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                a, b = c["key"][left], c["key"][right]
                arrays = [*[c[name][left] for name in _GROUP], np.maximum(a, b), np.minimum(a, b), np.repeat([o[2] for o in out], [len(o[0]) for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [*_GROUP, "a", "b", "crew"])

    dealt = entries.repartition(partitions(entries.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP, "side", "n", "key")
    return dealt.select(*_GROUP, "side", "key", "component", "n", "p", "low", "high", "radius", "sketch", "fine").mapInArrow(compare, "token long, i long, j long, a long, b long, crew boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component): of each document with a link the smallest id that links lead to.

    Alternates large stars (neighbours above a node go to its smallest neighbour) and small stars (the others do) until
    nothing changes; minima are combined before they are shuffled, and each turn's edges are written, so no group is
    gathered and lineage stays short.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # Done when every node has one edge, to a node that has none.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "stars")
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(large)


def _verified(texts: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """a, b, differ (tokens that one of both holds): the pairs whose sets are similar enough, written."""
    pairs = written(pairs, "pairs")
    wanted = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted

    def whole(column: pa.Array) -> list:
        return [pa.array([s.tobytes() for s in shingle_sets(column, words)], pa.binary())]

    sets = written(add_columns(texts.join(few, "key", "left_semi"), "text", whole, "tokens binary", keep=["key"]), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                differ, hit = [], []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    differ.append(len(x) + len(y) - 2 * common)
                    hit.append(den * common >= num * (len(x) + len(y) - common))
                mask = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([*[part.column(k).filter(mask) for k in ("a", "b")], pa.array(differ, pa.int64()).filter(mask)], ["a", "b", "differ"])

    x, y = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    with settings(texts.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(SET_ROWS)}):
        done = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long, differ long"), "links")
    for table in (pairs, wanted, sets):
        discard(table)
    return done


def _twins(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, leader, differ: sets that follow a twin. Leaders follow nobody: their hash is the least among their twins'."""
    near = links.join(sizes.select(F.col("key").alias("a"), "n"), "a").where(F.col("differ") * TWIN <= F.col("n"))
    near = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "differ").union(near.select("b", "a", "differ"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
    leaders = near.groupBy("x").agg(F.min(rank("y")).alias("least")).where(rank("x") < F.col("least")).select(F.col("x").alias("y"))
    followed = near.join(leaders, "y").groupBy("x").agg(F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("k"), "differ")).alias("to"))
    return followed.select(F.col("x").alias("key"), F.col("to.k").alias("leader"), F.col("to.differ").alias("differ"))


def _blocks(lists: DataFrame, num: int, den: int) -> DataFrame:
    """``lists`` (with members, low, high, p, radius) once for each pair of blocks that an entry takes part in: i, j, side.

    Lists of at most BLOCK members are one block. Longer ones are cut by size (a step is the factor that the threshold
    allows), by the position's share of the prefix and, where that isn't enough, by hash.
    """
    step = float(np.log(den / num)) if num < den else 1.0
    cut = F.floor(F.log("n") / step) * POSITION_CLASSES + F.floor(F.col("p") * POSITION_CLASSES / (F.floor(F.col("n") * (den - num) / den) + 1))
    long = lists.where(F.col("members") > BLOCK).withColumn("cut", cut.cast("long"))
    in_cut = long.groupBy("token", "cut").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    long = long.join(in_cut, ["token", "cut"]).withColumn("i", F.col("cut") * (1 << 32) + F.pmod(F.xxhash64("key"), "parts")).drop("cut", "parts")
    cut_up = written(long.unionByName(lists.where(F.col("members") <= BLOCK).withColumn("i", F.lit(0).cast("long"))), "blocks")
    own = cut_up.withColumns({"j": F.col("i"), "side": F.lit(0)})
    spread = cut_up.where(F.col("members") > BLOCK).groupBy("token", "i").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        F.min("p").alias("first"),
        F.max("p").alias("last"),
        F.max("radius").alias("radius"),
    )
    x, y = (spread.select("token", *[F.col(c).alias(f"{c}_{s}") for c in spread.columns[1:]]) for s in "xy")
    meet = x.join(y, "token").where("i_x < i_y")
    sizes = (F.col("high_x") * den >= F.col("low_y") * num) & (F.col("high_y") * den >= F.col("low_x") * num)
    # The least difference of any two entries of the blocks: tokens before the shared one on one side, or behind it.
    ahead = F.greatest(F.col("first_x") - F.col("last_y"), F.col("first_y") - F.col("last_x"), F.lit(0))
    behind = F.greatest(F.col("least_x") - F.col("last_x") - F.col("most_y") + F.col("first_y"), F.col("least_y") - F.col("last_y") - F.col("most_x") + F.col("first_x"), F.lit(0))
    near = (ahead + behind - F.col("radius_x") - F.col("radius_y")) * (den + num) <= (F.col("high_x") + F.col("high_y")) * (den - num)
    meet = meet.where(sizes & near).select("token", "i_x", "i_y")
    columns = cut_up.columns

    def other(mine: str, side: int) -> DataFrame:
        places = ["i", F.col("i_y").alias("j")] if mine == "x" else [F.col("i_x").alias("i"), F.col("i").alias("j")]
        joined = cut_up.join(meet.withColumnRenamed(f"i_{mine}", "i"), ["token", "i"])
        return joined.select(*[c for c in columns if c != "i"], *places, F.lit(side).alias("side"))

    entries = written(own.unionByName(other("x", 0)).unionByName(other("y", 1)), "entries")
    discard(cut_up)
    return entries


def _crews(pairs: DataFrame, followers: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of twins of two leaders (or of these themselves) that their sketches leave open."""
    crew = followers.select("leader", "key").union(pairs.select("a", "a")).union(pairs.select("b", "b")).distinct()
    both = pairs.join(crew.select(F.col("leader").alias("a"), F.col("key").alias("x")), "a").join(crew.select(F.col("leader").alias("b"), F.col("key").alias("y")), "b").select("x", "y").distinct()
    of = lambda c: sketched.select(F.col("key").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("n", "sketch", "fine")])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n_x, n_y = (batch.column(c).to_numpy() for c in ("x", "y", "n_x", "n_y"))
            hit = []
            for k in range(batch.num_rows):
                which = "fine" if batch.column("fine_x")[k].is_valid and batch.column("fine_y")[k].is_valid else "sketch"
                hit.append(differing_bits(batch.column(f"{which}_x")[k].as_py(), batch.column(f"{which}_y")[k].as_py()) * (den + num) <= (n_x[k] + n_y[k]) * (den - num))
            hit = np.array(hit, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[hit]), pa.array(np.minimum(x, y)[hit])], ["a", "b"])

    return both.join(of("x"), "x").join(of("y"), "y").select("x", "y", "n_x", "n_y", "sketch_x", "sketch_y", "fine_x", "fine_y").mapInArrow(check, "a long, b long").distinct()


def _with_components(entries: DataFrame, found: DataFrame) -> DataFrame:
    return entries.drop("component").join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """key (the id as long), n_shingles and component_id for each document.

    Two documents link when den * intersection >= num * union of their sets of shingles (A-Z lower-cased, words split at
    ASCII white space); component_id is the smallest id that links lead to, the document's own without any. Null and
    empty texts and texts without words have no shingles and link with nothing. Rows that share an id are one document,
    whose texts all count; rows with a null id link with nothing and have a null component. Ids are integers. Other
    columns play no part; an empty table gives an empty table. Links within a component that others imply are not
    looked for, so they are not counted either.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    indexed = written(_prefixes(texts, words, num, den, np.zeros(0, np.uint64)), "prefixes")
    classes = written(indexed.where("n > 0 and key is not null").groupBy("h1", "h2", "n").agg(F.min("key").alias("class")), "classes")

    def representatives(s: DataFrame) -> DataFrame:
        own = classes.select(F.col("class").alias("key"), "h1", "h2", "n")
        return s.join(own, ["key", "h1", "h2", "n"]).dropDuplicates(["key", "h1", "h2"])

    least = max(FEW, classes.count() // FREQUENT_SHARE)
    often = representatives(indexed).select(F.explode("prefix").alias("token")).groupBy("token").count().where(F.col("count") > least)
    frequent = np.sort(often.select("token").toArrow().column(0).to_numpy().view(np.uint64))
    if len(frequent):
        before, indexed = indexed, written(_prefixes(texts, words, num, den, frequent), "prefixes")
        discard(before)
    kept = written(representatives(indexed).select("key", "n", "prefix", "sketch", "fine"), "sets")
    sketched = kept.select("key", "n", "sketch", "fine")
    listed = kept.select("key", "n", F.posexplode("prefix").alias("p", "token")).select("token", "key", F.col("n").cast("long").alias("n"), F.col("p").cast("long").alias("p"))
    members = listed.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    lists = written(listed.join(members, "token"), "lists")

    # Twins, and whatever else is close, through a few tokens and within hashed blocks of long lists.
    alone = {"component": F.col("key"), "low": F.col("n"), "high": F.col("n"), "radius": F.lit(0).cast("long"), "side": F.lit(0)}
    hashed = F.pmod(F.xxhash64("key", "token"), F.ceil(F.col("members") / BLOCK)).cast("long")
    seeds = lists.where(F.col("p") < SEEDS).withColumns({"i": hashed, "j": hashed, **alone}).join(sketched.drop("n"), "key")
    tested = written(_compare(seeds, num, den, True).select("a", "b").distinct(), "tested")
    links = _verified(texts, tested, words, num, den)
    found = components(links)
    ambiguous = kept.groupBy("key").count().where("count > 1").select("key")
    twins = _twins(links, sketched).join(ambiguous, "key", "left_anti").join(ambiguous.withColumnRenamed("key", "leader"), "leader", "left_anti")
    twins = written(twins.join(sketched.select("key", "n"), "key"), "twins")

    # The rest of the index: twins only under tokens that their leaders don't have.
    following = lists.join(twins.select("key", "leader"), "key")
    apart = following.join(lists.select("token", F.col("key").alias("leader")), ["token", "leader"], "left_anti")
    crews = twins.groupBy(F.col("leader").alias("key")).agg(F.max("differ").alias("radius"), F.min("n").alias("crew_low"), F.max("n").alias("crew_high"))
    reduced = lists.join(twins.select("key"), "key", "left_anti").unionByName(apart.drop("leader")).drop("members")
    reduced = _with_components(reduced, found).join(crews, "key", "left")
    reduced = reduced.withColumns({"radius": F.coalesce("radius", F.lit(0)).cast("long"), "low": F.least("n", "crew_low"), "high": F.greatest("n", "crew_high")}).drop("crew_low", "crew_high")
    reduced = written(reduced, "index")
    split = reduced.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("token", "members")
    blocks = _blocks(reduced.join(split, "token"), num, den)
    discard(lists)
    discard(reduced)
    likely = written(_compare(blocks.join(sketched.drop("n"), "key"), num, den, True), "likely")
    links = [links.select("a", "b")]

    def check(pairs: DataFrame) -> None:
        """Compares pairs that nobody has compared; crews by their twins."""
        nonlocal tested
        open_ = _crews(pairs.where("crew").select("a", "b").distinct(), twins, sketched, num, den)
        fresh = pairs.where("not crew").select("a", "b").union(open_).distinct().join(tested, ["a", "b"], "left_anti")
        fresh = written(fresh, "fresh")
        tested = tested.union(fresh)
        links.append(_verified(texts, fresh, words, num, den).select("a", "b"))

    check(likely)
    every = reduce(DataFrame.union, links)
    failed = likely.where("not crew").join(every, ["a", "b"], "left_anti").select(*_GROUP).distinct()
    again = written(blocks.join(failed, _GROUP, "left_semi"), "again")
    if not again.isEmpty():
        check(written(_compare(_with_components(again, components(every)).join(sketched.drop("n"), "key"), num, den, False), "likely"))

    # A document belongs to its class, the class to its component; an id with several texts ties their classes.
    placed = written(indexed.select("key", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").select("key", "n", "class"), "members")
    several = placed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b").select("a", "b")
    of_class = components(reduce(DataFrame.union, links).union(several))
    placed = placed.join(of_class.withColumnRenamed("id", "class"), "class", "left")
    return placed.groupBy("key").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("component", "class", "key")).alias("component_id"))
