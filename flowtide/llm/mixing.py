"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents stand in a random order (by hash) as one stream of words, cut into blocks of equal length. Its
target gives an exact quota of blocks: whole rounds through the source and part of a last round. A binary tree splits
all quotas among the output shards: at each node a multivariate hypergeometric draw decides how many blocks of each
source go left, so every shard is a fair sample of the mix and no quota is off by a block. Each shard then draws its
count from the source's permuted blocks, disjoint from all other shards', and shuffles its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

WEIGHTS, MAX_REPEATS = (1, 2, 3), 3
#: Words of a block and, about, of an output shard.
BLOCK_WORDS, SHARD_WORDS = 8192, 4 << 20
#: Documents of a slice, in which one window runs.
SLICE_DOCS = 2000
#: Up to so many sources (one short row each) are broadcast.
BROADCAST_SOURCES = 100_000
#: Step of the permutation of a source's blocks: a prime above any number of blocks.
_PRIME = 2**31 - 1
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: source, place, n_docs, source_size, target.

    Weights go round the sources by code point, null last. Targets share the total size by weight; none is above
    ``max_repeats`` times its source's size, what others lose that way is shared by weight again.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))) + 1))
    per = per.withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    # Sources in the order in which they reach their caps; the first that needn't be capped tells the level of all after it.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()) - capped) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy()))
    return per.select("source", "place", "n_docs", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` blocks are among ``good`` of them; the inverse distribution at u.

    Probabilities are taken relative to the mode's, first upwards, then downwards, to the ends of the support or to 12
    standard deviations and 40, beyond which they are below a double's resolution.
    """
    least, most = F.greatest(F.lit(0), draws + good - total), F.least(good, draws)
    mode = F.greatest(least, F.least(most, F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")))
    share = good / F.greatest(total, F.lit(1))
    reach = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), draws * share * (1 - share)))).cast("long") + 40
    up = F.sequence(F.lit(0).cast("long"), F.least(most - mode, reach))
    down = F.sequence(F.lit(0).cast("long"), F.least(mode - least, reach))

    def rise(x: Column) -> Column:  # p(x) / p(x - 1)
        return (good - x + 1.0) * (draws - x + 1.0) / (x * (total - good - draws + x).cast("double"))

    def fall(x: Column) -> Column:  # p(x) / p(x + 1)
        return (x + 1.0) * (total - good - draws + x + 1.0) / ((good - x).cast("double") * (draws - x))

    def walk(steps: Column, sign: int, goal: Column | None) -> Column:
        """Adds up weights from the mode outwards; the sum, or the first place where it reaches the goal."""
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), mode.alias("x"))

        def step(s: Column, k: Column) -> Column:
            x = mode + k * sign
            w = F.when(k == 0, F.lit(0.0 if sign < 0 else 1.0)).otherwise(s["w"] * (rise(x) if sign > 0 else fall(x)))
            carry = F.when(k == 0, F.lit(1.0)).otherwise(w)
            return F.struct(carry.alias("w"), (s["sum"] + w).alias("sum"), (F.when(s["sum"] <= goal, x).otherwise(s["x"]) if goal is not None else s["x"]).alias("x"))

        return F.aggregate(steps, start, step, lambda s: s["x"] if goal is not None else s["sum"])

    above, below = walk(up, 1, None), walk(down, -1, None)
    at = u * (above + below)
    drawn = F.when(at < above, walk(up, 1, at)).otherwise(walk(down, -1, at - above))
    return F.when(least == most, least).otherwise(drawn).cast("long")


def split_left(quotas: Column, node: Column, seed: int) -> Column:
    """Of each source's blocks at a node, how many go to the left child, which gets half of all."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(total.alias("total"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, good: Column) -> Column:
        x = hypergeometric(s["total"], good, s["draws"], _uniform(F.lit(seed), node, F.size(s["out"])))
        # Draws once, then uses the count: an array of one element is the lambda language's let.
        return F.element_at(F.transform(F.array(x), lambda n: F.struct((s["total"] - good).alias("total"), (s["draws"] - n).alias("draws"), F.concat(s["out"], F.array(n)).alias("out"))), 1)

    return F.aggregate(quotas, start, step, lambda s: s["out"])


def splitting_tree(root: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(node, quotas) of the leaves, from one row ``quotas`` (array<long>): 2 ** levels shards."""
    nodes = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        if level == 8:
            nodes = nodes.repartition(partitions(nodes.sparkSession), "node")
        # Generators between the levels keep the optimiser from copying a draw into all its uses.
        drawn = nodes.select("node", "quotas", F.explode(F.array(split_left(F.col("quotas"), F.col("node") + F.lit(1 << level), seed))).alias("left"))
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")))
        nodes = drawn.select(F.inline(children))
    return nodes


@dataclass
class Mix:
    """documents: id, key1, key2, source, size; sources: source_targets(); draws: the rows of the mix."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 0,
) -> Mix:
    """Draws a mix of all documents whose words share the total by the weights.

    ``draws`` has id, key1, key2, source, shard, position (in the shard, from 0), round (how many times the source was
    gone through before), first_word and n_words: the words of the document that are taken there. A source's n_words add
    up to its rounded target; a document is taken whole in each round but at the edges of blocks, and at most
    ``max_repeats`` times. The same input and seed give the same draws.

    Null and empty texts have size 0 and are never drawn. Rows equal in id and text are one document, also with a null
    id. Null sources are a source of their own, the last. Other columns play no part. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.xxhash64(F.lit(k), F.col(f"`{id_col}`"), text).alias(f"key{k}") for k in (1, 2)], F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    sized = written(keyed.groupBy("key1", "key2").agg(*[F.min(c).alias(c) for c in ("id", "source", "size")]), "sized")
    sources = written(source_targets(sized, weights, max_repeats), "sources")

    n = sources.select(
        "place",
        "source",
        "source_size",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLICE_DOCS)).cast("long").alias("slices"),
        F.floor(F.col("source_size") / block_words).cast("long").alias("full"),
        F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"),
        F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats).alias("words"),
    )
    rounds = F.floor(F.col("words") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    n = n.withColumn("rest", F.col("words") - rounds * F.col("source_size"))
    n = n.withColumn("quota", rounds * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    few = (lambda d: F.broadcast(d)) if sources.count() <= BROADCAST_SOURCES else (lambda d: d)

    # Where each document begins in its source's stream: sums of whole slices before it, then of documents before it in its slice.
    sliced = sized.join(few(n.select("source", "place", "slices")), sized["source"].eqNullSafe(n["source"])).drop(n["source"])
    sliced = sliced.where("size > 0").withColumn("slice", F.pmod("key2", "slices"))
    totals = sliced.groupBy("place", "slice").agg(F.sum("size").alias("words"))
    before = totals.select("place", "slice", (F.sum("words").over(Window.partitionBy("place").orderBy("slice")) - F.col("words")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("place", "slice").orderBy("key1", "key2")) - F.col("size")
    streamed = sliced.withColumn("inside", inside).join(before, ["place", "slice"]).withColumn("at", F.col("before") + F.col("inside"))

    blocks = F.sequence(F.floor(F.col("at") / block_words).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / block_words).cast("long"))
    pieces = streamed.withColumn("block", F.explode(blocks))
    first, last = F.greatest(F.col("at"), F.col("block") * block_words), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("place", "block", "id", "key1", "key2", "source", (first - F.col("at")).alias("first_word"), (last - first).alias("n_words"), (first - F.col("block") * block_words).alias("block_word"))

    words = sources.agg(F.sum("source_size")).first()[0] or 0
    levels = max(0, (-(-words // shard_words) - 1).bit_length())
    root = n.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("q")).select(F.transform("q", lambda x: x["quota"]).alias("quotas"))
    leaves = splitting_tree(root, levels, seed).select(F.col("node").alias("shard"), F.posexplode("quotas").alias("place", "count")).where("count > 0")
    ends = F.sum("count").over(Window.partitionBy("place").orderBy("shard"))
    slots = leaves.withColumn("end", ends).select("place", "shard", F.explode(F.sequence(F.col("end") - F.col("count"), F.col("end") - 1)).alias("slot"))
    slots = slots.join(few(n.drop("source", "slices")), "place")
    turn, j = F.floor(F.col("slot") / F.col("blocks")).cast("long"), F.pmod("slot", "blocks")
    slots = slots.withColumn("round", turn).withColumn("j", j)
    permuted = F.pmod(F.col("j") * F.pmod(F.lit(_PRIME), "full") + F.pmod(F.xxhash64(F.lit(seed), "place", "round"), F.col("full")), F.col("full"))
    block = F.when(F.col("j") < F.col("full"), permuted).otherwise(F.col("j"))
    cut = F.when((F.col("slot") == F.col("quota") - 1) & (F.col("rest") > 0), F.col("rest") - F.col("j") * block_words).otherwise(block_words)
    slots = slots.select("place", "shard", "round", block.alias("block"), cut.alias("cut"))

    taken = F.least("n_words", F.col("cut") - F.col("block_word"))
    drawn = pieces.join(slots, ["place", "block"]).withColumn("n_words", taken).where("n_words > 0")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "round", "key1", "key2"), "round", "key1", "key2", "first_word")
    draws = drawn.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    return Mix(sized, sources, draws.select("id", "key1", "key2", "source", "shard", "position", "round", "first_word", "n_words"))


def mixed_documents(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text", position: bool = False) -> DataFrame:
    """The mix as documents: the columns of ``docs`` once for each draw, the text cut to the words drawn, white space kept.

    With ``position`` the columns shard and position come along.
    """
    text = F.col(f"`{text_col}`").cast("string")
    kept = docs.columns
    unique = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("text"), *[F.xxhash64(F.lit(k), F.col(f"`{id_col}`"), text).alias(f"key{k}") for k in (1, 2)]).dropDuplicates(["key1", "key2"])
    joined = mixed.draws.select("key1", "key2", "first_word", "n_words", "shard", "position", "round").join(unique, ["key1", "key2"])
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # White space before the first word makes a piece without a word.
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    whole = (F.col("first_word") == 0) & (F.col("n_words") == F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)))
    span = F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words, (F.col("first_word") + 1 + lead).cast("int"), F.col("n_words").cast("int")), ""))
    out = [span.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return joined.select(*out, *(["shard", "position"] if position else []))
