"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

A text's paragraphs are its lines, those over a number of characters (240 in the query) cut there; each distinct one gives a 64-bit key. A sketch
has three tables of cells; a key is counted and XORed into one cell of each. Subtracting two sketches leaves the keys
that only one text holds. Peeling finds them: a cell with a count of 1 or -1 whose key passes its own check shows a key,
which is taken out of its other cells, and so on. Where cells remain, both sketches are made again four times as large.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Cells of each of the three tables at first, and the rounds of peeling.
CELLS, ROUNDS, TABLES = 16, 24, 3
#: Characters of a paragraph at most: by default, and in the query, where a change shall spoil little of a short text.
LONGEST, FINE = 1000, 240
_CHECK_BITS = 24
_CELL = "array<struct<n:bigint,k:bigint>>"


def paragraph_keys(text: Column, longest: int = LONGEST) -> Column:
    """The distinct paragraphs' keys: 40 bits of digest, 24 bits that check them. Null and blank texts have none."""
    digest = lambda p: F.shiftrightunsigned(F.xxhash64(p), _CHECK_BITS)
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{longest}}}"), F.lit(0)), lambda p: _checked(digest(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(7), digest).bitwiseAND((1 << _CHECK_BITS) - 1)


def _checked(digest: Column) -> Column:
    return F.shiftleft(digest, _CHECK_BITS).bitwiseOR(_check(digest))


def _zero(n: int | Column = 1) -> Column:
    return F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("k")), n).cast(_CELL)


def _table(keys: Column, cells: int, table: int) -> Column:
    """One table's cells, from signed keys (structs of a sign n and a key k).

    The cells form blocks of about the square root of their number; keys are dealt to blocks, then a block's keys to
    its cells, so the work grows with keys times that root and no array is copied for a key.
    """
    width = math.isqrt(cells - 1) + 1

    def spot(x: Column) -> Column:
        place = F.pmod(F.xxhash64(F.lit(table * 1_000_003 + cells), x["k"]), F.lit(cells)).cast("int")
        return F.struct(place.alias("p"), F.floor(place / width).cast("int").alias("b"), x["n"].alias("n"), x["k"].alias("k"))

    def cell(spots: Column, p: Column) -> Column:
        put = lambda old, x: F.when(x["p"] == p, F.struct((old["n"] + x["n"]).alias("n"), old["k"].bitwiseXOR(x["k"]).alias("k"))).otherwise(old)
        return F.aggregate(spots, F.element_at(_zero(), 1), put)

    def block(spots: Column, b: Column) -> Column:
        first, size = b * width, F.least(F.lit(width), F.lit(cells) - b * width)
        inside = lambda mine: F.transform(F.sequence(first, first + size - 1), lambda p: cell(mine, p))
        return _let(F.filter(spots, lambda x: x["b"] == b), lambda mine: F.when(F.size(mine) == 0, _zero(size)).otherwise(inside(mine)))

    blocks = F.sequence(F.lit(0), F.lit((cells - 1) // width))
    return _let(F.transform(keys, spot), lambda spots: F.flatten(F.transform(blocks, lambda b: block(spots, b))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: an array of one element is the lambda language's let."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _signed(keys: Column, cells: int) -> Column:
    """The sketch of signed keys, table by table."""
    return F.concat(*[_table(keys, cells, t) for t in range(TABLES)])


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """The sketch of a set of keys: an array of (n, k), table by table."""
    return _let(F.transform(keys, lambda k: F.struct(F.lit(1).cast("bigint").alias("n"), k.alias("k"))), lambda signed: _signed(signed, cells))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def as_text(cells: Column) -> Column:
    """A sketch as a string: each cell's count, and its key in hex."""
    return F.array_join(F.transform(cells, lambda x: F.concat(x["n"].cast("string"), F.lit(":"), F.lower(F.hex(x["k"])))), ",")


def peel(difference: Column, cells: int, rounds: int = ROUNDS) -> Column:
    """Struct of ``found`` (signed keys: n 1 of the first text, -1 of the second) and ``left`` (cells that remain)."""
    start = F.struct(difference.cast(_CELL).alias("left"), F.array().cast(_CELL).alias("found"), F.lit(True).alias("going"))

    def pure(x: Column) -> Column:
        return F.when((x["n"] == 1) | (x["n"] == -1), x["k"] == _checked(F.shiftrightunsigned(x["k"], _CHECK_BITS))).otherwise(F.lit(False))

    def turn(s: Column, shown: Column) -> Column:
        return F.struct(subtract(s["left"], _signed(shown, cells)).alias("left"), F.concat(s["found"], shown).alias("found"), F.lit(True).alias("going"))

    def end(s: Column) -> Column:
        return F.struct(s["left"].alias("left"), s["found"].alias("found"), F.lit(False).alias("going"))

    def step(s: Column, _: Column) -> Column:
        shown = F.array_distinct(F.filter(s["left"], pure))
        return F.when(s["going"], _let(shown, lambda x: F.when(F.size(x) > 0, turn(s, x)).otherwise(end(s)))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def compare(pairs: DataFrame, a: str, b: str, first: int = CELLS, sketches: tuple[str, str] | None = None) -> DataFrame:
    """``pairs`` (with ``a`` and ``b``, arrays of paragraph keys) with only_a, only_b (the keys that one of them lacks)
    and likeness (double): the share of all their distinct keys that both hold, 1 where neither has any.

    Everything comes from peeled differences of sketches; pairs whose peeling gets stuck are tried again with sketches
    four times as large. ``sketches`` names columns with the first sketches of both, where they are at hand already.
    A null array counts as empty; repeated rows stay; names that clash give way.
    """
    new = ("only_a", "only_b", "likeness")
    kept = [c for c in pairs.columns if c not in new and c not in (sketches or ())]
    keys_a, keys_b = (F.coalesce(F.col(c), F.array().cast("array<bigint>")) for c in (a, b))
    open_, cells, done = pairs.select(*kept, *(sketches or ())), first, []
    while True:
        of_a, of_b = (F.col(c) for c in sketches) if sketches and cells == first else (sketch(keys_a, cells), sketch(keys_b, cells))
        peeled = open_.withColumn("__peeled", peel(subtract(of_a, of_b), cells)).drop(*(sketches or ()))
        for name, sign in (("only_a", 1), ("only_b", -1)):
            peeled = peeled.withColumn(name, F.transform(F.filter("__peeled.found", lambda x: x["n"] == sign), lambda x: x["k"]))  # noqa: B023
        common, union = F.size(keys_a) - F.size("only_a"), F.size(keys_b) + F.size("only_a")
        solved = F.forall("__peeled.left", lambda x: (x["n"] == 0) & (x["k"] == 0)) & (common == F.size(keys_b) - F.size("only_b"))
        tried = written(peeled.withColumns({"__solved": solved, "likeness": F.when(union == 0, 1.0).otherwise(common / F.greatest(union, F.lit(1)))}).drop("__peeled"), "peeled")
        done.append(tried.where("__solved").drop("__solved"))
        open_ = tried.where("not __solved").select(*kept)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        cells *= 4


def with_next(ids: DataFrame, id_col: str) -> DataFrame:
    """``ids`` with next_id: the next greater id, after the last the first. Ids are unique and not null.

    Ids are dealt by ranges; only one row a range meets in a global window.
    """
    parts = partitions(ids.sparkSession)
    ranged = written(ids.repartitionByRange(parts, id_col).withColumn("__range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("__range").agg(F.min(id_col).alias("__first"))
    following = firsts.select("__range", F.coalesce(F.lead("__first").over(Window.orderBy("__range")), F.min("__first").over(Window.partitionBy())).alias("__following"))
    inside = F.lead(id_col).over(Window.partitionBy("__range").orderBy(id_col))
    return ranged.withColumn("__inside", inside).join(F.broadcast(following), "__range").withColumn("next_id", F.coalesce("__inside", "__following")).drop("__range", "__inside", "__following")


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """Each document beside an edited version of it: id_col, n_chars, next_id, edited, keys, edited_keys, next_keys.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by id; after the last comes the first. Null texts are empty. Rows with a null id are left out; ids are
    taken to be unique (rows that share one are each paired with each row of the next id).
    """
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where(F.col(id_col).isNotNull())
    links = with_next(texts.groupBy(id_col).agg(F.max(F.length("text")).alias("n_chars")), id_col)
    before = links.select(F.col("next_id").alias(id_col), F.col(id_col).alias("previous"), F.floor(F.col("n_chars") / 2).cast("int").alias("wanted"))
    heads = texts.join(before, id_col).select(F.col("previous").alias(id_col), F.expr("substring(text, 1, wanted)").alias("head"), paragraph_keys(F.col("text"), longest).alias("next_keys"), F.col(id_col).alias("next_id"))
    half = F.floor(F.length("text") / 2).cast("int")
    both = texts.join(heads, id_col)
    both = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.col("head")))
    return both.select(id_col, "n_chars", "next_id", "edited", paragraph_keys(F.col("text"), longest).alias("keys"), paragraph_keys(F.col("edited"), longest).alias("edited_keys"), "next_keys")
