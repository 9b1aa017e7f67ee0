"""What the operators of this subpackage share: scratch tables, batches of texts, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are worked on in slices of about so many bytes, however many rows Arrow puts in a batch.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that Spark sends to Python, about; by Spark's default only rows count, 10,000 of them.
BATCH_BYTES = 4 << 20

_own_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (one machine) gets a temporary folder and a cluster one under the warehouse.
    """
    global _own_scratch
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if _own_scratch is None:
        _own_scratch = tempfile.mkdtemp(prefix="flowtide-")
    return _own_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/flowtide/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Writes ``df`` with zstd, and lets go of the shuffle files of that job, which the table replaces."""
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that written() gave and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's switch to remove a query's shuffle files at its end; older versions ignore it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with ``values`` set for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def bounded_batches(spark: SparkSession) -> None:
    """Batches of about BATCH_BYTES from now on, unless the session has a bound of its own. Plans are made when a result is
    asked for, so a setting for a while would be over by then; older versions ignore it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts add up to ``size`` bytes; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    offsets = binary_offsets(column)
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def binary_offsets(column: pa.Array) -> np.ndarray:
    """Where each text begins in the column's bytes, with the end as the last entry."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffer = column.buffers()[1]
    if buffer is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of each text in them; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = binary_offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multipliers of the words of a shingle, by position: golden-ratio steps.
def shingle_weights(words: int) -> np.ndarray:
    return mix64(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(hashes: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit hash of every run of ``words`` word hashes."""
    n = len(hashes) - words + 1
    total = np.zeros(n, np.uint64)
    for k, weight in enumerate(shingle_weights(words)):
        total += mix64(hashes[k : k + n] * weight) if k == 0 else hashes[k : k + n] * weight
    return mix64(total)


def counts_between(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds between each two offsets."""
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def packed_row(columns: list[str]) -> Column:
    """The columns as one struct, ``row``, whose fields have names by place, so that no column's name can clash."""
    return F.struct(F.lit(True).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)]


def add_columns(docs: DataFrame, text_col: str, compute: Callable[[pa.Array], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``fields`` (DDL), which ``compute`` makes from the texts of a slice.

    ``keep`` names the columns that pass (all by default); a column named like a new one gives way to it. A text that
    passes goes to Python once, beside the other columns.
    """
    bounded_batches(docs.sparkSession)
    new = T._parse_datatype_string(fields)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    carried = text_col in kept and docs.schema[text_col].dataType == T.StringType()
    others = [c for c in kept if not (carried and c == text_col)]
    packed = docs.select(packed_row(others), F.col(f"`{text_col}`").cast("string").alias("text"))
    passed = ["row", "carried"] if carried else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                arrays = [a if isinstance(a, pa.Array) else pa.array(a) for a in compute(part.column(1))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(passed)], *arrays], [*passed, *new.names])
        # Workers live on between tasks; what Arrow holds back for later would stay with them.
        pa.default_memory_pool().release_unused()

    schema = T.StructType([packed.schema["row"], *[T.StructField(c, T.StringType()) for c in passed[1:]], *new.fields])
    done = packed.mapInArrow(run, schema)
    found = dict(zip(others, unpacked(others), strict=True))
    return done.select(*[found[c] if c in found else F.col("carried").alias(c) for c in kept], *[F.col(c) for c in new.names])


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of_step(n: int) -> list[np.ndarray]:
    """The powers of _STEP and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        # A slice's bytes at once; beyond that a quarter more, so that ever longer texts don't mean ever new powers.
        size = SLICE_BYTES + 1 if n <= SLICE_BYTES + 1 else n + n // 4
        for k, base in enumerate((int(_STEP), pow(int(_STEP), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Spans:
    """64-bit hashes of any spans of some bytes, each in constant time after one pass."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers_of_step(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mix64(np.arange(1, 257, dtype=np.uint64))[raw] * up[: len(raw)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal spans; starts and ends are places in the bytes."""
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def runs_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs where ``mask`` holds; a run ends where a text does."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner], after[inner - 1] = False, False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and where each text's words begin among them."""
    starts, ends = runs_of(~SPACES[raw], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def running_totals(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows of a smaller ``key`` (ties by ``value``), without one global window.

    Rows are dealt by ranges of the key; each range's total and its place among the ranges come from a table of one
    row a range, and only rows of one range meet in a window.
    """
    parts = partitions(df.sparkSession)
    ranged = written(df.repartitionByRange(parts, key).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__total"))
    before = totals.select("__range", (F.sum("__total").over(Window.orderBy("__range")) - F.col("__total")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(key, value).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(F.broadcast(before), "__range").withColumn(out, (F.col("__before") + F.col("__inside")).cast("long")).drop("__range", "__before", "__inside")
