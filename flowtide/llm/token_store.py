"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal passages give equal chunks wherever they
stand. A chunk's bytes are stored once, in the pack row of the document that owns it (the smallest id, then the first
place); every document has a recipe of chunk digests. Roots of Merkle trees over the digests, for each document and for
each range of documents, verify what is read back.

The store is a folder of three tables. ``documents`` holds recipes and owned bytes in files of ascending document id,
about equally many ids in each; ``refs`` names the chunks that documents borrow; ``manifest`` holds the Merkle root of
each file, written with it and checked before anything is read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, discard, partitions, running_totals, scratch_path, settings, slices, write, written
from .encoders import encoder

END_ID = 2
#: Ids that the rolling hash sees; chunks end where one hash in MEAN says so, but hold LEAST to MOST ids.
WINDOW, MEAN, LEAST, MOST = 4, 192, 48, 2048
_DIGEST = 16
#: Texts of about so many bytes are encoded together.
ENCODED_BYTES = 4 << 20
#: Ids of a file at most, but for the last document's.
FILE_IDS = 1 << 24


def _hits(ids: np.ndarray) -> np.ndarray:
    """Where windows end whose rolling hash says so, in ascending order."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    wide = ids.astype(np.uint32)
    rolled = wide[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        rolled *= np.uint32(0x01000193)
        rolled += wide[k : n - WINDOW + 1 + k]
    # The top bits of a last product decide, as the low ones see the last id alone.
    return np.flatnonzero((rolled * np.uint32(0x9E3779B1)) < np.uint32((1 << 32) // MEAN)) + WINDOW


def _ends(hits: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids from the ends of the windows hit."""
    if n <= LEAST:
        return [n] if n else []
    ends, last = [], 0
    for end in hits:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST and end < n:
            last = end
            ends.append(end)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content alone."""
    return _ends(_hits(ids).tolist(), len(ids))


def _cuts_of(streams: list[np.ndarray]) -> list[list[int]]:
    """``cuts`` of each stream; all are hashed at once."""
    if not streams:
        return []
    at = np.cumsum([0, *map(len, streams)])
    hits = _hits(np.concatenate(streams))
    # Windows that lie within the stream.
    first, last = np.searchsorted(hits, at[:-1] + WINDOW), np.searchsorted(hits, at[1:], side="right")
    return [_ends((hits[a:b] - start).tolist(), len(ids)) for a, b, start, ids in zip(first, last, at, streams)]


def merkle_root(digests: list[bytes]) -> bytes:
    """The root of the binary tree over the digests; an odd one goes up as it is, no digests give the hash of nothing."""
    level = digests or [blake2b(b"", digest_size=_DIGEST).digest()]
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=_DIGEST).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _digests(ids: bytes, sizes: list[int]) -> list[bytes]:
    """Digests of chunks of so many ids each; ``ids`` are little-endian unsigned 32-bit integers."""
    view, out, at = memoryview(ids), [], 0
    for size in sizes:
        out.append(blake2b(view[at : at + 4 * size], digest_size=_DIGEST).digest())
        at += 4 * size
    return out


def _file_roots(docs: DataFrame) -> DataFrame:
    """file, first_id, n_docs, itemsize, root of each file's documents; a file holds at most FILE_IDS ids or one document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def root(key, rows):
        ordered = rows.sort_by("doc_id")
        return pa.table({"file": [key[0].as_py()], "first_id": ordered.column("doc_id")[:1], "n_docs": [len(rows)], "itemsize": ordered.column("itemsize")[:1], "root": [merkle_root(ordered.column("root").to_pylist())]})

    return docs.select("file", "doc_id", "itemsize", "root").groupBy("file").applyInArrow(root, f"file long, first_id {kind}, n_docs long, itemsize int, root binary")


@dataclass
class TokenStore:
    """A store in the folder ``path``, which is all that a later session needs to open it."""

    spark: SparkSession
    path: str

    def _documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def recipes(self) -> DataFrame:
        """doc_id, start, n_tokens, root, digests, sizes in files of ascending doc_id."""
        return self._documents().select("doc_id", "start", "n_tokens", "root", "digests", "sizes")

    def manifest(self) -> DataFrame:
        """The stored Merkle root of each file's documents: file, first_id, n_docs, itemsize (bytes of an id), root."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def verify(self) -> None:
        """Raises ValueError where the documents' roots don't add up to the stored manifest, or files are missing or new."""
        found = _file_roots(self._documents())
        same = F.col("a.root").eqNullSafe(F.col("b.root")) & F.col("a.n_docs").eqNullSafe(F.col("b.n_docs"))
        if not self.manifest().alias("a").join(found.alias("b"), F.col("a.file") == F.col("b.file"), "full").where(~same).isEmpty():
            raise ValueError("the documents do not match the store's manifest")

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens (with the end id) and ids (binary, little-endian unsigned 32-bit), put together from
        recipes and chunks. The manifest is checked at once; a chunk or root that doesn't match its digest fails the job."""
        self.verify()
        stored = self._documents()

        def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests, chunks = [], []
                for row in batch.to_pylist():
                    at = 0
                    for digest, size, owned, lends in zip(row["digests"], row["sizes"], row["owned"], row["lends"], strict=True):
                        size *= row["itemsize"]
                        if lends:
                            digests.append(digest)
                            chunks.append(row["own"][at : at + size])
                        at += size * owned
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])

        lending = stored.where(F.exists("lends", lambda x: x)).select("digests", "sizes", "owned", "lends", "own", "itemsize").mapInArrow(lent, "digest binary, chunk binary")
        borrowed = self.spark.read.parquet(f"{self.path}/refs").where("not owner").join(lending, "digest").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "chunk")).alias("borrowed"))

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "own"):
                    ids = []
                    for row in part.select(["digests", "sizes", "owned", "own", "borrowed", "root", "itemsize"]).to_pylist():
                        other = {b["pos"]: b["chunk"] for b in row["borrowed"] or ()}
                        chunks, at = [], 0
                        for pos, (size, owned) in enumerate(zip(row["sizes"], row["owned"], strict=True)):
                            size *= row["itemsize"]
                            chunks.append(row["own"][at : at + size] if owned else other[pos])
                            at += size * owned
                            if len(chunks[-1]) != size:
                                raise ValueError("a stored chunk is not as long as its recipe says")
                        ids.append(np.frombuffer(b"".join(chunks), f"<u{row['itemsize']}").astype("<u4").tobytes())
                        digests = _digests(ids[-1], row["sizes"])
                        if digests != row["digests"] or merkle_root(digests) != row["root"]:
                            raise ValueError("a stored chunk does not match its digest")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        # Only documents that borrow are shuffled.
        alone = F.forall("owned", lambda x: x)
        whole = stored.where(alone).withColumn("borrowed", F.lit(None).cast(borrowed.schema["borrowed"].dataType)).unionByName(stored.where(~alone).join(borrowed, "doc_id", "left"))
        id_type = stored.schema["doc_id"].dataType.simpleString()
        return whole.select("doc_id", "start", "n_tokens", "digests", "sizes", "owned", "own", "borrowed", "root", "itemsize").mapInArrow(together, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def _bucketed(df: DataFrame, name: str, parts: int) -> str:
    """Writes ``df`` as a table bucketed by doc_id in the shared folder; its name."""
    spark = df.sparkSession
    table = f"flowtide_{name}_{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"}):
        df.write.bucketBy(parts, "doc_id").sortBy("doc_id").option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return table


def write_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, literal: bool = True, path: str | None = None) -> TokenStore:
    """Encodes every whole text with the tokenizer file, ``end_id`` behind each, and stores the ids in the folder ``path``
    (by default a new one in the shared folder).

    Null and empty texts are ``end_id`` alone; ``literal`` as in Encoder. A document is an id: of rows that share one, the greatest text is stored;
    rows with a null id are not. Other columns play no part. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    path = path or scratch_path(spark, "store")
    kind = "<u2" if encoder(tokenizer, literal).size <= 1 << 16 and end_id < 1 << 16 else "<u4"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer, literal), None
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                out: list[list] = [[], [], [], [], []]
                docs, texts = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if doc == last:
                        continue
                    last = doc
                    docs.append(doc)
                    texts.append(text)
                streams = enc.arrays(texts, end_id, kind)
                for doc, ids, ends in zip(docs, streams, _cuts_of(streams), strict=True):
                    sizes = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    digests = _digests(ids.astype("<u4").tobytes(), sizes)
                    for column, value in zip(out, (doc, ids.tobytes(), digests, sizes, merkle_root(digests)), strict=True):
                        column.append(value)
                types = [part.column(0).type, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "ids", "digests", "sizes", "root"])

    dealt = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", F.desc("text"))
    encoded_table = _bucketed(dealt.mapInArrow(encode, f"doc_id {id_type}, ids binary, digests array<binary>, sizes array<int>, root binary"), "encoded", parts)
    encoded = spark.table(encoded_table)

    # The place of each chunk that stands in more than one; the first place owns it, the others refer to it.
    places = encoded.select("doc_id", F.posexplode("digests").alias("pos", "digest"))
    shared = places.groupBy("digest").agg(F.min(F.struct("doc_id", "pos")).alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    refs_path = f"{path}/refs"
    write(places.join(shared, "digest").select("doc_id", "pos", "digest", (F.struct("doc_id", "pos") == F.col("owner")).alias("owner")), refs_path)
    refs = spark.read.parquet(refs_path)
    marks = refs.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("owner"), F.col("pos"))).alias("gone"), F.collect_list(F.when(F.col("owner"), F.col("pos"))).alias("lent"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for batch in batches:
            own, owned, lends = [], [], []
            for row in batch.select(["ids", "sizes", "gone", "lent"]).to_pylist():
                gone, lent, at = set(row["gone"] or ()), set(row["lent"] or ()), 0
                owned.append([k not in gone for k in range(len(row["sizes"]))])
                lends.append([k in lent for k in range(len(row["sizes"]))])
                kept = []
                for size, mine in zip(row["sizes"], owned[-1], strict=True):
                    if mine:
                        kept.append(row["ids"][at : at + size * width])
                    at += size * width
                own.append(b"".join(kept))
            flags = pa.list_(pa.bool_())
            passed = [batch.column(c) for c in ("doc_id", "file", "start", "n_tokens", "root", "digests", "sizes")]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(owned, flags), pa.array(lends, flags), pa.array(own, pa.binary())], ["doc_id", "file", "start", "n_tokens", "root", "digests", "sizes", "owned", "lends", "own"])

    n_tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    headed = encoded.select("doc_id", n_tokens.alias("n_tokens"), "root")
    started = written(running_totals(headed, "doc_id", "n_tokens", "start"), "started")
    total = started.agg(F.coalesce(F.max(F.col("start") + F.col("n_tokens")), F.lit(0))).first()[0]
    file_ids = min(FILE_IDS, max(1, -(-total // parts)))
    placed = started.withColumn("file", F.floor(F.col("start") / F.lit(file_ids)).cast("long"))
    split_up = (
        encoded.drop("root").join(marks, "doc_id", "left")
        .join(placed, "doc_id")
        .select("doc_id", "file", "start", "n_tokens", "root", "ids", "digests", "sizes", "gone", "lent")
        .mapInArrow(split, f"doc_id {id_type}, file long, start long, n_tokens long, root binary, digests array<binary>, sizes array<int>, owned array<boolean>, lends array<boolean>, own binary")
        .withColumn("itemsize", F.lit(np.dtype(kind).itemsize))
    )
    # A file's number is its partition's, so files ascend by document as they are written.
    write(split_up.repartitionById(max(1, -(-total // file_ids)), F.col("file").cast("int")).sortWithinPartitions("doc_id"), f"{path}/documents")
    store = TokenStore(spark, path)
    write(_file_roots(store._documents()), f"{path}/manifest")
    discard(encoded)
    spark.sql(f"DROP TABLE {encoded_table}")
    return store
