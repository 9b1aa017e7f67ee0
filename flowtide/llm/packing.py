"""Packing of token ids into sequences of fixed length, first-fit decreasing in randomised groups of documents.

Each group is one task's work and holds about ``group_docs`` documents and ``group_bytes`` of text, whatever their ids
or sources: the group comes from a hash, and the number of groups from the documents alone. Within it, documents are cut at multiples of the sequence length; whole cuts fill sequences of their own,
and what is left of each document goes, largest first, to the first bin with room, found in a tournament tree.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import encoder

LENGTH, END_ID = 1024, 0
#: Documents and bytes of text of a group, about.
GROUP_DOCS, GROUP_BYTES = 4000, 16 << 20


class Tournament:
    """Bins of equal capacity; the winner of each match is the larger free space, so the first bin with room is found top down."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts ``size`` into the first bin with room: (bin, space that was free there)."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bin_, had = at - self.leaves, free[at]
        free[at] = had - size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return bin_, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; equal sizes keep their order. Sizes are at most the capacity."""
    tree, out = Tournament(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_, had = tree.place(sizes[i])
        out[i] = (bin_, capacity - had)
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES, salt: int = 0, literal: bool = True) -> DataFrame:
    """Pieces of all documents, laid into sequences: ``id_col``, start, length, doc_tokens, sequence_id, offset (long)
    and ids (binary, little-endian unsigned 32-bit).

    A document is its ids by the tokenizer file plus ``end_id``; null and empty texts are ``end_id`` alone; ``literal``
    as in Encoder. Each id lies in exactly one piece. Repeated rows and rows with a null id are packed each on its own; other columns of ``docs``
    play no part. Ties go to the smaller id, then the smaller text; an empty table gives no pieces.
    """
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()
    groups = max(1, math.ceil(n / group_docs), math.ceil((size or 0) / group_bytes))
    dealt = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("group", F.pmod(F.xxhash64(F.lit(salt), "id", "text"), F.lit(groups)))
    id_type = dealt.schema["id"].dataType

    def run(table: pa.Table) -> pa.Table:
        encode = encoder(tokenizer, literal)
        base = table.column("group")[0].as_py() << 31
        rows = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or ""))
        out: list[list] = [[], [], [], [], [], [], []]
        rest: list[tuple] = []
        used = 0
        for doc, text in rows:
            ids = encode.ids(text or "", end_id)
            n = len(ids) // 4
            whole = n // length
            for k in range(whole):
                for column, value in zip(out, (doc, k * length, length, n, base + used + k, 0, ids[4 * k * length : 4 * (k + 1) * length]), strict=True):
                    column.append(value)
            used += whole
            if n % length:
                rest.append((doc, whole * length, n % length, n, ids[4 * whole * length :]))
        for (doc, start, size, n, ids), (bin_, offset) in zip(rest, first_fit_decreasing([r[2] for r in rest], length), strict=True):
            for column, value in zip(out, (doc, start, size, n, base + used + bin_, offset, ids), strict=True):
                column.append(value)
        types = [table.schema.field("id").type, *[pa.int64()] * 5, pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = f"id {id_type.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.groupBy("group").applyInArrow(run, schema).withColumnRenamed("id", id_col)


