"""Token counts kept up to date from signed changes instead of recounting.

A batch of changes is turned into signed contributions (an insert adds a document's count, a delete takes it away, a
revision does both) and added up by source, language and tokenizer version; only these sums are committed, under the
batch's name. Totals are sums over the committed batches, so a batch committed again replaces itself and counts once.

Each commit of a batch is a version of its own, beside the earlier ones. A version counts from the moment when the file
writer marks it complete, and only then do older ones go: a commit that dies half-way leaves the last complete version.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns
from .encoders import encoder

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text", keep: list[str] | None = None, literal: bool = True) -> DataFrame:
    """``docs`` once for each tokenizer version (name to file), with tokenizer (string) and n_tokens (long).

    Null and empty texts count 0. Each text is read once and encoded whole by every version;
    ``literal`` as in Encoder. Repeated rows and rows with a null id are counted each; an empty table gives no rows.
    """
    names = list(tokenizers)

    def compute(column: pa.Array) -> list:
        texts = [t or "" for t in column.to_pylist()]
        return [[[len(encoder(path, literal).encode(t)) for path in tokenizers.values()] for t in texts]]

    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("tokenizer", "n_tokens")]
    counted = add_columns(docs.select("*"), text_col, compute, "counts array<long>", kept)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("tokenizer"), F.col("counts").alias("n_tokens"))
    return counted.select(*kept, F.inline(named).alias("tokenizer", "n_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Contributions of changes.

    ``changes`` has kind ('insert', 'delete' or 'revise'), source, lang, tokenizer, n_tokens and old_tokens (the count
    so far: of a delete, and of a revision). Rows of another kind contribute nothing; a null count is 0.
    """
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("kind")
    return changes.select(
        *KEYS,
        F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0).cast("long").alias("n_docs"),
        F.when(kind == "insert", new).when(kind == "delete", -old).when(kind == "revise", new - old).otherwise(0).cast("long").alias("n_tokens"),
    )


@dataclass
class Rollup:
    """Totals at ``path`` (a folder that all executors share), a small table for each version of a committed batch."""

    spark: SparkSession
    path: str

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Adds a batch. Committing a name again puts the new sums in the place of the old, so retries do no harm.

        Until the new sums are complete, totals() reads the old ones. The version before the last stays for readers that
        have begun; earlier ones and remains of commits that died before it are deleted. Of two commits of a name at the
        same time, one counts. A batch without changes, or of unknown kinds alone, commits nothing but itself. Repeated
        rows are changes each. Batch names are letters, digits, _ and -.
        """
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        sums = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        found = self._versions(batch)
        number = max((self._number(v) for v, _ in found), default=0) + 1
        sums.write.parquet(f"{self.path}/batch={batch}/version-{number:09d}-{uuid.uuid4().hex}")
        complete = [self._number(v) for v, done in found if done]
        for version, _ in found:
            if complete and self._number(version) < max(complete):
                self._files().delete(self._at(f"{self.path}/batch={batch}/{version}"), True)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    @staticmethod
    def _number(version: str) -> int:
        return int(version.split("-")[1])

    def _versions(self, batch: str) -> list[tuple[str, bool]]:
        """Versions of a batch in order, and whether each is complete."""
        folder, files = self._at(f"{self.path}/batch={batch}"), self._files()
        names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
        return [(n, files.exists(self._at(f"{folder}/{n}/_SUCCESS"))) for n in names if n.startswith("version-")]

    def _current(self) -> dict[str, str]:
        """The last complete version of each batch."""
        folder, files = self._at(self.path), self._files()
        names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
        found = {n.removeprefix("batch="): [v for v, done in self._versions(n.removeprefix("batch=")) if done] for n in names if n.startswith("batch=")}
        return {b: versions[-1] for b, versions in found.items() if versions}

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        return sorted(self._current())

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups with no documents left are gone.

        Null sources and languages form groups of their own. Without batches the result is empty.
        """
        paths = [f"{self.path}/batch={b}/{version}" for b, version in self._current().items()]
        if not paths:
            return self.spark.createDataFrame([], _TOTALS)
        read = self.spark.read.schema(_TOTALS).parquet(*paths)
        total = read.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n_docs <> 0 or n_tokens <> 0")
