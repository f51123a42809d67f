"""Token counts by source, language and tokenizer version, kept by signed changes.

A change is a row with signs: an insert adds one document and its tokens, a delete takes both off, a revised count takes
the old tokens off and adds the new ones. A batch of changes is added up by group and committed under its name, a folder
of its own; a batch counts once its folder is complete. Committing a name again changes nothing, so a job that was
repeated after a loss does no harm, and batches that arrive in another order give the same totals, as sums do. A commit
costs what its batch costs, whatever was committed before; `folded` writes the totals as one batch in place of
many, and keeps their names so that a late repetition of one of them is still known.

The key of a group has few values, but one may hold a third of all rows: sums are combined before the shuffle.

Defined results: a null text has no tokens; null sources, languages and tokenizers are groups of their own; repeated
rows count each; a group whose documents and tokens are both back at zero is left out of the totals; an empty batch is
committed and adds nothing; columns besides those named are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from murmur.llm.tokens import VOCABULARY, encoder

KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
_DONE = "_SUCCESS"


@F.pandas_udf(LongType())
def _bpe_tokens(texts: pd.Series) -> pd.Series:
    of = encoder(VOCABULARY).ids
    return pd.Series([len(of(t)) for t in texts], dtype="int64")


def bpe_tokens(text: Column) -> Column:
    """How many ids the text has in the byte-level vocabulary; 0 for a null."""
    return _bpe_tokens(text)


def inserted(rows: DataFrame) -> DataFrame:
    """Changes from rows (source, lang, tokenizer, tokens) of new documents."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long"))


def deleted(rows: DataFrame) -> DataFrame:
    """Changes from rows of documents that go, with the tokens they were counted with."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Changes from rows (source, lang, tokenizer, old_tokens, tokens) of documents that are counted anew."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"),
                       (F.col("tokens") - F.col("old_tokens")).cast("long").alias("tokens"))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


class Rollup:
    """The totals below one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def _names(self, path: str) -> set[str]:
        if not self._there(path):
            return set()
        return {str(s.getPath().getName()) for s in self._files.listStatus(self._path(path))}

    def batches(self) -> list[str]:
        """The folders of complete batches that count: those that no fold has replaced."""
        found = {n for n in self._names(self.folder) if n.startswith("batch-") and self._there(
            f"{self.folder}/{n}/{_DONE}")}
        return sorted(found - {n for f in found for n in self._replaced(f)})

    def _replaced(self, name: str) -> set[str]:
        return self._names(f"{self.folder}/{name}.replaces")

    def known(self, batch: str) -> bool:
        """The batch is committed, by itself or within a fold."""
        name = f"batch-{batch}"
        return self._there(f"{self.folder}/{name}/{_DONE}") or any(name in self._replaced(n) for n in self.batches())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (source, lang, tokenizer, docs, tokens); False if it is known already. What an
        interrupted commit has left is written over."""
        if self.known(batch):
            return False
        _summed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all batches."""
        paths = [f"{self.folder}/{n}" for n in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return _summed(self.spark.read.schema(SCHEMA).parquet(*paths)).filter("docs <> 0 OR tokens <> 0")

    def folded(self, batch: str) -> bool:
        """Writes the totals as one batch that replaces all that count now. The names of the replaced ones are
        written first; they hold from the moment the new batch is complete."""
        old = self.batches()
        if self.known(batch):
            return False
        gone = {n for name in old for n in self._replaced(name)} | set(old)
        for name in sorted(gone):
            self._files.mkdirs(self._path(f"{self.folder}/batch-{batch}.replaces/{name}"))
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True
