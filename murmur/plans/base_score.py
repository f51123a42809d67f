"""A trained base score for texts: multinomial naive Bayes over their words, learned from a labelled table.

Every word has its own weight; nothing is hashed together. The model is a table (word, weight) of logarithms, of any
size, and one number for texts without known words. Words of a text are counted and weighed where the text is read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.words import counted, words_of
from murmur.streaming.folders import shared_folder, stored

SMOOTHING = 1.0


class Model(NamedTuple):
    weights: DataFrame  # word, weight: log of its chance among texts of label 1 over that among label 0
    prior: float        # log of the share of label 1 over that of label 0


def fit(labelled: DataFrame, text: str = "content", label: str = "quality", smoothing: float = SMOOTHING) -> Model:
    """Learns from rows with label 0 or 1; rows without a label are left out. Both labels must occur. The driver sees
    one row of totals."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(words_of(F.col(text)).alias("_words"), F.col(label).alias("_y"))
    counts = (rows.select("_y", F.explode("_words").alias("word")).groupBy("word")
              .agg(F.count_if(F.col("_y") == 1).alias("good"), F.count_if(F.col("_y") == 0).alias("bad")))
    counts = stored(counts, "words")  # read twice below
    sums = counts.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
                      F.count(F.lit(1)).alias("words")).first()
    texts = rows.agg(F.count_if(F.col("_y") == 1).alias("good"), F.count_if(F.col("_y") == 0).alias("bad"))
    share = texts.select((F.log(F.col("good").cast("double")) - F.log(F.col("bad").cast("double"))).alias("p")).first()["p"]
    if share is None:
        raise ValueError("both labels are needed")

    def chance(n: str):
        return F.log((F.col(n).cast("double") + smoothing) / F.lit(float(sums[n]) + smoothing * sums["words"]))

    return Model(counts.select("word", (chance("good") - chance("bad")).alias("weight")), share)


def with_base(df: DataFrame, model: Model, text: str = "content", out: str = "base_score", digits: int = 6) -> DataFrame:
    """Adds the probability of label 1; words the model has not seen count for neither side. Sums are decimals, so the
    order of the words does not matter. No text and no word is sent: the weights are stored once, sorted by a 64-bit hash of
    their words, and each text looks its words up where it is read."""
    weigh = lookup(stored_weights(model.weights))
    counts = df.select(*df.columns, F.explode(F.array(counted(words_of(F.col(text))))).alias("_words"))
    hashes = F.transform("_words", lambda w: F.xxhash64(w["word"]))
    part = F.aggregate(
        F.zip_with("_words", "_weights", lambda w, x: (w["n"] * x).cast("decimal(38,12)")), F.lit(0).cast("decimal(38,12)"),
        lambda a, x: (a + F.coalesce(x, F.lit(0).cast("decimal(38,12)"))).cast("decimal(38,12)"))
    odds = part.cast("double") + F.lit(model.prior)
    return (counts.withColumn("_weights", weigh(hashes))
            .withColumn(out, F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), digits)).drop("_words", "_weights"))


def stored_weights(weights: DataFrame) -> str:
    """Writes (hash, weight) in ranges of the hash, each range a file sorted by it; returns the folder."""
    folder = shared_folder(weights.sparkSession, "weights")
    ranges = weights.select(F.xxhash64("word").alias("hash"), "weight").repartitionByRange("hash").sortWithinPartitions("hash")
    ranges.write.option("compression", "zstd").parquet(folder)
    return folder


def lookup(folder: str):
    """A function from an array of hashes to the array of their weights, null where a word is not known. A task reads the
    weights once: 16 bytes a word, however long the words are."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stored_arrays() -> tuple[np.ndarray, np.ndarray]:
        files, path = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        table = ds.dataset(path, filesystem=files, format="parquet").to_table(columns=["hash", "weight"])
        hashes, weights = table["hash"].to_numpy(), table["weight"].to_numpy()
        if np.any(hashes[1:] < hashes[:-1]):  # files in another order than their ranges
            order = np.argsort(hashes, kind="stable")
            hashes, weights = hashes[order], weights[order]
        return hashes, weights

    @F.arrow_udf("array<double>")
    def weigh(found: pa.Array) -> pa.Array:
        if not held:
            held.append(stored_arrays())
        hashes, weights = held[0]
        wanted = found.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
        known = hashes[at] == wanted if len(hashes) else np.zeros(len(wanted), bool)
        values = weights[at] if len(hashes) else np.zeros(len(wanted))
        lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(values, pa.float64(), mask=~known))

    return weigh
