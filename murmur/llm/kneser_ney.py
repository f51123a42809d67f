"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark and read by workers through memory maps.

    p(w | u) = max(c(uw) - D(c(uw)), 0) / c(u) + g(u) p(w)
    p(w)     = max(l(w) - d(l(w)), 0) / l + g / (V + 1)

c(uw) counts the pair, c(u) the pairs that begin with u, l(w) the different words in front of w, l all different pairs;
D and d take off one of three discounts, by the counts of counts; g gives what they take to the lower order, at last to
V + 1 words, the unknown one among them. A text begins after a mark that is no token, and its end is a token.

Counting. A task gives the words of its texts numbers of its own, sorts pairs of numbers, and sends each different pair
once for a few million tokens, as arrays of 64-bit word hashes. A pair goes to a shard by its first word. Words that
are frequent in a bounded sample of documents are split over many shards by their second word; the sample decides where
counts are added, not what is counted. A shard adds its pairs up and stores them as a sorted array of hashes with
counts; their number grows with the text, so what a task holds does not; what it knows of single words goes to a second set of shards, which stores the word table. The driver gets one
row of totals.

Scoring. A worker maps the arrays of the model and looks up the different pairs of a few million tokens in the order of
their hashes, so it reads each file once from front to back; a model may be larger than memory. The files lie in the
folder of spark.checkpoint.dir; where that is no path of the machine, a worker first fetches a shard through pyarrow.fs.

Defined results: a null text is an empty one, the end alone; a null doc_id counts as empty text, so it is held out;
repeated rows count and are scored each; without training documents every word has the same chance; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.store import new_folder

TOKENS = 2_000_000  # tokens that a task counts at a time
SCORED_TOKENS = 700_000  # tokens that a task scores at a time
SHARD_CHARS = 32_000_000  # characters of text for a shard
HOT_SAMPLE = 2000  # documents
HOT_WORDS = 1000
HOT_SHARE = 0.0005  # of the sample's tokens
SPLIT = 64
ADDED = 0.1  # of the base score
BEGIN, FINISH = b" begin", b" end"  # no word holds a space

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio
_TURN = np.uint64(29)
_BLOB = pa.schema([("shard", pa.int64()), ("blob", pa.binary())])
_TOTALS = ["n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "more", "pairs", "words", "tokens"]


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _MIX
    x ^= x >> _TURN
    x = (x + second) * _MIX
    return x ^ (x >> _TURN)


def shards_of(spark: SparkSession, partitions: int) -> list[int]:
    """A number for each partition that Spark's hash deals there, so every task gets one shard, and a stage sends as many
    blobs as it has tasks and shards."""
    n = 20 * partitions + 200
    while True:
        rows = (spark.range(n).select("id", F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).groupBy("p")
                .agg(F.min("id").alias("id")).collect())
        if len(rows) == partitions:
            return [r["id"] for r in rows]
        n *= 2


def _pair_shard(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: np.ndarray) -> np.ndarray:
    key = first * _MIX
    if len(hot):
        part = (second >> np.uint64(7)) % np.uint64(SPLIT) + np.uint64(1)
        key = key + np.where(np.isin(first, hot), part * _MIX, np.uint64(0))
    return shards[((key ^ (key >> _TURN)) * _MIX >> np.uint64(33)) % np.uint64(len(shards))]


def _word_shard(words: np.ndarray, shards: np.ndarray) -> np.ndarray:
    return shards[(words >> np.uint64(32)) % np.uint64(len(shards))]


class _Numbers(dict):
    """Numbers the words of a task in the order they come: 0 the beginning, 1 the end."""

    def __init__(self):
        super().__init__({BEGIN: 0, FINISH: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(word_hash, self), np.uint64, len(self))

    def of(self, text: str | None) -> np.ndarray:
        """The beginning, the words and the end of a text as numbers."""
        words = (text or "").encode().lower().split()
        ids = np.empty(len(words) + 2, np.uint32)
        ids[0], ids[-1] = 0, 1
        ids[1:-1] = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        return ids


def _paired(parts: list[np.ndarray]) -> np.ndarray:
    """Each number of the texts with the one before it, but not across texts."""
    ids = np.concatenate(parts)
    pairs = ids[:-1].astype(np.uint64)
    pairs <<= np.uint64(32)
    pairs |= ids[1:]
    return pairs[ids[1:] != 0]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys in order and, for each, the sums of its values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _runs(keys)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


# Blobs: the number of entries of each array, then the arrays.

def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], "<u8").tobytes(), *(a.tobytes() for a in arrays)])


def _unblob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, "<u8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _sent(shard: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One blob of all columns for each shard. The last column tells where the rows lie, in the order of shard."""
    *columns, order = columns
    at = _runs(shard)
    ends = np.append(at[1:], len(shard))
    for k in range(0, len(at), 64):
        rows = [(int(shard[a]), _blob(*(c[order[a:b]] for c in columns))) for a, b in zip(at[k:k + 64], ends[k:k + 64])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BLOB)], schema=_BLOB)


def _pairs(hot: np.ndarray, shards: np.ndarray):
    """Texts to blobs of (first word, second word, count) by shard."""
    def task(batches):
        numbers, held, n = _Numbers(), [], 0

        def flush():
            hashes = numbers.hashes()
            numbers.clear()
            pairs = _paired(held)
            held.clear()
            pairs.sort()
            at = _runs(pairs)
            count = np.diff(np.append(at, len(pairs))).astype("<u4")
            pairs = pairs[at]
            first, second = hashes[pairs >> np.uint64(32)], hashes[pairs & np.uint64(0xFFFFFFFF)]
            del pairs, at
            shard = _pair_shard(first, second, hot, shards)
            order = np.argsort(shard, kind="stable").astype(np.uint32)
            yield from _sent(shard[order], first, second, count, order)

        for batch in batches:
            for text in batch.column(0):
                held.append(numbers.of(text.as_py()))
                n += len(held[-1])
                if n >= TOKENS:
                    yield from flush()
                    numbers, n = _Numbers(), 0
        if held:
            yield from flush()
    return task


def _shards_of(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Rows sorted by shard: each shard with all its blobs."""
    at, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if shard != at and blobs:
                yield at, blobs
                blobs = []
            at = shard
            blobs.append(blob.as_py())
    if blobs:
        yield at, blobs


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes one file of the model; a repeated task writes the same again, and the last name is given at once."""
    from pyarrow.fs import FileSystem

    files, path = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    own = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    files.create_dir(path, recursive=True)
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{path}/{name}")


def _added_pairs(folder: str, shards: np.ndarray):
    """Shards of pairs: stores each, and sends on what it knows of words. Counts of counts travel under shard -1."""
    def task(batches):
        for shard, blobs in _shards_of(batches):
            parts = [_unblob(b, "<u8", "<u8", "<u4") for b in blobs]
            first, second, count = (np.concatenate(c) for c in zip(*parts))
            del parts, blobs
            key = _pair_hash(first, second)
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = _runs(key)
            count = np.add.reduceat(count[order].astype(np.uint64), at)
            first, second = first[order][at], second[order][at]
            _put(folder, f"pairs-{shard}", _blob(key[at], np.minimum(count, 0xFFFFFFFF).astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([_blob(np.bincount(
                np.minimum(count, 5).astype(np.int64), minlength=6).astype("<u8"))], pa.binary())], schema=_BLOB)
            u, c, one, two, many = _sums(first, count, *((count == k).astype(np.uint64) for k in (1, 2)),
                                         (count >= 3).astype(np.uint64))
            w, left = _sums(second, np.ones(len(second), np.uint64))
            zero = np.zeros(len(w), np.uint64), np.zeros(len(u), np.uint64)
            words = _sums(np.concatenate([u, w]), *(np.concatenate([a, zero[0]]) for a in (c, one, two, many)),
                          np.concatenate([zero[1], left]))
            to = _word_shard(words[0], shards)
            order = np.argsort(to, kind="stable")
            yield from _sent(to[order], words[0], *(np.asarray(a, "<u8") for a in words[1:]), order)
    return task


def _added_words(folder: str):
    """Shards of the word table: stores each, and gives its totals."""
    begin, finish = np.uint64(word_hash(BEGIN)), np.uint64(word_hash(FINISH))

    def task(batches):
        totals = np.zeros(len(_TOTALS), np.int64)
        for shard, blobs in _shards_of(batches):
            if shard < 0:
                for b in blobs:
                    of, = _unblob(b, "<u8")
                    totals[0:4] += of[1:5].astype(np.int64)
                continue
            parts = [_unblob(b, *["<u8"] * 6) for b in blobs]
            words, c, one, two, many, left = _sums(*(np.concatenate(x) for x in zip(*parts)))
            _put(folder, f"words-{shard}", _blob(words, *(np.asarray(a, "<u8") for a in (c, one, two, many, left))))
            for k in range(1, 5):
                totals[3 + k] += int((left == k).sum())
            totals[8] += int((left >= 3).sum())
            totals[9] += int(left.sum())
            totals[10] += int(((c > 0) & (words != begin)).sum()) + int((words == finish).sum())
            totals[11] += int(c.sum())
        yield pd.DataFrame([totals], columns=_TOTALS)

    def arrow(batches):
        for frame in task(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
    return arrow


def _hot(texts: DataFrame, ids: DataFrame) -> list[int]:
    """Hashes of at most HOT_WORDS words that are frequent in the sample, chosen by a hash of the ids."""
    limit = ids.orderBy("h").limit(HOT_SAMPLE).agg(F.max("h")).first()[0]
    if limit is None:
        return []

    def count(batches):
        for frame in batches:
            words = pd.Series([word_hash(w) for t in frame["text"] for w in (t or "").encode().lower().split()], dtype="uint64")
            yield words.astype("uint64").value_counts().rename_axis("word").reset_index(name="n").assign(
                word=lambda f: f["word"].to_numpy(np.uint64).view(np.int64)).assign(n=lambda f: f["n"].astype("int64"))

    counts = (texts.filter(F.col("h") <= F.lit(limit)).select("text").mapInPandas(count, "word long, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()
    every = counts.agg(F.sum("n")).first()[0] or 0
    return [word_hash(BEGIN), *(w & 0xFFFFFFFFFFFFFFFF for w, n in top if n >= HOT_SHARE * every)]


class Model:
    """Where the arrays lie, the numbers of the shards, and the totals. Small: it goes to the workers with the task."""

    def __init__(self, folder: str, shards: np.ndarray, hot: list[int], totals: dict[str, int]):
        self.folder, self.shards, self.hot, self.totals = folder, shards, hot, totals
        n = totals
        self.pair_discounts = discounts(n["n1"], n["n2"], n["n3"], n["n4"])
        self.word_discounts = discounts(n["m1"], n["m2"], n["m3"], n["m4"])
        d = self.word_discounts
        taken = d[1] * n["m1"] + d[2] * n["m2"] + d[3] * n["more"]
        self.words = n["words"]
        self.uniform = (taken / n["pairs"] if n["pairs"] else 1.0) / (self.words + 1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more. Where a count of counts is missing, halves stand in."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k))
                            for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def shard_count(docs: DataFrame, chars: int = SHARD_CHARS) -> int:
    """One shard for so many characters of text, at least as many as shuffles have partitions."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // chars))


def trained(docs: DataFrame, folder: str | None = None, chars: int = SHARD_CHARS) -> Model:
    """Counts all texts of docs (doc_id, text) and stores the model, in shards of `chars` characters of text each."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "kneser-ney")
    partitions = shard_count(docs, chars)
    shards = np.array(shards_of(spark, partitions), np.int64)
    h = F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    hot = _hot(docs.select(h, "text"), docs.select(h))
    pairs = docs.select("text").mapInArrow(_pairs(np.array(hot, np.uint64), shards), "shard long, blob binary")
    words = (pairs.repartition(partitions, "shard").sortWithinPartitions("shard")
             .mapInArrow(_added_pairs(folder, shards), "shard long, blob binary"))
    totals = (words.repartition(partitions, "shard").sortWithinPartitions("shard")
              .mapInArrow(_added_words(folder), ", ".join(f"{t} long" for t in _TOTALS))
              .agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in _TOTALS]).first().asDict())
    return Model(folder, shards, hot, totals)


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, kinds: tuple[str, ...]) -> list[np.ndarray] | None:
    """The arrays of one file, mapped; None where a shard has no file."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    files, path = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    path = f"{path}/{name}"
    if files.get_file_info(path).type == FileType.NotFound:
        return None
    if isinstance(files, LocalFileSystem):
        with open(path, "rb") as f:
            return _unblob(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), *kinds)
    import tempfile
    with tempfile.TemporaryFile() as own, files.open_input_stream(path) as data:  # has no name: it goes with the worker
        while chunk := data.read(1 << 22):
            own.write(chunk)
        own.flush()
        return _unblob(mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ), *kinds)


def _found(model: Model, stem: str, kinds: tuple[str, ...], keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """The stored numbers of each key, zero for unknown ones."""
    out = [np.zeros(len(keys), np.uint64) for _ in kinds[1:]]
    order = np.lexsort((keys, shard))
    at = _runs(shard[order])
    for a, b in zip(at, np.append(at[1:], len(order))):
        mine = order[a:b]
        arrays = _mapped(model.folder, f"{stem}-{int(shard[mine[0]])}", kinds)
        if arrays is None or not len(arrays[0]):
            continue
        place = np.minimum(np.searchsorted(arrays[0], keys[mine]), len(arrays[0]) - 1)
        known = arrays[0][place] == keys[mine]
        for values, column in zip(arrays[1:], out):
            column[mine[known]] = values[place[known]]
    return out


_WORD_KINDS = ("<u8",) * 6
_PAIR_KINDS = ("<u8", "<u4")


def score_texts(model: Model, numbers: _Numbers, parts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of each text, given in numbers: n_tokens, n_known, base_score and score."""
    hashes = numbers.hashes()
    c, one, two, many, left = (a.astype(np.float64) for a in _found(
        model, "words", _WORD_KINDS, hashes, _word_shard(hashes, model.shards)))

    D, d = model.pair_discounts, model.word_discounts
    lower = np.maximum(left - d[np.minimum(left, 3).astype(np.int64)], 0) / max(model.totals["pairs"], 1) + model.uniform
    given = np.where(c > 0, (D[1] * one + D[2] * two + D[3] * many) / np.maximum(c, 1), 1.0)
    seen = c.copy()
    seen[1], seen[0] = c[0], 0  # a text ends as often as it begins

    pairs = _paired(parts)
    order = np.argsort(pairs)
    pairs = pairs[order]
    new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    different = pairs[new]
    where = np.empty(len(pairs), np.uint32)
    where[order] = np.cumsum(new) - 1
    del pairs, order, new
    u, w = (different >> np.uint64(32)).astype(np.int64), (different & np.uint64(0xFFFFFFFF)).astype(np.int64)
    both, = _found(model, "pairs", _PAIR_KINDS, _pair_hash(hashes[u], hashes[w]),
                   _pair_shard(hashes[u], hashes[w], np.array(model.hot, np.uint64), model.shards))
    both = both.astype(np.float64)
    chance = (np.maximum(both - D[np.minimum(both, 3).astype(np.int64)], 0) / np.maximum(c[u], 1)
              + given[u] * lower[w])
    n = model.totals["tokens"]
    base = np.log10((seen + ADDED) / (n + ADDED * (model.words + 1)))

    sizes = np.array([len(p) - 1 for p in parts])
    starts = np.cumsum(sizes) - sizes
    token = w[where]
    return {"n_tokens": sizes, "n_known": np.add.reduceat((seen[token] > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base[token], starts),
            "score": np.add.reduceat(np.log10(chance)[where], starts)}


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs with n_tokens, n_known, base_score, score (log10 of the text's probability) and
    perplexity, for every row. A task holds SCORED_TOKENS tokens at a time."""
    kept = docs.select(*keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    schema = ", ".join([*fields, "n_tokens long", "n_known long", "base_score double", "score double",
                        "perplexity double"])
    n_kept = len(keep)

    def task(batches):
        for batch in batches:
            column, start = batch.column(n_kept), 0
            while start < batch.num_rows:
                numbers, parts, n, end = _Numbers(), [], 0, start
                while end < batch.num_rows and n < SCORED_TOKENS:
                    parts.append(numbers.of(column[end].as_py()))
                    n += len(parts[-1])
                    end += 1
                of = score_texts(model, numbers, parts)
                of["perplexity"] = 10.0 ** np.minimum(-of["score"] / of["n_tokens"], 300.0)
                names = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(start, end - start) for k in range(n_kept)]
                    + [pa.array(of[k], pa.int64() if k[0] == "n" else pa.float64()) for k in names],
                    names=[*keep, *names])
                start = end

    return docs.select(*keep, "text").mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    """A tenth of the ids, by the CRC-32 of their text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0
