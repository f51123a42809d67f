"""Packing documents into training sequences by lexical retrieval.

A document's ids end with END. It is cut into windows of WIDTH ids; a whole window is a sequence of its own, and what is
left over, the tail, shares a sequence with the tails of similar documents. Tails are dealt out by a locality key, the
least hash of their pairs of adjacent ids, so copies and near copies come together, and Spark splits what is too large.
A task takes its tails in blocks. A block is one shard of the inverted index: its terms are pairs of adjacent ids, which
stand for words and parts of words, and its postings carry BM25 weights. The first unused tail seeds a sequence; its rarest
terms retrieve unused neighbours, which fill the window greedily in the order of their scores, first those that fit
as a whole. The best one left is cut to fill the rest, and its remainder stays in the block. Where the seed retrieves
too little, its neighbours are asked in turn, and if nothing shares a term with any, the next unused tail is taken.
Thus only the last sequence of a task is shorter than WIDTH; a sequence that a block cannot fill is handed to the next.

A block has at most BLOCK tails, so a task's memory is bounded, however many documents share one key. Texts pass
once through Python, ids once through a shuffle, as 16-bit numbers.

Defined results: a null or empty text is END alone; null and repeated ids are packed like any other row, each on its
own; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.tokens import VOCABULARY, encoder

WIDTH = 2048
END = 1
BLOCK = 2048  # tails in one shard of the index
QUERY_TERMS = 24  # rarest terms of a seed that are looked up
NEIGHBOURS = 48  # best-scored tails that are offered to a window
K1, B = 1.2, 0.75
BATCH_BYTES = 4_000_000

_CUT = "doc_id long, doc_tokens long, start long, ids binary, key long, full boolean"
_CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()),
                        ("ids", pa.binary()), ("key", pa.int64()), ("full", pa.bool_())])
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                           ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                           ("ids", pa.binary())])


def terms_of(ids: np.ndarray) -> np.ndarray:
    """Pairs of adjacent ids, as unsigned 32-bit numbers."""
    return (ids[:-1].astype(np.uint32) << np.uint32(16)) | ids[1:]


def _locality(ids: np.ndarray) -> int:
    terms = terms_of(ids)
    return int((terms * np.uint32(2654435761)).min()) if len(terms) else 0


def _batches(rows: Iterator[tuple], schema: pa.Schema, blob: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few megabytes; blob is the place of the column that holds the ids."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[blob]) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _cutter(vocabulary: str, width: int, end: int):
    def cut(batches):
        encode, last = encoder(vocabulary).raw, np.array([end], "<u2").tobytes()

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + last
                    n = len(ids) // 2
                    whole = n // width * width
                    for start in range(0, whole, width):
                        key = (start * 2654435761 + (doc_id or 0) * 40503) & 0xFFFFFFFF
                        yield doc_id, n, start, ids[2 * start:2 * (start + width)], key, True
                    if whole < n:
                        rest = ids[2 * whole:]
                        yield doc_id, n, whole, rest, _locality(np.frombuffer(rest, "<u2")), False
        return _batches(rows(), _CUT_ARROW, 3)
    return cut


class Index:
    """An inverted index over one block of tails, with BM25 weights in its postings. Terms of one tail alone are
    left out, as they can retrieve nothing else."""

    def __init__(self, tails: list[np.ndarray]):
        self.n = len(tails)
        lengths = np.array([len(t) for t in tails], np.int64)
        terms = np.concatenate([terms_of(t) for t in tails])
        owner = np.repeat(np.arange(self.n, dtype=np.uint64), np.maximum(lengths - 1, 0))
        keys = np.sort((terms.astype(np.uint64) << np.uint64(32)) | owner)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        term = (keys >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else first
        df = np.diff(np.append(begin, len(term)))
        shared = np.repeat(df >= 2, df)
        keys, count = keys[shared], count[shared]
        self.terms, self.df = term[begin][df >= 2], df[df >= 2]
        self.begin = np.concatenate([[0], np.cumsum(self.df)])
        self.docs = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rarity = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        long = K1 * (1 - B + B * lengths / max(lengths.mean(), 1.0))
        self.weights = np.repeat(rarity, self.df) * count * (K1 + 1) / (count + long[self.docs])

    def scores(self, tail: np.ndarray) -> np.ndarray:
        """The BM25 score of every tail of the block for the rarest terms of one."""
        terms = np.sort(terms_of(tail))
        if not len(terms) or not len(self.terms):
            return np.zeros(self.n)
        terms = terms[np.concatenate([[True], terms[1:] != terms[:-1]])]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        at = at[self.terms[at] == terms]
        if len(at) > QUERY_TERMS:
            at = at[np.argsort(self.df[at], kind="stable")[:QUERY_TERMS]]
        if not len(at):
            return np.zeros(self.n)
        spans = [slice(self.begin[k], self.begin[k + 1]) for k in at]
        return np.bincount(np.concatenate([self.docs[s] for s in spans]),
                           np.concatenate([self.weights[s] for s in spans]), minlength=self.n)


def fill(tails: list[tuple[int, np.ndarray]], width: int, last: bool):
    """Packs one block. tails: (first place, ids) of each. Yields sequences as lists of (tail, from, to), places within
    the tail; then, in a list of its own under the name None, what no full sequence was found for, unless last."""
    ids = [t for _, t in tails]
    index = Index(ids)
    done = np.zeros(len(ids), np.int64)
    left = np.array([len(t) for t in ids], np.int64)

    def take(tail: int, room: int) -> tuple[int, int, int]:
        n = min(int(left[tail]), room)
        at = int(done[tail])
        done[tail] += n
        left[tail] -= n
        return tail, at, at + n

    following = 0
    for seed in range(len(ids)):
        while left[seed]:
            window = [take(seed, width)]
            room = width - (window[0][2] - window[0][1])
            if room:
                asked = 0
                while room and asked < len(window):  # the seed, then each neighbour, until the window is full
                    score = index.scores(ids[window[asked][0]])
                    asked += 1
                    score[left == 0] = 0
                    found = np.flatnonzero(score)
                    if len(found) > NEIGHBOURS:
                        found = found[np.argpartition(-score[found], NEIGHBOURS - 1)[:NEIGHBOURS]]
                    found = found[np.argsort(-score[found], kind="stable")].tolist()
                    for whole in (True, False):
                        for t in found:
                            if room and left[t] and (left[t] <= room or not whole):
                                window.append(take(t, room))
                                room -= window[-1][2] - window[-1][1]
                following = max(following, seed + 1)
                while room and following < len(ids):
                    if left[following]:
                        window.append(take(following, room))
                        room -= window[-1][2] - window[-1][1]
                    else:
                        following += 1
            if room and not last:
                yield None, window
            else:
                yield seed, window


def _packer(width: int):
    def pack(batches):
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made = 0

        def sequence(pieces):
            nonlocal made
            offset = 0
            for doc_id, n, start, ids in pieces:
                yield doc_id, start, len(ids), n, place + made, offset, ids.astype("<u4").tobytes()
                offset += len(ids)
            made += 1

        def block(held, last):
            rest = []
            for seed, window in fill([(h[2], h[3]) for h in held], width, last):
                pieces = [(held[t][0], held[t][1], held[t][2] + a, held[t][3][a:b]) for t, a, b in window]
                if seed is None:
                    rest.extend(pieces)
                else:
                    yield from sequence(pieces)
            held[:] = rest

        def rows():
            held = []
            for batch in batches:
                for doc_id, n, start, raw, full in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    ids = np.frombuffer(raw, "<u2")
                    if full:
                        yield from sequence([(doc_id, n, start, ids)])
                        continue
                    held.append((doc_id, n, start, ids))
                    if len(held) >= BLOCK:
                        yield from block(held, False)
            if held:
                yield from block(held, True)
        return _batches(rows(), _PIECES_ARROW, 6)
    return pack


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, width: int = WIDTH, end: int = END) -> DataFrame:
    """The pieces of all documents (doc_id, text): doc_id, start and length of the piece in its document's ids,
    doc_tokens (all ids of the document), sequence_id, offset in the sequence, and the ids themselves, as
    little-endian unsigned 32-bit numbers. Every id lies in one piece."""
    cut = (docs.select(F.col("doc_id").cast("long"), "text")
           .mapInArrow(_cutter(vocabulary, width, end), _CUT))
    dealt = (cut.hint("rebalance", F.col("key")).sortWithinPartitions("key", "doc_id", "start")
             .select("doc_id", "doc_tokens", "start", "ids", "full"))
    return dealt.mapInArrow(_packer(width), PIECES)
