"""Alignment of the tokens of two public tokenizers by diagonal run skipping.

Both cut the same bytes, so a token is known by where it ends. At the current shift between the two index sequences the end
arrays are compared in stretches that double as long as they agree, and halve down to the first difference: a stretch
of tokens that match one to one is jumped over in a few comparisons of slices. An irregular group is resolved on the spot,
by moving on whichever side ends first until both end together, and the shift is updated.

The result of a text is its ids on both sides and a path: one byte for each pair of tokens that overlap, in order,
telling which side moves on behind it (1 the first, 2 the second, 3 both). Groups end at the threes, so the ids and
the path hold groups and links both; one-to-one stretches are runs of threes, which compress to almost nothing.

How often an id pair is linked in the whole corpus is added up in the tasks for LINKS links at a time and then by Spark.
The table of pairs, whose size the two vocabularies bound, not the corpus, is stored in the shared folder as sorted arrays
in shards of about SHARD_PAIRS pairs, and workers map it while they weigh the links of each document; a mapped file is not
held in memory. Texts pass once through Python and are not shuffled.

Defined results: a null or empty text, and one whose tokens do not give back its bytes with a space in front on both
sides, has no tokens: zeros, an empty hash. Null and repeated ids are rows of their own, as are repeated rows; equal
counts are best together; a very long text is one row in one task, in memory linear in its length; an empty table gives no
rows; columns that are not named in `keep` are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.kneser_ney import _blob, _mapped, _put  # sorted arrays in the shared folder
from murmur.llm.store import new_folder, written

FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
LINKS = 4_000_000
SHARD_PAIRS = 1 << 19
WIDTH = 8  # of the first comparison of a run
_KINDS = ("<u4", "<u8", "|u1")
_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids binary, b_ids binary, path binary"
_WEIGHED = ["n_best", "count_sum"]


class Tokenizers:
    """Ids of whole texts on both sides, and the bytes of every id. Names of special tokens in a text are plain text."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        import public_tokenizers as public
        import sentencepiece
        import tiktoken

        with open(public.path(first), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding(first, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=public.path(second))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 65_536:
            raise ValueError("ids of these vocabularies need more than 16 bits")
        self.a_flat, self.a_starts, self.a_sizes = _flat(self.a_bytes)
        self.b_flat, self.b_starts, self.b_sizes = _flat(self.b_bytes)
        # the parts of the text of the groups: an id of the first side within its group, or its last there; the same for
        # the second side
        self.parts = ([f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
                      + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"])

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str | None):
        """The ids on both sides and where each ends; none where they do not give back the text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none, none, none
        a, b = np.array(self.a(" " + text), np.int64), np.array(self.b.encode(text), np.int64)
        whole = b" " + text.encode()
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        for ids, ends, flat, starts, sizes in ((a, a_ends, self.a_flat, self.a_starts, self.a_sizes),
                                               (b, b_ends, self.b_flat, self.b_starts, self.b_sizes)):
            if not len(ids) or ends[-1] != len(whole):
                return none, none, none, none
            size = sizes[ids]
            place = np.repeat(starts[ids] - (ends - size), size)
            place += np.arange(len(whole))
            if flat[place].tobytes() != whole:
                return none, none, none, none
        return a, b, a_ends, b_ends


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens in one array, where each begins, and their sizes."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


@lru_cache(maxsize=2)
def tokenizers(first: str = FIRST, second: str = SECOND) -> Tokenizers:
    """One pair for a worker, kept from task to task."""
    return Tokenizers(first, second)


def runs(a_ends: list[int], b_ends: list[int]):
    """Cuts two end arrays of the same bytes: (i, j, n, None) for n tokens that match one to one, and (i, j, 0, path) for
    an irregular group that begins there."""
    i = j = 0
    n_a, n_b = len(a_ends), len(b_ends)
    while i < n_a:
        start, width = i, WIDTH
        while True:  # longer and longer stretches at this shift
            width = min(width, n_a - i, n_b - j)
            if not width or a_ends[i:i + width] != b_ends[j:j + width]:
                break
            i, j, width = i + width, j + width, 2 * width
        while width > WIDTH:  # the difference is among the next `width`
            half = width // 2
            if a_ends[i:i + half] == b_ends[j:j + half]:
                i, j, width = i + half, j + half, width - half
            else:
                width = half
        while i < n_a and a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
        if i > start:
            yield start, j - (i - start), i - start, None
        if i < n_a:
            at, path = (i, j), bytearray()
            x, y = a_ends[i], b_ends[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a_ends[i]
                    path.append(1)
                else:
                    j += 1
                    y = b_ends[j]
                    path.append(2)
            path.append(3)
            i, j = i + 1, j + 1
            yield *at, 0, path


def _groups(a: np.ndarray, b: np.ndarray, path: np.ndarray, parts: list[str], second: int) -> str:
    """The ids of each group as text, `a1,a2|b1` and so on, joined by semicolons; parts of the second side begin at
    `second`."""
    a_last, b_last = path[path & 1 == 1] == 3, path[path > 1] == 3
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_end, b_end = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    b_start = np.concatenate([[0], b_end[:-1]])
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + b_start[a_group]] = 2 * a + a_last
    order[np.arange(len(b)) + a_end[b_group]] = second + 2 * b + b_last
    return "".join(map(parts.__getitem__, order.tolist()))[:-1]


def aligned_text(text: str | None, both: Tokenizers) -> tuple:
    """n_a, n_b, n_groups, n_links, hash of the groups, ids of both sides and the path of one text."""
    a, b, a_ends, b_ends = both.ids(text)
    if not len(a):
        return 0, 0, 0, 0, "", b"", b"", b""
    path, n_groups = bytearray(), 0
    for _, _, n, inner in runs(a_ends.tolist(), b_ends.tolist()):
        path += b"\x03" * n if inner is None else inner
        n_groups += n or 1
    groups = _groups(a, b, np.frombuffer(path, np.uint8), both.parts, 2 * len(both.a_bytes))
    return (len(a), len(b), n_groups, len(path), hashlib.sha256(groups.encode()).hexdigest(),
            a.astype("<u2").tobytes(), b.astype("<u2").tobytes(), bytes(path))


def aligned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), first: str = FIRST, second: str = SECOND) -> DataFrame:
    """The kept columns of docs with n_a, n_b, n_groups, n_links, groups_sha256, a_ids and b_ids (little-endian unsigned
    16-bit numbers) and path, for every row."""
    n_kept, types = len(keep), [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 3
    names = [c.split()[0] for c in _ALIGNED.split(", ")]

    def task(batches):
        both = tokenizers(first, second)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = zip(*(aligned_text(t.as_py(), both) for t in part.column(n_kept)))
                yield pa.RecordBatch.from_arrays(part.columns[:n_kept] + [pa.array(c, t) for c, t in zip(rows, types)],
                                                 names=[*keep, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
    return docs.select(*keep, "text").mapInArrow(task, ", ".join([*fields, _ALIGNED]))


def _parts(batch: pa.RecordBatch, columns: tuple[int, int, int]):
    """Slices of a batch with about LINKS links: (first row, rows, links of each, id pair of each link)."""
    a_ids, b_ids, path = (batch.column(k) for k in columns)
    start = 0
    while start < batch.num_rows:
        end, n, links = start, 0, []
        while end < batch.num_rows and n < LINKS:
            links.append(len(path[end].as_buffer()))
            n += links[-1]
            end += 1

        def joined(column, kind):
            return np.frombuffer(b"".join(column[k].as_py() for k in range(start, end)), kind)

        steps = joined(path, np.uint8)
        a, b = ((np.cumsum(step, dtype=np.int64) - step) for step in (steps & 1, steps >> 1))  # every text ends on both
        pairs = (joined(a_ids, "<u2")[a].astype(np.uint32) << np.uint32(16)) | joined(b_ids, "<u2")[b]
        yield start, end - start, np.array(links, np.int64), pairs
        start = end


def _counted(batches):
    for batch in batches:
        for _, _, _, pairs in _parts(batch, (0, 1, 2)):
            keys, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["pair", "n"])


def pair_counts(links: DataFrame) -> DataFrame:
    """From aligned rows: a, b, n (links of the corpus that hold the pair) and best (no pair of b is linked more often)."""
    counted = (links.select("a_ids", "b_ids", "path").mapInArrow(_counted, "pair long, n long")
               .groupBy("pair").agg(F.sum("n").alias("n")))
    pairs = written(counted.select(F.shiftright("pair", 16).cast("int").alias("a"),
                                   F.col("pair").bitwiseAND(65_535).cast("int").alias("b"), "n"), "pair-counts")
    most = pairs.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return pairs.join(most, F.col("b") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


class PairTable:
    """Where the arrays of the pairs lie. Small: it goes to the workers with the task."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and best of sorted different keys."""
        n, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        shard = keys % np.uint32(self.shards)
        for s in range(self.shards):
            mine = np.flatnonzero(shard == s)
            if len(mine):
                known, counts, marks = _mapped(self.folder, f"pairs-{s}", _KINDS)
                at = np.searchsorted(known, keys[mine])
                n[mine], best[mine] = counts[at], marks[at]
        return n, best


def stored(pairs: DataFrame, shard_pairs: int = SHARD_PAIRS) -> PairTable:
    """Writes the pairs as sorted arrays, one file a shard, which has about shard_pairs pairs."""
    pairs = written(pairs, "pair-table")
    table = PairTable(new_folder(pairs.sparkSession, "pair-arrays"), max(1, pairs.count() // shard_pairs))
    folder, key = table.folder, F.shiftleft(F.col("a").cast("long"), 16) + F.col("b")

    def put(frame):
        frame = frame.sort_values("pair")
        _put(folder, f"pairs-{int(frame['shard'].iloc[0])}", _blob(
            frame["pair"].to_numpy().astype("<u4"), frame["n"].to_numpy().astype("<u8"), frame["best"].to_numpy().astype("|u1")))
        return frame[["shard"]].iloc[:1]

    made = pairs.select(key.alias("pair"), "n", "best").withColumn("shard", F.col("pair") % table.shards)
    made.groupBy("shard").applyInPandas(put, "shard long").agg(F.count(F.lit(1))).first()
    return table


def weighed(links: DataFrame, table: PairTable, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns of aligned rows with n_best and count_sum: links whose pair is best for its second id, and the sum
    of the counts of all links."""
    n_kept = len(keep)

    def task(batches):
        for batch in batches:
            for start, rows, links_of, pairs in _parts(batch, (n_kept, n_kept + 1, n_kept + 2)):
                keys, where = np.unique(pairs, return_inverse=True)
                filled = links_of > 0
                at = (np.cumsum(links_of) - links_of)[filled]
                sums = []
                for values in reversed(table.found(keys)):
                    out = np.zeros(rows, np.int64)
                    if len(at):
                        out[filled] = np.add.reduceat(values[where], at)
                    sums.append(pa.array(out))
                yield pa.RecordBatch.from_arrays(batch.slice(start, rows).columns[:n_kept] + sums, names=[*keep, *_WEIGHED])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in links.select(*keep).schema.fields]
    return links.select(*keep, "a_ids", "b_ids", "path").mapInArrow(
        task, ", ".join([*fields, *[f"{c} long" for c in _WEIGHED]]))


def compared(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), first: str = FIRST, second: str = SECOND) -> DataFrame:
    """The kept columns of docs with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, for every row."""
    links = written(aligned(docs, keep, first, second), "aligned")
    table = stored(pair_counts(links))
    return weighed(links, table, (*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"))
