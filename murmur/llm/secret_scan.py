"""Secrets in texts: three fixed patterns, and character models of random strings against ordinary identifiers.

The models are Markov chains of first order over the characters of identifiers, one counted from random strings and one
from ordinary words. What the patterns find is cut out of the runs of such characters, and a part that is left is a
secret where the logarithm of the likelihood ratio is at least LEAST_RATIO per step; a part of fewer than SURE_STEPS
needs a larger sum, by as much as it is shorter, and no length is left out. The labelled samples are bounded: SAMPLE documents with the least
hash of their id. What the patterns find there is random, together with RANDOM strings drawn by a seeded generator
from the alphabets of keys, so a corpus without secrets trains too; all other runs of the sample are ordinary. Pairs
of characters are counted in Spark, and the driver gets at most two counts for each pair of the alphabet.

Each text is scanned whole, once, in the place where it lies; nothing is shuffled.

Defined results: a null text is an empty one, without spans; spans are in code points, end exclusive, by start and then
kind; repeated rows and null ids are scanned like any others; an empty table gives no rows; `scanned` passes all columns
on, and replaces one called spans; `cleaned` passes all on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.masks import cut

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
LEAST_RATIO = 0.5  # natural logarithm, mean over the steps of a part
SURE_STEPS = 19  # from here on the mean decides
SAMPLE = 2000
RANDOM = 3000
SEED = 20
SMOOTHING = 0.5
MASK = "[SECRET]"
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The three patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIN_VALUE = 6
_KEYS = ("password", "passwd", "secret", "token", "api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
_PLACE = np.full(129, -1, np.int64)  # the last place stands for all that is not ASCII
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_N = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, kind as a place in KINDS. A match whose value is too short is
    dropped, and the search goes on behind it; runs that are too short hold no longer match, so theirs need no step
    of its own."""
    found = []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _steps(run: str) -> np.ndarray:
    """The pairs of adjacent characters of a run, as numbers."""
    at = _PLACE[np.frombuffer(run.encode("ascii"), np.uint8)]
    return at[:-1] * _N + at[1:]


def spans_of(text: str | None, ratio: np.ndarray, least: float = LEAST_RATIO) -> list[tuple[int, int, int]]:
    """The spans of the patterns, and the parts of runs outside them that the models take for random."""
    if not text:
        return []
    found = base_spans(text)
    at = _PLACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    for start, _, end in found:
        at[start:end] = -1
    inside = np.concatenate([[False], at >= 0, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    joined = inside[1:-2] & inside[2:-1]
    sums = np.concatenate([[0.0], np.cumsum(np.where(joined, ratio[at[:-1] * _N + at[1:]], 0.0))])
    steps = ends - starts - 1
    needed = least * np.maximum(steps, SURE_STEPS ** 2 / np.maximum(steps, 1))
    random = sums[ends - 1] - sums[starts] >= needed
    more = [(a, 3, b) for a, b in zip(starts[random].tolist(), ends[random].tolist())]
    return sorted(found + more) if more else found


def random_strings(n: int = RANDOM, seed: int = SEED) -> list[str]:
    """Strings of 20 to 64 characters, drawn evenly from the alphabets of hexadecimal, base 32 and base 64 keys."""
    draw = np.random.default_rng(seed)
    sets = ["0123456789abcdef", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_"]
    return ["".join(draw.choice(list(sets[k % len(sets)]), draw.integers(20, 65))) for k in range(n)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of characters in one partition's share of the sample: kind 0 ordinary, 1 random."""
    counts = np.zeros((2, _N * _N), np.int64)
    for batch in batches:
        for text in batch["text"]:
            if not text:
                continue
            spans = base_spans(text)
            for start, _, end in spans:
                found = text[start:end]
                value = found[len(found.rstrip(ALPHABET)):]
                if len(value) >= 16:
                    np.add.at(counts[1], _steps(value), 1)
            k, until = 0, 0  # the spans that begin before a word ends, and how far they reach
            for m in _WORDS.finditer(text):
                while k < len(spans) and spans[k][0] < m.end():
                    until = max(until, spans[k][2])
                    k += 1
                if until <= m.start():
                    np.add.at(counts[0], _steps(m.group()), 1)
    kind, pair = np.nonzero(counts)
    yield pd.DataFrame({"kind": kind, "pair": pair, "n": counts[kind, pair]})


def trained(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """For each pair of characters the logarithm of its probability among random strings over that among ordinary
    ones. The sample is chosen by a hash of the id, from the ids alone."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = docs.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    counts = np.zeros((2, _N * _N))
    if chosen is not None:
        rows = (docs.filter(order <= F.lit(chosen)).select("text").mapInPandas(_count, "kind long, pair long, n long")
                .groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect())  # at most 2 * 67 * 67
        for kind, pair, n in rows:
            counts[kind, pair] = n
    for string in random_strings():
        np.add.at(counts[1], _steps(string), 1)
    counts = counts.reshape(2, _N, _N) + SMOOTHING
    chance = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (chance[1] - chance[0]).ravel()


def scanned(docs: DataFrame, sample: int = SAMPLE, least: float = LEAST_RATIO) -> DataFrame:
    """docs with a column spans: kind, start and end of every secret."""
    ratio = trained(docs, sample)

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t, ratio, least)]
                          for t in texts], dtype=object)

    return docs.withColumn("spans", find(F.col("text")))


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def cleaned(docs: DataFrame, mask: str = MASK, sample: int = SAMPLE, least: float = LEAST_RATIO) -> DataFrame:
    """docs with the mask in the place of every secret of their texts; spans that touch or overlap have one mask together.
    All columns pass on, whatever their names."""
    ratio = trained(docs, sample)

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = spans_of(text, ratio, least)
            out.append(cut(text, [s[0] for s in spans], [s[2] for s in spans], lambda *_: mask))
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", put(F.col("text")))
