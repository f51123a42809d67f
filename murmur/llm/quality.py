"""Quality rules with thresholds that follow the data: quantile sketches per language and source.

Base rules judge a text alone: fewer than 10 words, or more than a fifth of the words inside repeated 5-word windows.
The method judges what passes them. Four measures of a text (integers, see MEASURES) are counted into sketches, one for each
language, source and measure. A sketch is a histogram whose steps keep seven binary digits of a value, so a quantile
is right to one part in 64 and two sketches merge by adding their counts: the sketch of a language is the sum of its
sources', that of all documents the sum of the languages'. Each sketch gives its quartiles, and a fence stands
REACH interquartile ranges beyond them; the range counts as at least SPREAD of the measure, so a measure that is the
same in nearly all texts does not reject the next value. A pair of language and source with fewer than MIN_DOCS texts
takes the fences of its language, a language with fewer those of all. The fences are joined to the texts, and a text
beyond one of them is rejected. Only texts that pass the base rules are counted.

SPREAD lets the lower fence of word_length fall below any text where the quartile is under 700, as in most spaced
languages. A lower fence therefore does not go below FLOOR percent of the lower quartile, so a text of single letters is
beyond it.

Everything is a DataFrame expression. A text never leaves its row: windows of a text are compared by a 64-bit hash
inside the row, and only the measures are shuffled, as counts.

Defined results: a null text has no words and fails the base; a null language or source is a value of its own; repeated
rows are judged alike; a value equal to a fence is within it; a very long text is judged whole, in its row; an empty table gives no rows; further columns are left out of the features, whatever their
names, and `accepted` passes all columns of the input on.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.store import written
from murmur.llm.words import words

WINDOW = 5  # words; the hashes below are built for five
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_DOCS = 50
REACH = 3
FLOOR = 50  # percent of the lower quartile
#: name: (numerator, factor, denominator, least interquartile range, lower fence, upper fence)
MEASURES = {
    "symbols": ("n_symbols", 1000, "n_words", 30, False, True),
    "word_length": ("word_chars", 100, "n_words", 200, True, True),
    "dup_lines": ("n_dup_lines", 1000, "n_words", 30, False, True),
    "capitals": ("n_capitals", 1000, "word_chars", 60, False, True),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TEXT, _WORDS, _HASHES = "_q_text", "_q_words", "_q_hashes"


def _covered(hashes: Column) -> Column:
    """How many words lie in windows that occur twice or more, from the hashes of all windows in order. Sorted by
    hash and place, a window is repeated if a neighbour has its hash; a window covers WINDOW words, or as many as
    lie before the next repeated window."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                         | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    # An array of one element binds a value that several expressions use.
    bound = F.transform(F.transform(F.array(ordered), places), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, WINDOW).otherwise(F.least(F.get(p, k + 1) - x,
                                                                                          F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x))
    return F.get(bound, 0).cast("long")


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns with the counts of BASE, n_capitals and base_failed, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(_WORDS)
    lines = F.filter(F.split(_TEXT, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def paired(name: str, further: str, away: int) -> Column:
        """Hashes of each value with the one so many places further on; beyond the end they mean nothing."""
        return F.zip_with(name, F.slice(further, away + 1, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))

    # Hashes of one word, of two, of four and of five from each place on; only whole windows are kept.
    counted = (docs.select(*keep, text.alias(_TEXT))
               .withColumn(_WORDS, words(F.col(_TEXT)))
               .withColumn("_q_1", F.transform(_WORDS, lambda w: F.xxhash64(w)))
               .withColumn("_q_2", paired("_q_1", "_q_1", 1))
               .withColumn("_q_4", paired("_q_2", "_q_2", 2))
               .withColumn(_HASHES, F.slice(paired("_q_4", "_q_1", 4), 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
               .withColumn("_q_lines", lines))
    measured = counted.select(
        *keep, n.cast("long").alias("n_words"),
        F.length(F.array_join(_WORDS, "")).cast("long").alias("word_chars"),
        F.regexp_count(_TEXT, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(_HASHES)) == F.size(_HASHES), F.lit(0).cast("long"))
        .otherwise(_covered(F.col(_HASHES))).alias("n_repeat_words"),
        F.regexp_count(_TEXT, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def _values() -> dict[str, Column]:
    return {name: F.expr(f"{top} * {factor} div greatest({below}, 1)")
            for name, (top, factor, below, *_) in MEASURES.items()}


def step(value: Column) -> Column:
    """The lower end of a value's step: its seven leading binary digits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, step, n: mergeable by adding n."""
    one = [F.struct(F.lit(name).alias("measure"), step(value).alias("step")) for name, value in _values().items()]
    return (measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*one)).alias("m"))
            .groupBy("lang", "source", "m.measure", "m.step").agg(F.count(F.lit(1)).alias("n")))


def _fences(sketch: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """Low and high fence of every measure, and the number of texts, one row for each value of the keys."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "step").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merged.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "docs", F.sum("n").over(Window.partitionBy(*by)))
    quartile = {q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("step"))) for q in (1, 3)}
    ends = placed.groupBy(*by).agg(F.max("docs").alias("docs"), quartile[1].alias("q1"), quartile[3].alias("q3"))
    columns = [F.max("docs").alias("docs")]
    for name, (_, _, _, spread, low, high) in MEASURES.items():
        here = F.col("measure") == name
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        lowest = F.greatest(F.col("q1") - reach, F.expr(f"q1 * {floor} div 100"))
        columns.append(F.max(F.when(here, lowest if low else F.lit(-1).cast("long"))).alias(f"low_{name}"))
        columns.append(F.max(F.when(here, F.col("q3") + reach if high else F.lit(2 ** 62))).alias(f"high_{name}"))
    return ends.groupBy(*keys).agg(*columns) if keys else ends.agg(*columns)


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, floor: int = FLOOR) -> DataFrame:
    """One row for each language and source with the fences that hold for it."""
    bounds = [f"{side}_{name}" for name in MEASURES for side in ("low", "high")]
    pairs, langs = (
        _fences(sketch, keys, floor).select(*[F.col(c).alias(f"k{k}_{c}") for c in keys],
                                     F.struct("docs", *bounds).alias(f"f{k}"))
        for k, keys in enumerate((["lang", "source"], ["lang"])))
    row = _fences(sketch, [], floor).first().asDict()  # the fences of all texts: one row
    every = F.struct(*[F.lit(row[c]).cast("long").alias(c) for c in ("docs", *bounds)])
    joined = pairs.join(langs, F.col("k0_lang").eqNullSafe(F.col("k1_lang")), "left")
    chosen = (F.when(F.col("f0.docs") >= min_docs, F.col("f0")).when(F.col("f1.docs") >= min_docs, F.col("f1"))
              .otherwise(every))
    return joined.select(F.col("k0_lang").alias("t_lang"), F.col("k0_source").alias("t_source"),
                         chosen.alias("fence"))


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ("doc_id", "lang", "source"),
           floor: int = FLOOR) -> DataFrame:
    """The features of every document with `kept`: it passes the base rules and lies within all fences."""
    measured = written(features(docs, keep), "quality-features")
    fences = written(thresholds(sketches(measured), min_docs, floor), "quality-fences")
    joined = measured.join(fences, measured["lang"].eqNullSafe(fences["t_lang"])
                           & measured["source"].eqNullSafe(fences["t_source"]), "left")
    beyond = reduce(or_, [(value < F.col(f"fence.low_{name}")) | (value > F.col(f"fence.high_{name}"))
                          for name, value in _values().items()])
    kept = ~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))
    return joined.withColumn("kept", kept).drop("t_lang", "t_source", "fence")


def accepted(docs: DataFrame, min_docs: int = MIN_DOCS, floor: int = FLOOR) -> DataFrame:
    """The rows of the documents that the rules accept, with all their columns. Rows are told apart by a number
    written beside them, so equal ids do no harm."""
    numbered = docs.select("text", "lang", "source", F.struct("*").alias("_row"))
    return judged(numbered, min_docs, ("lang", "source", "_row"), floor).filter("kept").select("_row.*")
