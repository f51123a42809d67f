"""Word splitting and lexicon scoring as array expressions.

A dictionary segmenter for unspaced scripts is not reproduced: runs of Han characters become
overlapping two-character words, everything else is split on spaces and sentence marks.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import marks
from murmur.functions.scalars import bound, kept_text

GAPS = r"[\s，。！？]+"
HAN = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
HAN_OR_OTHER = rf"[{HAN}]+|[^{HAN}\s，。！？]+"

# Calibration of the base score by lexicon hits.
BASE_WEIGHT = 0.08
LENGTH_DECAY = 0.01
MAX_ADJUSTMENT = 0.15
NO_WORDS_SCORE = 0.5

@dataclass(frozen=True)
class Lexicon:
    """Word lists used while scoring and counting. Callers may bring their own."""

    positive: tuple[str, ...] = ("good", "great", "best", "excellent", "happy", "love", "support", "success",
                                 "好", "优秀", "支持", "喜欢", "成功")
    negative: tuple[str, ...] = ("bad", "worst", "worthless", "stupid", "idiot", "hate", "failure", "awful",
                                 "差", "糟糕", "愤怒", "失望", "失败")
    stopwords: tuple[str, ...] = ("the", "a", "an", "and", "or", "of", "in", "is", "to", "by", "it", "on",
                                  "的", "了", "是", "和", "在")

    def extended(self, positive=(), negative=(), stopwords=()) -> Lexicon:
        """The same lexicon with more words."""
        return replace(
            self,
            positive=tuple(dict.fromkeys([*self.positive, *positive])),
            negative=tuple(dict.fromkeys([*self.negative, *negative])),
            stopwords=tuple(dict.fromkeys([*self.stopwords, *stopwords])),
        )


@dataclass(frozen=True)
class Calibration:
    base_weight: float = BASE_WEIGHT
    length_decay: float = LENGTH_DECAY
    max_adjustment: float = MAX_ADJUSTMENT
    lexicon: Lexicon = field(default_factory=Lexicon)


def member(word: Column, words) -> Column:
    return word.isin(list(words)) if words else F.lit(False)


def _with_han(lowered: Column) -> Column:
    def pairs(run: Column) -> Column:
        whole = ~run.rlike(f"^[{HAN}]{{2}}")
        return F.when(whole, F.array(run)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))

    return F.flatten(F.transform(F.regexp_extract_all(lowered, F.lit(HAN_OR_OTHER), F.lit(0)), pairs))


def split_words(kept: Column) -> Column:
    """Lower-case words of a text of which only words, spaces and marks are left."""
    def split(lowered: Column) -> Column:
        ascii_only = F.octet_length(lowered) == F.length(lowered)
        return (F.when(ascii_only, F.array_remove(F.split(lowered, r"\s+"), ""))
                .when(~lowered.rlike(f"[{HAN}]"), F.array_remove(F.split(lowered, GAPS), ""))
                .otherwise(_with_han(lowered)))

    return bound(F.lower(kept), split)


def words_of(text: Column, stopwords=()) -> Column:
    words = split_words(kept_text(text))
    return F.filter(words, lambda w: ~member(w, stopwords)) if stopwords else words


def adjusted_score(base: Column, n_words: Column, pos: Column, neg: Column, cal: Calibration) -> Column:
    """Base score moved by the larger hit count, less per hit as the text gets longer."""
    weight = F.least(F.lit(cal.base_weight) / (F.lit(1.0) + F.lit(cal.length_decay) * F.sqrt(n_words)),
                     F.lit(cal.max_adjustment))
    start = base.cast("double")
    moved = (F.when(pos > neg, F.least(F.lit(1.0), start + weight * pos))
             .when(neg > pos, F.greatest(F.lit(0.0), start - weight * neg))
             .otherwise(start))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(moved, 3)))
    return F.when(n_words > 0, score).otherwise(F.lit(NO_WORDS_SCORE))


def with_score(df: DataFrame, base: Column, text: str = "content", out: str = "score",
               cal: Calibration | None = None) -> DataFrame:
    """Adds the calibrated score of a text column. No shuffle; the whole text is scored. The word lists are part of the
    expression, as hash sets; lists that are kept as a table go through scored_by_join."""
    cal = cal or Calibration()
    lex = cal.lexicon
    return (df
            .withColumn("_words", words_of(F.col(text), lex.stopwords))
            .withColumn("_hits", F.filter("_words", lambda w: member(w, lex.positive + lex.negative)))
            .withColumn(out, adjusted_score(
                base, F.size("_words"),
                F.size(F.filter("_hits", lambda w: member(w, lex.positive))),
                F.size(F.filter("_hits", lambda w: member(w, lex.negative))), cal))
            .drop("_words", "_hits"))


def counted(words: Column) -> Column:
    """(word, n) of the different words of an array."""
    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1),
                          lambda i: (i == 0) | (F.get(ordered, i - 1) != F.get(ordered, i)))
        return bound(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ordered, i).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("bigint").alias("n"))))

    none = F.array().cast("array<struct<word:string,n:bigint>>")
    return bound(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none))


def scored_by_join(df: DataFrame, key: str, base: Column, lexicon: DataFrame, text: str = "content",
                   cal: Calibration | None = None) -> DataFrame:
    """(key, score), a row for every row of df, with the word lists as a table (word, kind) of any size, kind in pos /
    neg / stop.

    The words of a text are counted where it is read, and only those whose bit is set among the words of the lists
    (six bits a word) go on to the join, once for each distinct text, known by its hash. No text is sent.
    """
    cal = cal or Calibration()
    kinds = lexicon.groupBy("word").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k)
                                          for k in ("pos", "neg", "stop")])
    rows = df.select(F.col(key), base.alias("_base"), F.col(text).alias("_text"),
                     F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_hash"))
    whole = F.struct(F.lit(None).cast("string").alias("word"), F.size("_words").cast("bigint").alias("n"))  # the null word
    each = (rows.select("_hash", words_of(F.col("_text")).alias("_words"))
            .select("_hash", F.explode(F.concat(counted(F.col("_words")), F.array(whole))).alias("_w"))
            .select("_hash", "_w.word", "_w.n"))
    listed = each.filter(F.col("word").isNull() | marks.is_marked(F.col("word"), marks.of(kinds, "word")))
    # Rows with equal texts give equal counts, so one of them stands for all.
    kept = listed.groupBy("_hash", "word").agg(F.max("n").alias("n")).join(kinds, "word", "left")
    stop, zero = F.coalesce("stop", F.lit(0)) == 1, F.lit(0).cast("bigint")
    per_text = kept.groupBy(F.col("_hash").alias("_of")).agg(
        F.sum(F.when(F.col("word").isNull(), F.col("n")).when(stop, -F.col("n")).otherwise(zero)).alias("n"),
        F.sum(F.when(stop, zero).otherwise(F.col("n") * F.coalesce("pos", F.lit(0)))).alias("pos"),
        F.sum(F.when(stop, zero).otherwise(F.col("n") * F.coalesce("neg", F.lit(0)))).alias("neg"))
    return (rows.select(key, "_base", "_hash").join(per_text, F.col("_hash") == F.col("_of"), "left")
            .select(key, adjusted_score(F.col("_base"), F.col("n"), F.col("pos"), F.col("neg"), cal).alias("score")))


def log_idf(n_texts: Column, df: Column) -> Column:
    return F.log((n_texts + 1).cast("double") / (df + 1).cast("double"))

