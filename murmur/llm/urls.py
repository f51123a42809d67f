"""Verdicts on URLs: a list of rules, and a logistic regression on hashed character n-grams for the rest.

A rule names a host and a path; it fits that host and all below it where the URL's path begins with the rule's, and the
longest rule that fits decides. URLs that no rule fits are judged by a model of the n-grams of their host and path,
hashed into FEATURES places. It learns from a small table of labelled URLs (url, block); where none is given, from
the URLs that the rules decide, at most LABELLED of them, those with the least hash. Host and path are hashed apart, so
a piece of a host is no piece of a path.

The rules are a list of the caller's and become one expression, so nothing is shuffled or joined to judge a URL. The
model is fitted and applied by Spark's own library.

Defined results: a null URL, or one without "://", has an empty host and path, no rule, and verdict allow, as there is
nothing to judge; if the labelled table holds one verdict only, that is everyone's, and without any it is allow;
repeated rows and null ids are judged like any others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.store import written

ALLOW, BLOCK = "allow", "block"
RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK),
         ("net/fr/", BLOCK))
SIZES = (3, 4)
FEATURES = 1 << 16
LABELLED = 20_000
ROUNDS = 25
STRENGTH = 1e-3  # of the penalty on squared weights


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of equal rules the first counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    if not rules:
        return out
    chain = None
    for text, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = (host == name) | host.endswith("." + name)
        fits = fits & path.startswith(slash + rest) if slash else fits
        found = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    return chain.otherwise(out)


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, marked by where they come from, ends included."""
    def of(mark: str, text: Column) -> list[Column]:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))),
                            lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n)))) for n in SIZES]
    return F.concat(*of("h", host), *of("p", path))


def _featured(rows: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashed.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def trained(labelled: DataFrame, most: int = LABELLED):
    """A model from labelled URLs (url string, block boolean), at most so many; a verdict where there is but one."""
    host, path = parsed(F.col("url"))
    some = written(labelled.filter("block IS NOT NULL").select(host.alias("host"), path.alias("path"),
                                                               F.col("block").cast("double").alias("label"))
                   .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(most), "urls-labelled")
    kinds = [r[0] for r in some.select("label").distinct().collect()]
    if len(kinds) < 2:
        return BLOCK if kinds == [1.0] else ALLOW
    fit = LogisticRegression(maxIter=ROUNDS, regParam=STRENGTH, standardization=False)
    return fit.fit(_featured(some))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None,
           most: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    host, path = parsed(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("of", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        fits = rule_for(*parsed(F.col("url")), rules)["verdict"]
        labelled = pages.select("url", (fits == BLOCK).alias("block"))
    model = trained(labelled, most)
    if isinstance(model, str):
        guessed = ruled.withColumn("guess", F.lit(model))
    else:
        keep = ["page_id", "host", "path", "of"]
        judge = model.transform(_featured(ruled)).select(*keep, "prediction")
        guessed = judge.withColumn("guess", F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW))
    nothing = (F.col("host") == "") & (F.col("path") == "")
    verdict = F.coalesce(F.col("of.verdict"), F.when(nothing, ALLOW).otherwise(F.col("guess")))
    return guessed.select("page_id", "host", "path", F.col("of.rule").alias("rule"), verdict.alias("verdict"))
