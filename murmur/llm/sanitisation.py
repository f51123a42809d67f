"""Personal data in texts, and the terms that reveal it, by an information-theoretic measure.

Four patterns find protected entities: mail addresses, network addresses, card numbers, phone numbers. A term beside a
mention may give an entity away although the mention itself is masked. How much follows from the corpus. With p(e) and
p(t) the shares of documents that hold entity and term, and p(t, e) the share where the term stands within REACH terms of
a mention,

    disclosure(t, e) = log(p(t, e) / (p(t) p(e))) / -log p(e)

is the part of the information of e that t carries, 1 where the term occurs with the entity alone. Evidence counts once
for each different context, so copies of one document prove nothing: a term needs SUPPORT contexts. In a document that
mentions e, terms beside it are generalised to their form from a disclosure of GENERALISED on, and removed from REMOVED
on. Documents without an entity have nothing to disclose and stay as they are.

Texts pass once through Python; of documents with mentions, ids of terms and entities (64-bit hashes) go on. Only pairs
with enough contexts ask how many documents hold the term, which the JVM counts over all texts. A mention gives at most
2 * REACH rows, so long documents grow linearly, and counts are combined before every shuffle.

Defined results: a null text is an empty one, without spans; spans are in code points, end exclusive, by kind and then
start, terms last; null and repeated ids are rows of their own; repeated rows count as documents, but give one context;
an entity that all documents hold has no information to disclose; a disclosure equal to a bound reaches it; an empty table
gives no rows; columns of docs pass on, and ones called spans (or text, when it is sanitised) are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.masks import cut
from murmur.llm.store import written

KINDS = ("email", "ip", "card", "phone", "term")
BASE_KINDS = KINDS[:4]
REACH = 40
SUPPORT = 3
GENERALISED, REMOVED = 0.75, 0.9
SPANS = "array<struct<kind:string,start:int,end:int,disclosure:double>>"
CHUNK = 10_000  # terms beside mentions that one row holds

# The patterns of personal data and their bounds. Runs are taken whole, so that no start is tried twice.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

_GAP = r"""[\x20\x09-\x0D.,;:!?()\[\]{}"<>]+"""  # between terms
_TERM = re.compile(r"""[^\x20\x09-\x0D.,;:!?()\[\]{}"<>]+""")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()),
                            ("start", pa.int32()), ("end", pa.int32())]))
_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]))


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        last = domain.end() if domain else at + 1
        if domain:
            yield at - local, last
        at = text.find("@", last)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, less nine where it has two digits; the sum ends in zero."""
    doubled = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(place of the kind in KINDS, start, end, the entity in one form) by kind and start."""
    found = [(0, a, b, text[a:b].lower()) for a, b in _emails(text)]
    found += [(1, m.start(), m.end(), ".".join(p.lstrip("0") or "0" for p in m.groups()))
              for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m.group()))
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if 8 <= len(digits) <= 15:
                found.append((3, m.start(), m.end(), digits))
    return found


def _hash(data: bytes) -> int:
    """The 64-bit hash that Spark's xxhash64 gives."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def beside(text: str, spans: list[tuple[int, int, int, str]], reach: int = REACH):
    """(entity, term, context, start, end) for the terms within reach of every mention, none that a mention covers."""
    covered = sorted((a, b) for _, a, b, _ in spans)
    terms, k, until = [], 0, -1
    for m in _TERM.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            until = max(until, covered[k][1])
            k += 1
        if until <= m.start():
            terms.append((m.start(), m.end(), m.group().encode().lower()))
    starts, hashes = [t[0] for t in terms], {}
    for kind, a, b, entity in spans:
        at = bisect_left(starts, a)
        near = terms[max(at - reach, 0):at + reach]
        context, own = _hash(b" ".join(t for _, _, t in near)), _hash(f"{KINDS[kind]}:{entity}".encode())
        for start, end, term in near:
            if term not in hashes:
                hashes[term] = _hash(term)
            yield own, hashes[term], context, start, end


def _marker(n_kept: int, names: list[str], reach: int):
    def mark(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, spans, entities, near, main = [], [], [], [], []
                for row, text in enumerate(part.column(n_kept)):
                    text = text.as_py() or ""
                    found = base_spans(text)
                    told = list(beside(text, found, reach)) if found else []
                    for k in range(0, max(len(told), 1), CHUNK):
                        rows.append(row)
                        main.append(k == 0)
                        spans.append([] if k else [(KINDS[kind], a, b, None) for kind, a, b, _ in found])
                        entities.append([] if k else sorted({_hash(f"{KINDS[kind]}:{e}".encode()) for kind, _, _, e in found}))
                        near.append(told[k:k + CHUNK])
                        if len(rows) >= 500:
                            yield batch_of(part, rows, main, spans, entities, near)
                            rows, spans, entities, near, main = [], [], [], [], []
                if rows:
                    yield batch_of(part, rows, main, spans, entities, near)

    def batch_of(part, rows, main, spans, entities, near):
        own = [c.take(pa.array(rows)) for c in part.columns[:n_kept]]
        return pa.RecordBatch.from_arrays(own + [
            pa.array(main), pa.array(spans, _BASE), pa.array(entities, pa.list_(pa.int64())), pa.array(near, _NEAR)],
            names=[*names, "main", "found", "entities", "near"])
    return mark


def marked(docs: DataFrame, keep: list[str], reach: int = REACH) -> DataFrame:
    """node, row (the kept columns), main, found (spans of the patterns), entities and near (terms beside mentions); very
    many terms go to further rows of the same node that are not main."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(True).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("node"), row.alias("row"), "text")
    schema = (f"node long, row {rows.schema['row'].dataType.simpleString()}, main boolean, found {SPANS}, "
              "entities array<long>, near array<struct<entity:long,term:long,context:long,start:int,end:int>>")
    return rows.mapInArrow(_marker(2, ["node", "row"], reach), schema)


def term_hashes(text: Column) -> Column:
    """The different terms of a text, letters A-Z in lower case, as 64-bit hashes."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.transform(F.split(lower, _GAP), lambda t: F.xxhash64(t)))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, least: float = GENERALISED) -> DataFrame:
    """(entity, term, disclosure) of the pairs that reach `least`, from docs (text) and their marked rows."""
    near = found.select("node", F.explode("near").alias("n")).select("node", "n.entity", "n.term", "n.context")
    together = (near.groupBy("entity", "term", "node").agg(F.min("context").alias("context"))
                .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count(F.lit(1)).alias("contexts")))
    pairs = written(together.filter(F.col("contexts") >= support).select("entity", "term", "joint"), "term-pairs")
    asked = pairs.select(F.col("term").alias("asked")).distinct()
    held = (docs.select(F.explode(term_hashes(F.col("text"))).alias("t")).join(asked, F.col("t") == F.col("asked"))
            .groupBy("t").agg(F.count(F.lit(1)).alias("with_term")))
    known = (found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("with_entity")))
    n = found.filter("main").count()
    reached = pairs.join(held, F.col("term") == F.col("t")).join(known, F.col("entity") == F.col("e"))
    information = F.log2(F.lit(float(n)) / F.col("with_entity"))
    told = 1 - F.log2(F.col("with_term") / F.col("joint")) / information
    return (reached.filter(F.col("with_entity") < n).select("entity", "term", F.round(told, 9).alias("disclosure"))
            .filter(F.col("disclosure") >= least))


def scanned(docs: DataFrame, keep: list[str] | None = None, reach: int = REACH, support: int = SUPPORT,
            least: float = GENERALISED) -> DataFrame:
    """The kept columns of docs (all) with spans: kind, start, end and, for terms, disclosure."""
    keep = docs.columns if keep is None else keep
    found = written(marked(docs, keep, reach), "marked")
    telling = disclosures(docs, found, support, least).select(
        F.col("entity").alias("e"), F.col("term").alias("t"), "disclosure")
    terms = (found.select("node", F.explode("near").alias("n")).select("node", "n.*")
             .join(telling, (F.col("entity") == F.col("e")) & (F.col("term") == F.col("t")))
             .groupBy("node", "start", "end").agg(F.max("disclosure").alias("disclosure"))
             .groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_list(
                 F.struct("start", "end", "disclosure"))).alias("terms")))
    typed = F.transform("terms", lambda s: F.struct(F.lit(KINDS[4]).alias("kind"), s["start"].alias("start"),
                                                    s["end"].alias("end"), s["disclosure"].alias("disclosure")))
    main = found.filter("main")
    some = (main.filter(F.size("entities") > 0).join(terms, F.col("node") == F.col("of"), "left")
            .select("row", F.concat("found", F.coalesce(typed, F.array().cast(SPANS))).alias("found")))
    every = main.filter(F.size("entities") == 0).select("row", "found").unionByName(some)
    return every.select(*[F.col("row")[c].alias(c) for c in keep if c != "spans"], F.col("found").alias("spans"))


def written_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def form(term: str) -> str:
    """What a term is generalised to."""
    return "[NUMBER]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(docs: DataFrame, removed: float = REMOVED, **options) -> DataFrame:
    """docs with sanitised texts and their spans (places in the text as it was): entities become their kind, terms their
    form, and terms that disclose too much go."""
    @F.pandas_udf("string")
    def put(texts: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series, told: pd.Series) -> pd.Series:
        out = []
        for text, a, b, kind, share in zip(texts, starts, ends, kinds, told):
            of = {(x, y): (k, d) for x, y, k, d in zip(a, b, kind, share)} if text is not None else {}

            def mark(start, end):
                kind, disclosure = of[start, end]
                if kind != KINDS[4]:
                    return f"[{kind.upper()}]"
                return "[...]" if disclosure >= removed else form(text[start:end])
            out.append(cut(text, a, b, mark))
        return pd.Series(out, dtype=object)

    found = scanned(docs, **options)
    parts = [F.col(f"spans.{name}") for name in ("start", "end", "kind", "disclosure")]
    return found.withColumn("text", put("text", *parts))
