import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from murmur.llm import kneser_ney as kn
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


class Plain:
    """The model by its definition, over dictionaries."""

    def __init__(self, texts):
        self.pairs, self.tokens = Counter(), Counter()
        for t in texts:
            of = ["<begin>", *words(t), "<end>"]
            self.pairs.update(zip(of, of[1:]))
            self.tokens.update(of[1:])
        self.context, self.left, self.right = Counter(), Counter(), defaultdict(list)
        for (u, w), c in self.pairs.items():
            self.context[u] += c
            self.left[w] += 1
            self.right[u].append(c)
        self.D, self.d = (self.discounts(Counter(x.values())) for x in (self.pairs, self.left))
        self.uniform = (sum(self.d[min(c, 3)] for c in self.left.values()) / len(self.pairs) if self.pairs else 1.0
                        ) / (len(self.tokens) + 1)

    @staticmethod
    def discounts(n):
        if not all(n[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]

    def lower(self, w):
        c = self.left[w]
        return max(c - self.d[min(c, 3)], 0) / max(len(self.pairs), 1) + self.uniform

    def chance(self, u, w):
        if not self.context[u]:
            return self.lower(w)
        c = self.pairs[u, w]
        rest = sum(self.D[min(x, 3)] for x in self.right[u]) / self.context[u]
        return max(c - self.D[min(c, 3)], 0) / self.context[u] + rest * self.lower(w)

    def score(self, text):
        of = ["<begin>", *words(text), "<end>"]
        n, v = sum(self.tokens.values()), len(self.tokens)
        return (len(of) - 1, sum(self.tokens[w] > 0 for w in of[1:]),
                sum(math.log10((self.tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in of[1:]),
                sum(math.log10(self.chance(u, w)) for u, w in zip(of, of[1:])))


def corpus():
    rng, nouns = random.Random(4), [f"noun{k}" for k in range(60)]
    rows = list(odd_rows())
    for k in range(300):
        text = " ".join(f"The {rng.choice(nouns[:10 + k % 50])} of a {rng.choice(nouns)}." for _ in range(1 + k % 9))
        rows.append((100 + k, text, "en", "a"))
    return rows


def test_equals_the_definition_and_beats_the_base(spark):
    rows = corpus()
    df = docs(spark, rows)
    out = kn.held_out(kn.F.col("doc_id"))
    model = kn.trained(df.filter(~out))
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows}
    plain = Plain([r[1] for r in rows if not held[r[0]]])
    assert model.totals["tokens"] == sum(plain.tokens.values()) and model.words == len(plain.tokens)
    got = kn.scored(df.withColumn("held_out", out), model, ("doc_id", "held_out", "source")).collect()
    assert len(got) == len(rows)
    want = sorted((r[0] if r[0] is not None else -1, held[r[0]], *plain.score(r[1])) for r in rows)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score)
                  for r in got)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])
    tests = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in tests) > sum(r.base_score for r in tests)


def test_chances_sum_to_one(spark):
    rows = corpus()
    plain = Plain([r[1] for r in rows])
    for u in ["the", "of", "<begin>", "noun3", "unheard"]:
        total = sum(plain.chance(u, w) for w in plain.tokens) + plain.chance(u, "unknown word")
        assert total == pytest.approx(1)


def test_split_words_and_small_blocks_give_the_same(spark, monkeypatch):
    rows = corpus()
    df = docs(spark, rows)
    want = sorted((str(r.doc_id), round(r.score, 6)) for r in kn.scored(df, kn.trained(df)).collect())
    monkeypatch.setattr(kn, "HOT_SHARE", 2.0)  # no word is split
    monkeypatch.setattr(kn, "TOKENS", 500)
    monkeypatch.setattr(kn, "SCORED_TOKENS", 300)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in kn.scored(df, kn.trained(df)).collect()) == want


def test_shards_grow_with_the_text_and_give_the_same(spark):
    df = docs(spark, corpus())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = sum(len(r[1] or "") for r in corpus()) // (3 * least)
    few, many = kn.trained(df), kn.trained(df, chars=chars)
    assert len(few.shards) == least and 3 * least <= len(many.shards) <= 3 * least + 2
    want = sorted((str(r.doc_id), round(r.score, 6)) for r in kn.scored(df, few).collect())
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in kn.scored(df, many).collect()) == want
    assert kn.shard_count(docs(spark, [])) == least


def test_no_training_documents_and_no_rows(spark):
    df = docs(spark, odd_rows())
    model = kn.trained(df.filter("doc_id > 1000000"))
    got = kn.scored(df, model).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert kn.scored(docs(spark, []), model).count() == 0
