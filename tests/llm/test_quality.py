import random
import re
from collections import Counter

from murmur.llm import quality
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + o for k, w in enumerate(windows) if often[w] >= 2 for o in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_counts_equal_brute_force(spark):
    more = [(20 + k, t, "en", "a") for k, t in enumerate([
        "a b c d e a b c d e", "a b c d e x a b c d e", "a a a a a a", "a a a a a", "x\ny\nx\n \n \nx", "# * $ % & | < >",
        prose(5, 40) + " " + prose(6, 9) + " " + prose(5, 40), "a b c d e f g a b c d e f g " * 3])]
    rows = odd_rows() + more
    got = quality.features(docs(spark, rows), ("doc_id", "lang", "source", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in quality.BASE) == brute(r.text), r.text[:50]
        n, repeat = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)


def test_steps_keep_seven_digits(spark):
    values = [0, 1, 5, 127, 128, 129, 255, 256, 1000, 123456789, 2 ** 40 + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(quality.step(quality.F.col("v"))).collect()
    for v, (low,) in zip(values, got):
        shift = max(v.bit_length() - 7, 0)
        assert low == (v >> shift) << shift and low <= v <= low * 65 / 64


def test_thresholds_follow_language_and_source(spark):
    rows = [(k, prose(k, 60), "en", "plain") for k in range(80)]
    rows += [(100 + k, " ".join(f"{w} |" for w in prose(k, 30).split()), "en", "tables") for k in range(80)]
    rows += [(300, " ".join(f"{w} |" for w in prose(7, 30).split()), "en", "plain"),
             (301, " ".join(f"{w} |" for w in prose(7, 30).split()), "xx", "new")]
    got = {r.doc_id: r.kept for r in quality.judged(docs(spark, rows)).collect()}
    assert all(got[k] for k in range(80)) and all(got[100 + k] for k in range(80))  # usual in its own source
    assert not got[300]
    assert set(got) == {r[0] for r in rows}


def test_sketches_merge_by_adding(spark):
    parts = [docs(spark, [(k, prose(k, 20 + k), "en", "a") for k in range(a, b)]) for a, b in ((0, 30), (30, 70))]
    one = [quality.sketches(quality.features(p)) for p in parts]
    merged = one[0].unionByName(one[1]).groupBy("lang", "source", "measure", "step").sum("n").collect()
    both = quality.sketches(quality.features(parts[0].unionByName(parts[1]))).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, both))


def test_a_text_of_single_letters_is_rejected(spark):
    rows = [(k, prose(k, 60), "en", "a") for k in range(80)]
    letters = random.Random(4).choices("abcdefghijklmnopqrstuvwxyz", k=120)
    rows += [(200, " ".join(letters), "en", "a"), (201, " ".join(x + "ation" for x in letters[:30]), "en", "a"),
             (202, "We go up to see it as the sun sets over old hill towns", "en", "a")]
    kept = {r.doc_id for r in quality.accepted(docs(spark, rows)).collect()}
    assert kept == {*range(80), 201, 202}


def test_accepted_passes_rows_on(spark):
    rows = odd_rows() + [(30 + k, prose(k, 60), "en", "a") for k in range(60)]
    df = docs(spark, rows)
    out = quality.accepted(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert [r.doc_id for r in kept].count(5) == 3 and all(r["size"] == -7 for r in kept)
    assert not {1, 2, 3, 8, 9, 10} & {r.doc_id for r in kept}
    assert quality.accepted(docs(spark, [])).count() == 0
    assert quality.judged(docs(spark, [])).count() == 0
