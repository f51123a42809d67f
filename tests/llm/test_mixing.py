import hashlib
import re

import pytest

from murmur.llm import mixing
from tests.llm.helpers import docs, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, share, epochs):
    """Clamps sources one round after the other."""
    left, capped, total = dict(sizes), {}, share * sum(sizes.values())
    while left:
        level = (total - sum(capped.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > epochs * sizes[s]]
        if not over:
            return capped | {s: level * weights[s] for s in left}
        for s in over:
            capped[s] = epochs * sizes[s]
            del left[s]
    return capped


def brute(rows, seed="murmur"):
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    target = water(total, weight, 1.5, 2)
    out = []
    for s in names:
        goal = int(target[s] + 0.5)
        whole = goal // total[s] if total[s] else 0
        rest = goal - whole * total[s]
        mine = sorted((hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), n, r[0])
                      for n, r in zip(size, rows) if r[3] == s)
        for h, n, i in sorted(set(mine), key=lambda m: m[:2]):
            copies = mine.count((h, n, i))
            gives = min(max(rest, 0), n * copies)
            rest -= n * copies
            out += [(i, n, total[s], round(target[s], 6), n * whole + gives // copies)] * copies
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()], key=str)


def test_equals_brute_force_on_odd_rows(spark):
    assert result(mixing.mixed(docs(spark, odd_rows()))) == brute(odd_rows())


def test_equals_brute_force_with_a_hot_source(spark):
    rows = [(k, prose(k, 5 + k % 90), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(400)]
    got = mixing.mixed(docs(spark, rows))
    assert result(got) == brute(rows)
    by = {}
    for r in got.collect():
        by.setdefault((r.source, r.target), []).append(r.taken)
        assert 0 <= r.taken <= 2 * r["size"]
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1


def test_sources_without_words_and_empty_tables(spark):
    assert mixing.mixed(docs(spark, [])).count() == 0
    got = mixing.mixed(docs(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_repeated_texts_hold_the_words_taken(spark):
    rows = [(k, prose(k, 30 + k) + " \n", "en", f"s{k % 3}") for k in range(60)]
    mix = mixing.mixed(docs(spark, rows))
    taken = {r.doc_id: r.taken for r in mix.collect()}
    texts = {}
    out = mixing.repeated(mix)
    assert set(out.columns) == set(mix.columns) - set(mixing.RESULT)
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
        whole = rows[r.doc_id][1]
        assert whole.startswith(r.text)
    for i, n in taken.items():
        assert sum(len(WORD.findall(t)) for t in texts.get(i, [])) == n


def test_another_seed_takes_others_and_weights_must_be_positive(spark):
    df = docs(spark, [(k, prose(k, 40), "en", f"s{k % 4}") for k in range(200)])
    assert result(mixing.mixed(df)) == result(mixing.mixed(df))
    assert result(mixing.mixed(df)) != result(mixing.mixed(df, seed="other"))
    with pytest.raises(ValueError):
        mixing.mixed(df, weights=(1, 0))
