import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, node string, i string"


def table(spark, rows):
    return spark.createDataFrame([(v, e, label, "x", "y", "z") for v, e, label in rows], SCHEMA)


def items(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return df.select("vec_id", moved.alias("label"), hn.quantised(F.col("embedding")).alias("vector"),
                     (F.col("vec_id") % 20 == 0).alias("anchor"))


def brute(rows, every=20, positives=5, negatives=10):
    """All scores by plain integers."""
    good = []
    for v, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if v is not None and v % 7 == 0 else label
        good.append((v, [math.floor(256.0 * x) for x in e], label))
    out = []
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for n, (v, q, label) in enumerate(good):
        if v is None or v % every:
            continue
        scores = [(sum(a * b for a, b in zip(q, p)), w, other) for m, (w, p, other) in enumerate(good)
                  if m != n and len(p) == len(q)]
        same = sorted((s[:2] for s in scores if s[2] == label), key=key)[:positives]
        for p, w in same:
            fit = sorted((s[:2] for s in scores if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=key)
            out += [(v, w, r + 1, x, p, s) for r, (s, x) in enumerate(fit[:negatives])]
    return sorted(out, key=str)


def result(df):
    return sorted([tuple(r)[:6] for r in df.collect()], key=str)


def spread(n, seed, d=12, labels=4, noise=0.5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, d))
    return [(k, (centre[k % 9] + noise * rng.normal(size=d)).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("noise,probe,cell_rows", [(0.1, 40, 8), (0.5, 40, 8), (3.0, 1, 30), (0.5, 4096, 1024)])
def test_equals_all_scores(spark, noise, probe, cell_rows):
    rows = spread(700, int(noise * 10), noise=noise)
    got = hn.mined(items(table(spark, rows)), cell_rows=cell_rows, probe=probe)
    assert result(got) == brute(rows) and len(brute(rows)) > 100


def test_the_second_round_leaves_cells_out_where_groups_are_dense(spark):
    rows = spread(900, 3, noise=0.05)
    placed, index = hn.indexed(items(table(spark, rows)), cell_rows=10)
    sizes = index.sizes[12]
    q = hn._rows([placed.filter("vec_id = 0").first().q], 12)[0]
    cells = [c for c in index.visits(q, 12)]
    assert len(cells) == (sizes > 0).sum() and sum(sizes[i, j] for _, _, i, j in cells) == len(rows)
    assert all(a[0] >= b[0] for a, b in zip(cells, cells[1:]))
    members = {(r.i, r.j): [] for r in placed.select("i", "j").distinct().collect()}
    for r in placed.collect():
        members[r.i, r.j].append(hn._rows([r.q], 12)[0] @ q)
    assert all(lower <= min(members[i, j]) and max(members[i, j]) <= upper for upper, lower, i, j in cells)
    lows, highs = [int(q @ q) // 2], [int(q @ q)]
    second = list(index.asked(q, 12, False, lows, highs, {}, 1))
    assert len(second) < len(cells) / 2


def odd():
    nan, inf = float("nan"), float("inf")
    e = [0.5, -0.25, 1.0, 0.1]
    rows = [(k, e, k % 3) for k in range(0, 60, 4)] + [(k, [x + 0.001 * k for x in e], k % 2) for k in range(60, 90)]
    rows += [(20, e, 1), (20, e, 1), (None, e, 1), (None, e, 0), (None, None, None), (100, None, 1), (101, e, None),
             (120, [], 1), (121, [], 1), (122, [], 0), (140, [1.0], 1), (141, [1.0], 1), (142, [0.5], 0),
             (160, [nan, 1.0, 1.0, 1.0], 1), (180, [inf, 1.0, 1.0, 1.0], 1), (200, [None, 1.0, 1.0, 1.0], 1),
             (220, [0.0] * 4, 1), (240, [-x for x in e], 1), (260, [1e4, 1e5, 1e6, 1e7], 1), (261, [9e3, 1e5, 1e6, 1e7], 1),
             (262, [5e3, 5e4, 5e5, 5e6], 0)]
    return rows


def test_odd_rows_equal_all_scores(spark):
    for cell_rows, probe in ((2, 3), (1024, 4096)):
        got = hn.mined(items(table(spark, odd())), cell_rows=cell_rows, probe=probe)
        assert result(got) == brute(odd())
    assert any(r[0] == 120 for r in brute(odd())) and any(r[0] == 260 for r in brute(odd()))


def test_scores_beyond_a_long_are_bounded(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [1e20, 1.0], 0)]
    got = hn.mined(items(table(spark, rows)))
    assert all(r.positive_score == 2 ** 63 - 1 for r in got.collect())


def test_empty_and_rows_without_ids(spark):
    assert hn.mined(items(table(spark, []))).count() == 0
    assert hn.mined(items(table(spark, [(None, [1.0], 1)] * 5))).count() == 0


def test_a_third_of_all_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 50)
    monkeypatch.setattr(hn, "ASKS", 7)
    rows = spread(400, 5)
    rows += [(1000 + k, rows[0][1], k % 2) for k in range(220)]
    got = hn.mined(items(table(spark, rows)), cell_rows=20, probe=30)
    assert result(got) == brute(rows)
