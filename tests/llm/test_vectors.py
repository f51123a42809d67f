import numpy as np
import pytest

from murmur.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", "y") for i, e, label in rows], SCHEMA)


def brute(rows, cosine=0.93):
    def good(e):
        return e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)

    n, parent = len(rows), list(range(len(rows)))
    links = [0] * n

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    unit = [None] * n
    for k, (_, e, label) in enumerate(rows):
        if good(e) and label is not None:
            v = np.array(e, np.float32).astype(float)
            unit[k] = v / np.linalg.norm(v)
    for i in range(n):
        for j in range(i):
            if (unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
                    and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted([(r[0], links[k], least.get(root(k)), r[0] is not None and r[0] == least.get(root(k)))
                   for k, r in enumerate(rows)], key=str)


def result(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def families(n, size, spread, seed=1, d=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre = rng.normal(size=d)
        for _ in range(rng.integers(1, size + 1)):
            out.append((centre + rng.normal(size=d) * spread).astype(np.float32).tolist())
    return out


def odd():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [0.0] * 4, 1), (903, [1.0, nan, 0.0, 0.0], 1), (904, [1.0, None, 0.0, 0.0], 1),
            (905, [inf, 1.0, 0.0, 0.0], 1), (906, [1.0, 2.0, 3.0, 4.0], None), (907, [1.0, 2.0, 3.0, 4.0], 1),
            (907, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (908, [2.0, 4.0, 6.0, 8.0], 1),
            (909, [-0.0, 0.0, 1e-30, 0.0], 1), (910, [0.0, -0.0, 1e-30, 0.0], 1), (911, [1e38, 1e38, 0.0, 0.0], 1),
            (912, [1.0, 1.0, 0.0, 0.0], 1), (913, [1.0, 1.0], 1), (914, [1.0, 1.0], 2)]


def test_equals_brute_force(spark):
    rows = [(k, e, k % 3) for k, e in enumerate(families(120, 6, 0.12))] + odd()
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(40)]  # copies
    assert result(vectors.grouped(table(spark, rows))) == brute(rows)


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    rows = [(k, e, 1) for k, e in enumerate(families(4, 60, 0.1, seed=3))]
    assert result(vectors.grouped(table(spark, rows))) == brute(rows)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = []
    for k, v in enumerate(base):
        rows.append((2 * k, v.astype(np.float32).tolist(), k % 4))
        away = rng.normal(size=64)
        away -= (away @ v) * v
        away /= np.linalg.norm(away)
        c = rng.uniform(0.93, 0.96)  # close to the threshold, where the index is weakest
        rows.append((2 * k + 1, (c * v + np.sqrt(1 - c * c) * away).astype(np.float32).tolist(), k % 4))
    got, want = result(vectors.grouped(table(spark, rows))), brute(rows)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there >= 1300 and found <= there and found >= 0.9 * there
    by = {w[0]: w[1] for w in want}
    assert all(g[1] <= by[g[0]] for g in got)


@pytest.mark.parametrize("d, cosine", [(32, 0.95), (64, 0.94), (64, 0.98)])
def test_recall_of_a_dense_group(spark, d, cosine):
    """A third of the rows of a label are near one centre; their links are counted in matrices."""
    rng = np.random.default_rng(d)
    centre = rng.normal(size=d)
    centre /= np.linalg.norm(centre)
    noise = rng.normal(size=(1400, d))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    all_rows = np.vstack([np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * noise, rng.normal(size=(2800, d))])
    all_rows = all_rows.astype(np.float32)[rng.permutation(4200)]
    unit = all_rows.astype(float) / np.linalg.norm(all_rows.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r[0]: r[1] for r in result(vectors.grouped(table(spark, [(k, v.tolist(), 1) for k, v in enumerate(all_rows)])))}
    found = np.array([got[k] for k in range(4200)])
    assert want.sum() > 100_000 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


@pytest.mark.parametrize("common, cones", [(0.75, 1), (0.85, 1), (0.75, 3)])
def test_vectors_with_a_common_direction(spark, monkeypatch, common, cones):
    """Vectors around one direction, or a few, as text encoders give them: links are found, and lists stay short."""
    rng = np.random.default_rng(cones)
    n, d = 2500, 64

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    base = unit(np.sqrt(common) * unit(rng.normal(size=(cones, d)))[rng.integers(0, cones, n)]
                + np.sqrt(1 - common) * unit(rng.normal(size=(n, d))))
    away = rng.normal(size=(n, d))
    away = unit(away - (away * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(0.93, 0.99, size=(n, 1))
    all_rows = np.vstack([base, c * base + np.sqrt(1 - c * c) * away]).astype(np.float32)[rng.permutation(2 * n)]
    exact = unit(all_rows.astype(float))
    want = (exact @ exact.T >= 0.93).sum(axis=1) - 1
    df = table(spark, [(k, v.tolist(), 1) for k, v in enumerate(all_rows)])
    got = {r[0]: r[1] for r in result(vectors.grouped(df))}
    found = np.array([got[k] for k in range(2 * n)])
    assert want.sum() >= 4900 and (found <= want).all() and found.sum() >= 0.95 * want.sum()

    entries = df.selectExpr("vec_id AS node", "embedding AS vector", "xxhash64(label) AS place")
    count = vectors.pivot_count(2 * n)
    ref = vectors.references(entries, count)[d]
    places = np.full(2 * n, next(iter(ref.centres)))
    near = vectors.nearest(vectors.centred(exact, places, ref.centres, ref.centre), ref.pivots)
    lists = np.bincount(np.concatenate([vectors.lists_of(row, vectors.SHARED) for row in near]))
    assert len(ref.pivots) == count and len(near) == 2 * n
    assert (lists.astype(float) ** 2).sum() < 0.75 * (2 * n) ** 2  # all in one list: 1 and more


@pytest.mark.parametrize("cosine", [0.9, 0.95])
def test_recall_of_a_dense_label(spark, cosine):
    rng = np.random.default_rng(11)
    centre, noise = vectors._unit(rng.normal(size=(1, 64))), vectors._unit(rng.normal(size=(1200, 64)))
    all_rows = (np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * noise).astype(np.float32)
    exact = vectors._unit(all_rows)
    want = (exact @ exact.T >= 0.93).sum(axis=1) - 1
    got = result(vectors.grouped(table(spark, [(k, v.tolist(), 1) for k, v in enumerate(all_rows)])))
    found = np.array([n for _, n in sorted((r[0], r[1]) for r in got)])
    assert want.sum() > 1000 and (found <= want).all() and found.sum() >= 0.95 * want.sum()


def test_centring_keeps_a_dense_label_together():
    rng = np.random.default_rng(5)
    centre, noise = vectors._unit(rng.normal(size=(1, 32))), vectors._unit(rng.normal(size=(400, 32)))
    dense = vectors._unit(np.sqrt(0.95) * centre + np.sqrt(0.05) * noise)
    taken = vectors.centre_of(dense)
    assert abs(((dense - taken) ** 2).sum(axis=1).mean() - vectors.SPREAD) < 0.01
    wide = vectors._unit(np.sqrt(0.5) * centre + np.sqrt(0.5) * noise)
    assert np.allclose(vectors.centre_of(wide), wide.mean(axis=0))
    one = vectors.centred(dense[:1], np.array([7]), {7: dense[0]}, np.zeros(32))
    assert np.allclose(one, dense[:1])


def test_lists_hold_every_pair_that_shares_enough():
    rng = np.random.default_rng(6)
    rows = [rng.permutation(14)[:10].astype(np.int32) for _ in range(60)]
    for a in rows:
        for b in rows:
            both = set(a.tolist()) & set(b.tolist())
            if len(both) >= 4:
                assert min(both) in vectors.lists_of(a, 4) and min(both) in vectors.lists_of(b, 4)
    assert vectors.lists_of(np.array([3], np.int32), 4).tolist() == [3]


def test_empty_and_unusable_tables(spark):
    assert vectors.grouped(table(spark, [])).count() == 0
    rows = [(1, None, None), (2, [0.0], 1)]
    assert result(vectors.grouped(table(spark, rows))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_number_of_pivots_grows_with_the_root():
    assert vectors.pivot_count(0) == vectors.LEAST_PIVOTS
    assert vectors.pivot_count(10_000) == 200 and vectors.pivot_count(10 ** 12) == vectors.MOST_PIVOTS


@pytest.mark.parametrize("n", [3, 50])
def test_nearest_pivots_in_order(n):
    rng = np.random.default_rng(n)
    x, p = vectors._unit(rng.normal(size=(20, 8))), vectors._unit(rng.normal(size=(n, 8)))
    got = vectors.nearest(x, p, 5)
    for row, near in zip(x, got):
        assert near.tolist() == sorted(range(n), key=lambda k: -(row @ p[k]))[:5]
