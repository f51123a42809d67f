import random
import re

import numpy as np
import xxhash

from murmur.llm import simhash
from murmur.llm.graph import components
from tests.llm.helpers import docs, odd_rows, prose


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(nodes):
    """nodes: (doc_id, fingerprint) -> least id of each row's component."""
    parent = list(range(len(nodes)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(nodes):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(nodes))]


def near_copies(n):
    rng, rows = random.Random(3), []
    for k in range(n):
        words = prose(k % 9, 300 + k % 9).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 - k, " ".join(words), "en", "a"))
    return rows


def test_fingerprints_equal_brute_force():
    for text in [r[1] for r in odd_rows()] + ["a b", "A b C", "a b c d", prose(4, 200_00)[:9000], "É é E"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_groups_equal_all_pairs(spark):
    rows = odd_rows() + near_copies(120) + [(2000 + k, prose(50 + k, 60), "en", "b") for k in range(60)]
    got = [(r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.grouped(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    want = brute_groups([(r[0], brute_fingerprint(r[1])) for r in rows])
    expected = [(r[0], brute_fingerprint(r[1]), c) for r, c in zip(rows, want)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert simhash.grouped(docs(spark, [])).count() == 0


def test_index_finds_every_link_of_dense_values():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    values = set()
    for c in centres.tolist():
        for _ in range(60):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
    values = np.array(sorted(values), np.uint64)
    values = values[np.argsort(simhash.gray_rank(values))]
    n = len(values)
    found = set()
    for i, j in simhash.search(simhash.hierarchy(values), np.arange(n), np.full(n, n)):
        found |= set(zip(i.tolist(), j.tolist()))
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(apart <= 2))) if i < j}
    assert found == want


def test_gray_rank_orders_the_code():
    codes = np.array([k ^ (k >> 1) for k in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


def test_links_cover_one_large_family(spark):
    base = 0x0123456789ABCDEF
    family = [base] + [base ^ (1 << a) for a in range(64)] + [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    signed = [v - (1 << 64) if v >> 63 else v for v in family]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    rooted = components(simhash.links(df)).collect()
    assert {r.node for r in rooted} == set(signed) and {r.root for r in rooted} == {min(signed)}


def test_a_large_node_is_split_and_loses_no_link(spark):
    """A third of the fingerprints share 32 bits: their node is dealt out by parts, with the links of all pairs."""
    rng = np.random.default_rng(7)
    family = {0x0123456700000000 | int(x) for x in rng.integers(0, 2 ** 32, 150)}
    family |= {v ^ (1 << int(b)) ^ (1 << int(c)) for v in list(family)[:60] for b, c in [rng.integers(0, 32, 2)] if b != c}
    others = {int(x) for x in rng.integers(0, 2 ** 63, 300)}
    others |= {v ^ (1 << int(rng.integers(0, 64))) for v in list(others)[:60]}
    values = sorted(family | others)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    dealt = simhash.nodes(df, 40).groupBy("mask", "key").count().collect()
    assert max(r["count"] for r in dealt) <= 40 and any(r["mask"] >= len(simhash.MASKS) for r in dealt)
    got = {r.node & (2 ** 64 - 1): r.root for r in components(simhash.links(df, 40)).collect()}
    want = brute_groups([(k, v) for k, v in enumerate(values)])
    linked = {w for w in want if want.count(w) > 1}
    assert {v for v, w in zip(values, want) if w in linked} == set(got)
    for w in linked:
        assert len({got[v] for v, of in zip(values, want) if of == w}) == 1
    assert len(set(got.values())) == len(linked)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = odd_rows() + near_copies(60)
    df = docs(spark, rows)
    out = simhash.first_of_groups(df)
    assert out.columns == df.columns
    kept = out.collect()
    groups = brute_groups([(k, brute_fingerprint(r[1])) for k, r in enumerate(rows)])
    of = {}
    for k, r in enumerate(rows):
        of.setdefault((r[0], r[1]), set()).add(groups[k])
    assert len(kept) == len(set(groups))
    assert sorted(g for r in kept for g in of[(r.doc_id, r.text)]) == sorted(set(groups))
