import random
import zlib
from collections import defaultdict

from murmur.llm import sharding
from murmur.llm.store import new_folder
from tests.llm.helpers import docs, odd_rows, prose


def plain_pack(sizes, capacity, bins=None):
    """Best fit decreasing with a scan over all bins."""
    room, out = [capacity] * (bins or 0), {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[k]]
        if fits:
            b = min(fits)[1]
        elif bins is not None:
            return None
        else:
            b = len(room)
            room.append(max(capacity, sizes[k]))
        room[b] -= sizes[k]
        out[k] = b
    return [out[k] for k in range(len(sizes))]


def test_tree_packs_as_a_scan_does():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1, 100) for _ in range(rng.randrange(0, 60))]
        capacity = rng.randrange(20, 200)
        assert sharding.pack(sizes, capacity) == plain_pack(sizes, capacity)
        assert sharding.pack(sizes, capacity, 8) == plain_pack(sizes, capacity, 8)


def test_tree_stays_balanced():
    rooms = sharding.Rooms()
    for k in range(1000):
        rooms.put(k, k)
    assert rooms.top.tall <= 15
    for k in range(0, 1000, 2):
        assert rooms.take_tightest(k) == (k, k)
    assert rooms.top.tall <= 14 and rooms.take_tightest(1) == (1, 1) and rooms.take_tightest(1000) is None


def test_levels_are_near_equal():
    rng = random.Random(2)
    for sizes in ([rng.randrange(1, 1000) for _ in range(500)], [10_000] + [1] * 300, [5000, 4000] + [3] * 500, [], [7]):
        bins = sharding.level(sizes, 8)
        load = [0] * 8
        for s, b in zip(sizes, bins):
            load[b] += s
        big = sorted(sizes, reverse=True)[:7]
        mean = sum(sizes) / 8
        alone = sum(s > mean for s in big)
        others = sorted(load)[:8 - alone]
        if len(sizes) > 100:
            assert max(others) <= 1.01 * sum(others) / len(others) and min(others) >= 0.95 * max(others)


def check(rows, got):
    assert len(got) == len(rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots, texts, load = defaultdict(list), defaultdict(set), [0] * 8
    by = {}
    for r in rows:
        by[str(r[0]), zlib.crc32((r[1] or "").encode())] = r[1]
    for r in got:
        assert 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        texts[by[str(r.doc_id), r.text_crc32]].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())
    return load


def test_odd_rows_and_empty_tables(spark):
    rows = [r for r in odd_rows() if r[1] is not None]
    check(rows, sharding.assigned(docs(spark, rows)).collect())
    assert sharding.assigned(docs(spark, [])).count() == 0
    nulls = sharding.assigned(docs(spark, odd_rows())).collect()
    assert len(nulls) == len(odd_rows())


def test_bytes_are_near_equal(spark):
    rows = [(k, prose(k % 700, 5 + k % 60), "en", "a") for k in range(1500)]
    load = check(rows, sharding.assigned(docs(spark, rows)).collect())
    assert max(load) <= 1.01 * sum(load) / 8 and min(load) >= 0.99 * sum(load) / 8


def test_one_text_with_a_third_of_all_rows(spark):
    rows = [(k, prose(0 if k % 3 == 0 else k, 30), "en", "a") for k in range(1200)]
    load = sorted(check(rows, sharding.assigned(docs(spark, rows)).collect()))
    assert load[-1] >= 0.3 * sum(load) and load[-2] <= 1.02 * sum(load[:-1]) / 7


def test_written_shards_hold_every_row(spark):
    rows = [r for r in odd_rows() if r[0] != 5]
    path = new_folder(spark, "test")
    sharding.write_shards(docs(spark, rows), path)
    got = spark.read.parquet(path).select("doc_id", "text").collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(map(str, [r[:2] for r in rows]))


def test_written_once_although_ids_are_null_and_checksums_meet(spark):
    """Two texts with one CRC-32, both without an id."""
    first, second = next(pair for pair in meeting())
    rows = [(None, t, "en", "a") for t in (first, second, first, "other")] + [(1, first, "en", "a"), (1, first, "en", "a")]
    path = new_folder(spark, "test")
    table = docs(spark, rows).withColumnRenamed("fp", "group").withColumnRenamed("size", "group_")
    sharding.write_shards(table, path)
    back = spark.read.parquet(path)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str(r[:2]) for r in rows)
    assert {"group", "group_"} <= set(back.columns)


def meeting():
    seen = {}
    for k in range(400_000):
        text = f"text {k * 2654435761 % (1 << 32):x} {k}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            yield other, text


def test_slots_where_a_third_of_all_rows_are_alike(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_BITS", 5)
    rows = [(None, "same", "en", "a")] * 900 + [(k, prose(k, 8), "en", "a") for k in range(1800)]
    check_slots = defaultdict(list)
    got = sharding.assigned(docs(spark, rows)).collect()
    for r in got:
        check_slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in check_slots.values())


def test_no_shard_is_above_the_capacity(spark):
    rng = random.Random(9)
    rows = [(k, prose(k % 900, rng.choice([5, 20, 300])), "en", "a") for k in range(1500)]
    for capacity in (20_000, 60_000):
        got = sharding.assigned(docs(spark, rows), capacity=capacity).collect()
        load, groups = defaultdict(int), defaultdict(set)
        for r in got:
            load[r.shard] += r["size"]
            groups[r.text_crc32].add(r.shard)
        total = sum(load.values())
        assert len(got) == len(rows) and all(len(g) == 1 for g in groups.values())
        assert max(load.values()) <= capacity and len(load) <= 1.05 * total / capacity + 1
    alone = sharding.assigned(docs(spark, [(1, "x" * 500, None, None), (2, "y", None, None)]), capacity=100).collect()
    assert len({r.shard for r in alone}) == 2
    assert sharding.assigned(docs(spark, []), capacity=100).count() == 0
