import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from murmur.llm import packing
from murmur.llm.tokens import SPECIAL, encoder
from tests.llm.helpers import docs, odd_rows, prose

TOKENIZER = Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def true_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def ids_of(text):
    assert np.frombuffer(encoder().raw(text), "<u2").tolist() == encoder().ids(text).tolist()
    return encoder().ids(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0\u2003\u3000a1'.,-é漢😀"), st.characters(
    exclude_categories=["Cs"])), max_size=60))
def test_ids_equal_the_library(text):
    assert ids_of(text) == true_ids(text)


def test_ids_of_odd_texts_equal_the_library():
    for text in [r[1] for r in odd_rows()] + ["it's we'll  two   spaces ", f"a {SPECIAL} b", "x" * 3000, " ", "\n\n a\n b"]:
        assert ids_of(text) == true_ids(text)


def check(rows, pieces, width=packing.WIDTH):
    """Every id in one piece, sequences without gaps and with little padding."""
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(true_ids(r[1]) + [1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        of = np.frombuffer(p.ids, "<u4").tolist()
        assert len(of) == p.length > 0
        by_doc[p.doc_id].append((p.start, p.doc_tokens, of))
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        # Rows that share an id: their pieces, put together by total and start, give the same multiset of ids.
        assert sorted(i for _, _, of in parts for i in of) == sorted(i for t in ids[doc] for i in t)
        if len(ids[doc]) == 1:
            parts.sort()
            at = 0
            for start, n, of in parts:
                assert start == at and n == len(ids[doc][0]) and of == ids[doc][0][start:start + len(of)]
                at += len(of)
            assert at == len(ids[doc][0])
    short = 0
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        total = sum(n for _, n in parts)
        assert total <= width
        short += total < width
    return short


def test_round_trip_of_odd_rows(spark):
    rows = odd_rows()
    assert check(rows, packing.packed(docs(spark, rows)).collect()) <= 4


def test_round_trip_and_padding(spark):
    rows = [(k, prose(k % 150, 20 + 37 * (k % 40)), "en", "a") for k in range(400)]
    pieces = packing.packed(docs(spark, rows)).collect()
    assert check(rows, pieces) <= 4  # one sequence of each task at most


def test_one_text_with_a_third_of_all_rows(spark, monkeypatch):
    rows = [(k, prose(0 if k % 3 == 0 else k, 70), "en", "a") for k in range(300)]
    check(rows, packing.packed(docs(spark, rows)).collect())


def test_neighbours_share_terms():
    rng = np.random.default_rng(1)
    topics = [rng.integers(300, 60000, (40, 3)) for _ in range(8)]  # words of three ids
    tails = [(0, topics[k % 8][rng.integers(0, 40, 130)].ravel().astype("<u2")) for k in range(200)]
    same = other = 0
    for seed, window in packing.fill(tails, 2048, True):
        kinds = [t % 8 for t, _, _ in window]
        same += sum(k == seed % 8 for k in kinds[1:])
        other += sum(k != seed % 8 for k in kinds[1:])
    assert same > 5 * other


def test_fill_takes_every_id_once_and_hands_on_what_is_left():
    rng = np.random.default_rng(2)
    tails = [(0, rng.integers(0, 50, n).astype("<u2")) for n in rng.integers(1, 300, 120)]
    seen = [np.zeros(len(t), int) for _, t in tails]
    rest = 0
    for seed, window in packing.fill(tails, 300, False):
        n = 0
        for t, a, b in window:
            seen[t][a:b] += 1
            n += b - a
        rest += seed is None
        assert n == 300 or seed is None
    assert rest <= 1 and all((s == 1).all() for s in seen)


def test_bm25_scores_equal_the_formula():
    tails = [np.array(t, "<u2") for t in ([1, 2, 3, 4], [1, 2, 9, 1, 2], [3, 4, 7], [8, 8, 8], [5])]
    index = packing.Index(tails)
    terms = [[(a, b) for a, b in zip(t.tolist(), t.tolist()[1:])] for t in tails]
    df = {p: sum(p in t for t in terms) for t in terms for p in t}
    mean = np.mean([len(t) for t in tails])
    for q, query in enumerate(terms):
        for d, t in enumerate(terms):
            want = sum(np.log1p((len(tails) - df[p] + 0.5) / (df[p] + 0.5)) * t.count(p) * 2.2
                       / (t.count(p) + 1.2 * (0.25 + 0.75 * len(tails[d]) / mean))
                       for p in set(query) if df[p] > 1 and p in t)
            assert index.scores(tails[q])[d] == pytest.approx(want)


def test_checksums_and_empty_tables(spark):
    assert packing.packed(docs(spark, [])).count() == 0
    p = packing.packed(docs(spark, [(1, "a b", "en", "a")])).first()
    want = np.array(true_ids("a b") + [1], "<u4").tobytes()
    assert zlib.crc32(p.ids) == zlib.crc32(want)
