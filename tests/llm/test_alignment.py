import hashlib
import random
from collections import Counter

import pytest

from murmur.llm import alignment
from tests.llm.helpers import docs, odd_rows, prose


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by the libraries that their files are made for, and the bytes of each id."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves as characters
    letters = {chr(k): k for k in kept} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in kept)}

    def a_bytes(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(texts, plain):
    """Byte by byte: which token of each side owns it."""
    a, b, a_bytes, b_bytes = plain
    parsed = []
    for text in texts:
        of_a = of_b = []
        if text:
            of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, of_a)) != whole or b"".join(map(b_bytes, of_b)) != whole:
                of_a = of_b = []
        own_a = [k for k, i in enumerate(of_a) for _ in a_bytes(i)]
        own_b = [k for k, i in enumerate(of_b) for _ in b_bytes(i)]
        links = sorted(set(zip(own_a, own_b)))
        groups, last = [], (0, 0)
        for at in range(1, len(own_a) + 1):
            if at == len(own_a) or own_a[at] != own_a[at - 1] and own_b[at] != own_b[at - 1]:
                now = (own_a[at - 1] + 1, own_b[at - 1] + 1)
                groups.append(",".join(map(str, of_a[last[0]:now[0]])) + "|" + ",".join(map(str, of_b[last[1]:now[1]])))
                last = now
        parsed.append((of_a, of_b, groups, [(of_a[x], of_b[y]) for x, y in links]))
    count = Counter(link for p in parsed for link in p[3])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(len(x), len(y), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for x, y, groups, links in parsed]


def strange():
    rng = random.Random(3)
    letters = list("abc  \n\t\r0123é😀ß漢字‍▁'.,<>\x00\x1c") + ["the ", " of", "<|endoftext|>", "</s>", "<s>", "<0x41>", "ing"]
    return ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(300)]


def test_equals_byte_by_byte(spark, plain):
    texts = [r[1] for r in odd_rows()] + strange() + [prose(k, 150) for k in range(40)] + [prose(1, 150)] * 5
    texts += ["  two", "x  ", "\n\n", " ", "▁", "a▁b", "<unk>", "日本語のテキスト " * 40]
    table = docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    got = {r.doc_id: tuple(r)[1:] for r in alignment.compared(table).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    for k, want in enumerate(brute(texts, plain)):
        assert got[k] == want, texts[k]
    assert sum(1 for g in got.values() if g[0]) > 150 and sum(1 for g in got.values() if not g[0]) > 5


@pytest.mark.parametrize("seed", range(6))
def test_runs_cut_where_both_end(seed):
    rng = random.Random(seed)
    for _ in range(200):
        n = rng.randrange(1, 400)
        cut = rng.choice([0.01, 0.2, 0.9])
        a = sorted({n, *(k for k in range(1, n) if rng.random() < 0.7)})
        b = sorted({n, *(k for k in range(1, n) if (k in a) != (rng.random() < cut))})
        ends, links = [], []
        for i, j, count, path in alignment.runs(a, b):
            if path is None:
                ends += a[i:i + count]
                assert a[i:i + count] == b[j:j + count]
                links += [(i + k, j + k) for k in range(count)]
            else:
                for step in path:
                    links.append((i, j))
                    i, j = i + (step & 1), j + (step >> 1)
                ends.append(a[i - 1])
        assert ends == [x for x in a if x in set(b)]
        begin = lambda e, k: e[k - 1] if k else 0
        assert links == [(i, j) for i in range(len(a)) for j in range(len(b))
                         if begin(a, i) < b[j] and begin(b, j) < a[i]]


def test_long_stretches_take_few_comparisons():
    class Counting(list):
        reads = 0

        def __getitem__(self, k):
            Counting.reads += 1
            return super().__getitem__(k)

    ends = Counting(range(1, 100_001))
    assert [r[2] for r in alignment.runs(ends, list(ends))] == [100_000] and Counting.reads < 40


def test_shards_and_parts_change_nothing(spark, monkeypatch):
    table = docs(spark, odd_rows() + [(50 + k, prose(k, 60), "en", "a") for k in range(30)])
    names = ["n_links", "n_best", "count_sum", "groups_sha256"]
    whole = sorted(map(tuple, alignment.compared(table).select("doc_id", *names).collect()), key=str)
    links = alignment.written(alignment.aligned(table), "aligned")
    monkeypatch.setattr(alignment, "LINKS", 50)
    pairs = alignment.stored(alignment.pair_counts(links), shard_pairs=100)
    assert pairs.shards > 3
    got = alignment.weighed(links, pairs, ("doc_id", "n_links", "groups_sha256")).select("doc_id", *names)
    assert sorted(map(tuple, got.collect()), key=str) == whole


def test_empty_table_and_kept_columns(spark):
    assert alignment.compared(docs(spark, [])).count() == 0
    out = alignment.compared(docs(spark, [(None, None, None, None), (1, "one two", "en", "a")]), ("doc_id", "size", "fp"))
    assert sorted((r.doc_id is None, r.n_links > 0, r.size, r.fp) for r in out.collect()) == [(False, True, -7, "z"), (True, False, -7, "z")]
