import math
import random
import re
from collections import defaultdict

import pytest

from murmur.llm import sanitisation
from tests.llm.helpers import docs, odd_rows, prose


def brute(text):
    """The base by its definition, with plain patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = 0
        for k, d in enumerate(reversed(digits)):
            d = d * 2 if k % 2 else d
            total += d // 10 + d % 10
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


CASES = ["a.b@c.d", "a@b.c@d.e", "a@b@c.d", "@b.c", "a@b", "a@b.c_d@e.f", "x@y-.z. q@r.s.", "é+a@b.co😀 z@w.x",
         "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.2.3", "1.2.3", "4041894974608795", "4041 8949-7460 8795 1", "4041  894974608795",
         "4041894974608795-", "+1 (386) 555-3733", "+1 (386) 555-3733 1.2.3.4", "+1234567", "+12345678", "+1234567890123456",
         "++1 2345678 +", "ip 10.0.0.1@host.com", "1.2.3.4@5.6.7.8", "0000000000000000", "+49 (0)30.1234-5678)"]


def test_base_equals_brute_force():
    rng = random.Random(4)
    letters = list("ab@.+-_%  ()0123456789") + ["1.2", "@a.b", "+1 (", "404189497460879", "555-"]
    texts = CASES + ["".join(rng.choices(letters, k=150)) for _ in range(1500)] + [r[1] for r in odd_rows()]
    for text in texts:
        assert [s[:3] for s in sanitisation.base_spans(text or "")] == brute(text), text
    assert {s[0] for t in texts for s in brute(t)} == {0, 1, 2, 3}


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "@" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 150_000):
        sanitisation.base_spans(text)


def disclosed(rows, support=3, least=0.75, reach=40):
    """(row, start, end) of revealing terms by plain loops over all documents."""
    holds, told, with_entity = defaultdict(set), defaultdict(dict), defaultdict(set)
    spots = []
    for n, (_, text, *_) in enumerate(rows):
        text = text or ""
        gaps = re.compile(r"""[^\x20\x09-\x0D.,;:!?()\[\]{}"<>]+""")
        for m in gaps.finditer(text):
            holds[m.group().encode().lower()].add(n)
        spans = brute(text)
        free = [m for m in gaps.finditer(text) if all(m.end() <= a or b <= m.start() for _, a, b in spans)]
        for kind, a, b in spans:
            entity = (kind, text[a:b].lower() if kind == 0 else tuple(map(int, text[a:b].split("."))) if kind == 1
                      else re.sub("[^0-9]", "", text[a:b]))
            with_entity[entity].add(n)
            before, after = [m for m in free if m.start() < a][-reach:], [m for m in free if m.start() >= a][:reach]
            context = b" ".join(m.group().encode().lower() for m in before + after)
            for m in before + after:
                told[entity, m.group().encode().lower()].setdefault(n, set()).add(context)
                spots.append((n, m.start(), m.end(), entity, m.group().encode().lower()))
    shares = {}
    for (entity, term), by_doc in told.items():
        contexts = {sorted(c, key=lambda x: sanitisation._hash(x))[0] for c in by_doc.values()}
        if len(contexts) >= support and len(with_entity[entity]) < len(rows):
            p = len(rows)
            share = math.log2(len(by_doc) * p / len(holds[term]) / len(with_entity[entity])) / math.log2(p / len(with_entity[entity]))
            if round(share, 9) >= least:
                shares[entity, term] = share
    return {(n, a, b) for n, a, b, e, t in spots if (e, t) in shares}, shares


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose(k, 120), "en", "a") for k in range(150)]
    for k in range(8):  # a name that only goes with one address, and one that is common
        out.append((200 + k, f"{prose(300 + k, 15)} Zaphod, the writer, {prose(400 + k, 5)} zb{'' if k % 2 else ''}@host.example.org {prose(500 + k, 80)}", "en", "b"))
    out += [(300 + k, f"{prose(600, 30)} +1 (386) 555-3733 Quuxly {prose(601, 30)}", "en", "b") for k in range(30)]  # copies
    out += [(400 + k, f"Room x7731 {prose(700 + k, 3)} at 10.1.2.3 or 4041894974608795 {prose(800 + k, 20)}", "en", "c") for k in range(5)]
    out += [(500, "x7731 and Zaphod alone", "en", "c")]
    return out + [(600 + k, c, None, None) for k, c in enumerate(CASES)] + odd_rows()


def test_terms_equal_brute_force(spark, rows):
    numbered = [(n, *r[1:]) for n, r in enumerate(rows)]
    got = {(r.doc_id, s.start, s.end): s.disclosure for r in sanitisation.scanned(docs(spark, numbered)).collect()
           for s in r.spans if s.kind == "term"}
    want, shares = disclosed(numbered)
    assert set(got) == want and want
    terms = {t for _, t in shares}
    assert b"zaphod" in terms and b"x7731" in terms and b"quuxly" not in terms  # copies prove nothing
    at = [n for n, r in enumerate(numbered) if r[1] == "x7731 and Zaphod alone"]
    assert not any(n == at[0] for n, _, _ in want)  # nothing to protect there


def test_base_spans_stay_and_come_first(spark, rows):
    for r in sanitisation.scanned(docs(spark, rows)).collect():
        spans = [(sanitisation.KINDS.index(s.kind), s.start, s.end) for s in r.spans]
        assert [s for s in spans if s[0] < 4] == brute(r.text) and spans == sorted(spans)
        if not brute(r.text):
            assert not spans


def test_sanitised_texts(spark, rows):
    before = {r[0]: r[1] for r in rows if r[0] is not None}
    out = sanitisation.sanitised(docs(spark, rows))
    assert set(out.columns) == set(docs(spark, []).columns) and out.count() == len(rows)
    for r in out.select("doc_id", "text", "spans").collect():
        if r.doc_id and 200 <= r.doc_id < 208:
            assert "Zaphod" not in r.text and "[EMAIL]" in r.text and "example" not in r.text
        if r.doc_id in (100, 500):
            assert r.text == before[r.doc_id]
    assert sanitisation.cut("ab cd", [3, 0], [5, 2], lambda a, b: f"<{a}{b}>") == "<02> <35>"
    assert sanitisation.form("x1") == "[NUMBER]" and sanitisation.form("Élan") == "[NAME]" and sanitisation.form("on") == "[WORD]"


def test_parts_of_long_documents_and_clashing_names(spark, rows, monkeypatch):
    whole = sorted(str(r) for r in sanitisation.scanned(docs(spark, rows), ["doc_id", "size"]).collect())
    monkeypatch.setattr(sanitisation, "CHUNK", 7)
    table = docs(spark, rows).withColumnRenamed("fp", "node").withColumnRenamed("shard", "near").withColumnRenamed("lang", "found")
    out = sanitisation.scanned(table)
    assert {"node", "near", "found", "size"} <= set(out.columns) and {r.node for r in out.select("node").collect()} == {"z"}
    assert sorted(str(r) for r in out.select("doc_id", "size", "spans").collect()) == whole


def test_empty_tables(spark):
    assert sanitisation.scanned(docs(spark, [])).count() == 0
    assert [len(r.spans) for r in sanitisation.scanned(docs(spark, [(None, None, None, None), (None, "a@b.c", None, None)]))
            .orderBy("text").collect()] == [0, 1]
