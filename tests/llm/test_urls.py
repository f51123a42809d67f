import random
import re

from murmur.llm import urls

SCHEMA = "page_id long, url string, html string, host string, rule string"


def pages(spark, some):
    return spark.createDataFrame([(k, u, "<p>", "x", "y") for k, u in some], SCHEMA)


def plain(url, rules=urls.RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = []
    for text, verdict in rules:
        name, slash, more = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + more):
            fits.append((len(text), text, verdict))
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def sample():
    rng = random.Random(2)
    out = [None, "", "no scheme", "http://", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x",
           "http://a.net/es", "http://a.net/es/?q", "http://xnet/es/", "http://net/fr/#x", "ftp://a://b/c?d://e",
           "http://example.com/en/", "http://www.example.com/en/", "http://evil.www.example.com/en/a",
           "http://x.com?y=/en/", "http://x.com#/en/", "http://ex\nample.com/a\nb?c", "http://é.com/É"]
    for _ in range(300):
        host = rng.choice(["a", "blog.b", "www.cheap-pills", "spam-farm", "news"]) + ".example" + rng.choice(
            [".com", ".net", ".org"])
        out.append(f"http://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(999)}")
    return list(enumerate(out))


def test_parts_and_rules_equal_a_plain_loop(spark):
    some = sample()
    got = urls.judged(pages(spark, some)).collect()
    assert len(got) == len(some)
    by = dict(some)
    for r in got:
        host, path, rule, verdict = plain(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), by[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in (urls.ALLOW, urls.BLOCK)
        if not host and not path:
            assert r.verdict == urls.ALLOW


def test_longer_rules_and_repeats_win(spark):
    rules = (("a.com", "block"), ("a.com/x", "allow"), ("a.com/x/y", "block"), ("b.com/", "allow"), ("b.com/", "block"))
    some = list(enumerate(["http://a.com", "http://a.com/x1", "http://q.a.com/x/yz", "http://b.com/"]))
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judged(pages(spark, some), rules).collect())
    assert got == [(0, "a.com", "block"), (1, "a.com/x", "allow"), (2, "a.com/x/y", "block"), (3, "b.com/", "allow")]


def test_held_out_accuracy(spark):
    rng = random.Random(3)

    def url(bad):
        word = rng.choice(["casino", "pills", "spam", "win-money"] if bad else ["news", "library", "garden", "school"])
        return f"http://{word}{rng.randrange(500)}.org/{rng.choice(['buy', 'free'] if bad else ['about', 'read'])}/{rng.randrange(99)}"

    labelled = spark.createDataFrame([(url(k % 2), bool(k % 2)) for k in range(300)], "url string, block boolean")
    tests = [(k, url(k % 2)) for k in range(200)]
    got = {r.page_id: r.verdict for r in urls.judged(pages(spark, tests), (), labelled).collect()}
    assert sum((got[k] == "block") == bool(k % 2) for k, _ in tests) >= 190


def test_one_verdict_no_verdict_and_empty_tables(spark):
    none = spark.createDataFrame([], "url string, block boolean")
    one = spark.createDataFrame([("http://x.org/a", True), ("http://y.org", None)], "url string, block boolean")
    some = pages(spark, [(1, "http://z.org/b"), (None, "http://z.org/b"), (None, None)])
    assert {r.verdict for r in urls.judged(some, (), none).collect()} == {"allow"}
    assert sorted(r.verdict for r in urls.judged(some, (), one).collect()) == ["allow", "block", "block"]
    assert urls.judged(pages(spark, [])).count() == 0
