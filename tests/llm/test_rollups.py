from collections import defaultdict

from murmur.llm import rollups
from murmur.llm.store import new_folder
from tests.llm.helpers import docs, odd_rows
from tests.llm.test_packing import true_ids

ROWS = "source string, lang string, tokenizer string, old_tokens long, tokens long, docs string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], ROWS)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_inserts_revisions_and_deletes_add_up(spark):
    a = [("s", "en", "v1", 5, 7), ("s", "en", "v1", 9, 4), (None, None, "v1", 0, 3), ("s", "en", "v2", 1, 1)]
    rollup = rollups.Rollup(spark, new_folder(spark, "test"))
    assert totals(rollup) == {}
    old = rows(spark, a).withColumn("tokens", rollups.F.col("old_tokens"))
    assert rollup.commit("1", rollups.inserted(old))
    assert rollup.commit("2", rollups.revised(rows(spark, a)))
    assert not rollup.commit("2", rollups.revised(rows(spark, a)))
    assert totals(rollup) == {("s", "en", "v1"): (2, 11), (None, None, "v1"): (1, 3), ("s", "en", "v2"): (1, 1)}
    rollup.commit("3", rollups.deleted(rows(spark, a[1:])))
    assert totals(rollup) == {("s", "en", "v1"): (1, 7)}
    rollup.commit("4", rollups.inserted(rows(spark, [])))
    assert totals(rollup) == {("s", "en", "v1"): (1, 7)} and rollup.known("4")


def test_order_does_not_matter_and_folds_keep_names(spark):
    batches = {str(k): [("s", "en", "v", 0, 10 * k), ("t", "de", "v", 0, k)] for k in range(1, 5)}
    one, two = (rollups.Rollup(spark, new_folder(spark, "test")) for _ in range(2))
    for name in batches:
        one.commit(name, rollups.inserted(rows(spark, batches[name])))
    for name in reversed(batches):
        two.commit(name, rollups.inserted(rows(spark, batches[name])))
        two.folded(f"fold-{name}")
    assert totals(one) == totals(two) == {("s", "en", "v"): (4, 100), ("t", "de", "v"): (4, 10)}
    assert len(two.batches()) == 1
    assert not any(two.commit(name, rollups.inserted(rows(spark, batches[name]))) for name in batches)
    assert totals(two) == totals(one)


def test_an_interrupted_commit_does_not_count(spark):
    rollup = rollups.Rollup(spark, new_folder(spark, "test"))
    rollup.commit("1", rollups.inserted(rows(spark, [("s", "en", "v", 0, 1)])))
    rollup.commit("2", rollups.inserted(rows(spark, [("s", "en", "v", 0, 5)])))
    done = rollup._path(f"{rollup.folder}/batch-2/_SUCCESS")
    rollup._files.delete(done, False)
    assert totals(rollup) == {("s", "en", "v"): (1, 1)}
    assert rollup.commit("2", rollups.inserted(rows(spark, [("s", "en", "v", 0, 5)])))
    assert totals(rollup) == {("s", "en", "v"): (2, 6)}


def test_tokens_equal_the_library(spark):
    df = docs(spark, odd_rows()).select("doc_id", "text", rollups.bpe_tokens(rollups.F.col("text")).alias("n"))
    for r in df.collect():
        assert r.n == len(true_ids(r.text))


def test_the_query_over_whole_tables(spark):
    import pyarrow.parquet as pq

    from murmur.llm import queries
    from tests.conftest import SMALL

    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens)
           for r in queries.QUERIES["op3_token_rollup"](spark, SMALL).collect()}
    toxic = {r["doc_id"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist() if r["toxic"] == 1}
    want = defaultdict(lambda: [0, 0])
    for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist():
        if r["doc_id"] not in toxic:
            of = want[r["source"], r["lang"], "byte_bpe_50k"]
            of[0] += 1
            of[1] += len(true_ids(r["text"]))
    assert got == {k: tuple(v) for k, v in want.items()}
