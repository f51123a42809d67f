import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from murmur.llm import secret_scan
from tests.conftest import SMALL
from tests.llm.helpers import docs, odd_rows, prose
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_fingerprint, brute_groups


def test_stages_over_a_whole_table(spark):
    """Each stage against its brute-force version, on what the stage before has kept."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = df.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.written(stage(spark, df, SMALL), "test-pipeline")
        at[name] = df.collect()
        if name != "pack_documents":
            assert sorted(df.columns) == sorted(columns)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    there = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    kept = {r.doc_id for r in at["quality_rules"]}
    good = [i for i in there if labels.get(i) == 1 and len(there[i]["text"].split()) >= 10]
    assert sum(i in kept for i in good) >= 0.95 * len(good)

    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in at["quality_rules"]]
    assert {r.doc_id for r in at["simhash_dedup"]} == set(brute_groups(rows))
    assert len(at["simhash_dedup"]) == len(set(brute_groups(rows)))

    before = {r.doc_id: r.text for r in at["simhash_dedup"]}
    assert {r.doc_id for r in at["secret_masks"]} == set(before)
    for r in at["secret_masks"]:
        assert not secret_scan.base_spans(r.text)
        if not secret_scan.base_spans(before[r.doc_id]) and secret_scan.MASK not in r.text:
            assert r.text == before[r.doc_id]

    texts = {r.doc_id: r.text for r in at["secret_masks"]}
    assert {r.doc_id for r in at["mix_sources"]} <= set(texts)
    assert all(texts[r.doc_id].startswith(r.text) for r in at["mix_sources"])
    rows = [(r.doc_id, r.text) for r in at["mix_sources"]]
    assert check(rows, at["pack_documents"]) <= 4


def test_run_equals_its_stages_in_words(spark):
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p.length)
        assert len(np.frombuffer(p.ids, "<u4")) == p.length
    assert max(sum(v) for v in by.values()) <= 2048


def test_odd_rows_and_an_empty_table_pass(spark):
    for rows in (odd_rows(), []):
        df = docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.written(stage(spark, df, SMALL), "test-pipeline")
        assert df.count() >= len(rows) // 8


def test_columns_of_any_name_keep_their_values(spark):
    """Names that the operators use themselves, on documents that stay: with null and repeated ids, too."""
    names = ["_root", "_of", "_fp", "_at", "_text", "_id", "row", "of", "spans", "size", "taken", "target", "source_size", "root", "fp"]
    rows = odd_rows() + [(30 + k, prose(k, 60) + " password: hunter22", "en", "a") for k in range(40)]
    df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    columns, taken = df.columns, df
    for name, stage in corpus_pipeline.STAGES[:4]:
        taken = corpus_pipeline.written(stage(spark, taken, SMALL), "test-pipeline")
        assert sorted(taken.columns) == sorted(columns), name
        got = taken.collect()
        assert len(got) > 20 and all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for r in got for n in names)
