"""The registered queries over the smallest tables, against SQL where SQL can say the same."""

import duckdb
import pytest

from checks.compare import compare
from murmur.llm import queries
from murmur.sources.views import TABLES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, key):
    text, _, fine = compare(spark, duck, key, queries.QUERIES[key], queries.ORACLES[key], SMALL)
    assert fine, text


COLUMNS = {
    "op1": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op3": "source string, lang string, tokenizer string, docs bigint, tokens bigint",
    "op4": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6": "doc_id bigint, fingerprint string, component_id bigint",
    "op7": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8": "page_id bigint, host string, path string, rule string, verdict string",
    "op9": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_columns_come_first_and_rows_come(spark, key):
    df = queries.QUERIES[key](spark, SMALL)
    want = [tuple(c.split(" ")) for c in COLUMNS[key.split("_")[0]].split(", ")]
    assert df.dtypes[:len(want)] == want
    assert df.count() > 0
