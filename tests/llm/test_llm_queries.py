"""The registered queries: rows, columns, and SQL where there is some."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import connect, rows_in, rows_of

from millrace.llm import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()
COLUMNS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op4_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_decontamination": ["doc_id", "item_id", "coverage"],
    "op6_source_mixing": ["doc_id", "copy_no"],
    "op7_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op8_quality": ["doc_id", "perplexity", "keep"],
    "op9_toxicity": ["doc_id", "toxic"],
    "op10_tiff": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
}


def test_all_ten_are_there():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_in(connect(small), SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, small, name):
    df = QUERIES[name](spark, small)
    assert set(COLUMNS[name]) <= set(df.columns)
    table, key = ("pages", "page_id") if "page_id" in COLUMNS[name] else ("documents", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect())
    got = sorted(r[0] for r in df.select(key).collect())
    if name in ("op5_decontamination", "op6_source_mixing"):
        assert got and set(got) <= set(ids)
    else:
        assert got == ids
