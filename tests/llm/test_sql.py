"""The operators' queries against their SQL in DuckDB, and their contracts' columns, on the smallest tables."""

import os
import re

import duckdb
import pytest

pytest.importorskip("tideline.llm")
from tideline.llm import queries

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_winnowing": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op11_ranked_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op13_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = queries.oracle_sql()[name]
    columns = sorted(con.sql(sql).columns)
    got = sorted(repr(tuple(r)) for r in queries.queries()[name](spark, SF).select(*columns).collect())
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, name):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert all(types[c] == t for c, t in CONTRACTS.get(name, {}).items())
    if name not in ("op5_topk", "op11_ranked_search", "op12_prefix_trie"):
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_fingerprint_digits(spark):
    got = queries.op6_simhash(spark, SF).select("fingerprint").collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)
