"""The registered queries over whole tables: SQL oracles where there are some, shapes for all."""

import duckdb
import pytest

from lodestrand.llm import queries

COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op5_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_html": {"page_id", "url", "text", "n_chars"},
    "op10_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(name, spark, sf):
    df = queries.queries()[name](spark, sf)
    assert COLUMNS[name] <= set(df.columns)
    table = "pages" if name == "op7_html" else "documents"
    key = "page_id" if name == "op7_html" else "doc_id"
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    rows = lambda r: sorted(r, key=repr)
    assert rows(tuple(r[c] for c in cols) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in rel.fetchall())
