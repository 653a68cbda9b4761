"""The registered queries: contract columns, and the SQL ones against DuckDB."""

import duckdb
import pytest

from fungo.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_parity(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_html_extraction": "page_id url text n_chars",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_simhash_near_dedup": "doc_id fingerprint component_id",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op7_url_filters": "page_id host path rule verdict",
    "op8_sentencepiece": "doc_id token_ids",
    "op9_secret_scans": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op12_cross_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    table = "pages" if name in ("op2_html_extraction", "op7_url_filters") else "documents"
    assert df.count() == Q.read_table(spark, SF, table).count()
