import oracle
import pytest

from lumenfold.llm import queries as q

COLUMNS = {
    "op1_prefix_forest": {"query_id", "rank", "vec_id", "score"}, "op2_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op4_inner_product": {"query_id", "rank", "vec_id", "score"},
    "op5_warc": {"page_id", "record_type", "record_id", "refers_to"}, "op6_suffix_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op7_jump_shard": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op8_shingle_join": {"doc_id", "n_shingles", "component_id"},
    "op9_html_text": {"page_id", "url", "text", "n_chars"}, "op10_language": {"doc_id", "held_out", "lang_pred", "score"}, "op11_block_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12_fill_middle": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"}, "op13_reply_trees": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, small, name):
    df = q.QUERIES[name](spark, small)
    assert COLUMNS[name] <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, name):
    assert oracle.same(oracle.spark_rows(q.QUERIES[name](spark, small)), oracle.sql_rows(oracle.connect(small), q.ORACLE_SQL[name]))
