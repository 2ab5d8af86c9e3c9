import pytest

from prosegauge.llm.queries import QUERIES

COLUMNS = {
    "op1": {"page_id", "url", "text", "n_chars"},
    "op2": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op5": {"doc_id", "fingerprint", "component_id"},
    "op6": {"doc_id", "held_out", "lang_pred", "score"},
    "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op9": {"doc_id", "held_out", "score", "predicted"},
    "op10": {"query_id", "rank", "vec_id", "score"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    rows = df.collect()
    table, key = {"op1": ("pages", "page_id"), "op10": ("embeddings", None)}.get(name.split("_")[0], ("documents", "doc_id"))
    if key:
        assert {r[key] for r in rows} == {r[key] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    assert all(r[c] is not None for r in rows for c in COLUMNS[name.split("_")[0]])
