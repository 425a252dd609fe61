"""The registered queries and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import table

COLUMNS = {
    "op1_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op2_ngram_jaccard": ["doc_id", "n_shingles", "component_id"], "op3_html_text": ["page_id", "url", "text", "n_chars"], "op4_url_filters": ["page_id", "host", "path", "rule", "verdict"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"], "op6_context_tree": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op9_decontamination": ["doc_id", "item_id"], "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES) and set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    n = df.count()
    whole = table(spark, sf_dir, "pages" if name[:4] in ("op3_", "op4_") else "documents").count()
    assert 0 < n < whole if name == "op9_decontamination" else n == whole


def test_url_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/pages.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = sorted(con.execute(queries.ORACLES["op4_url_filters"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.QUERIES["op4_url_filters"](spark, sf_dir).collect()), key=str) == want


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    empty = docs.limit(0)
    assert corpus_pipeline.quality_rules(spark, empty, sf_dir).count() == 0 and corpus_pipeline.near_duplicates(spark, empty, sf_dir).count() == 0
