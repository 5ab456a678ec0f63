"""The registered queries: SQL twins where there are any, contract columns, and the pipeline by brute force."""

import pytest

import corpus_pipeline
from riskloom.llm import registry
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.helpers import duck, duck_rows, spark_rows

COLUMNS = {
    "op1": {"doc_id", "n_shingles", "component_id"}, "op2": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3": {"doc_id", "held_out", "score", "predicted"}, "op4": {"vec_id", "n_links", "component_id", "kept"},
    "op5": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op6": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op8": {"doc_id", "size", "source_size", "target", "taken"},
    "op9": {"ids", "cu_seqlens", "positions"}, "op10": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11": {"word", "form", "root", "n", "n_near", "form_n"}, "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13": {"query_id", "rank", "vec_id", "score"},
}


def test_every_operator_has_its_query():
    assert sorted(q.split("_")[0] for q in registry.queries()) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, name):
    s, d = spark_rows(registry.queries()[name](spark, SF_ORACLE)), duck_rows(duck(SF_ORACLE), registry.oracle_sql()[name])
    assert s == d


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_contract_columns(spark, name):
    df = registry.queries()[name](spark, SF_SMALL)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == before.columns
        counts.append(docs.count())
        if name in ("quality", "near_copies"):
            assert docs.exceptAll(before).isEmpty()
        if name == "near_copies":
            from riskloom.llm.ngram_join import ngram_components

            left = ngram_components(docs, size=5, threshold=80)
            assert left.where("doc_id <> component_id").isEmpty()
        if name == "secrets":
            from riskloom.llm.secret_scan import scanned

            assert scanned(docs).selectExpr("filter(spans, x -> x.kind < 3) as b").where("size(b) > 0").isEmpty()
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[4] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert out.count() == counts[4] and out.where("n_tokens <> size(ids)").isEmpty()
