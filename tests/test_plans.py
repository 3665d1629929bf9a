"""What physical plans must and must not have."""

import re

import pytest

from millrace.plans import registry


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


MAP_ONLY = ["vector_norms", "clean_text", "word_char_counts", "chunk_metadata_truncation", "chunk_ids_md5", "sentence_split", "sentence_merge", "paragraph_islands", "size_chunks", "semantic_chunks", "document_chunks", "markdown_title", "markdown_sections", "markdown_chunks", "markdown_links", "markdown_images", "url_to_path", "challenge_detect", "html_title", "html_links", "html_sections", "html_main_content"]
NATIVE = ["vector_norms", "vector_sanitize", "clean_text", "sentence_merge", "paragraph_islands", "markdown_sections", "markdown_chunks", "page_offsets", "chunk_pages", "url_to_path", "manifest_classify", "integrity_report", "index_upsert_dedup", "image_resolution", "chat_transcript"]


@pytest.mark.parametrize("name", MAP_ONLY)
def test_no_shuffle(spark, small, name):
    assert "Exchange" not in physical(registry.queries()[name](spark, small))


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", physical(registry.queries()[name](spark, small)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cartesian_product(spark, small, name):
    assert "CartesianProduct" not in physical(registry.queries()[name](spark, small))


def test_columns_are_pruned(spark, small):
    text = physical(registry.queries()["knn_cosine_topk"](spark, small))
    assert "label" not in text and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text.replace("\n", "")


def test_top_k_is_cut_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in physical(registry.queries()["knn_cosine_topk"](spark, small))


@pytest.mark.parametrize("name", ["frontier_wave", "html_links"])
def test_pages_are_parsed_in_one_step_of_python(spark, small, name):
    text = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("EvalPython", text)) == 1


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["threshold_search", "prompt_assembly", "asked_question", "answers", "one_stage_search", "fallback_embedding", "size_chunk_stats"])
def test_texts_reach_python_in_small_batches(spark, small, name):
    spark.conf.set(BATCH, "10000")
    registry.queries()[name](spark, small)
    assert int(spark.conf.get(BATCH)) <= 512


def test_hits_are_searched_once_for_both_forms_of_their_sources(spark, small):
    text = registry.queries()["source_block"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow", text)) == 1


def test_image_references_are_made_and_read_once(spark, small):
    text = registry.queries()["image_resolution"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in text and len(re.findall(r"Relation \[source_file", text)) <= 3  # references, and twice the names of files
