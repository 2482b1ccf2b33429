"""Training-data pipeline over ``documents``: language, near duplicates, benchmark passages, mixture, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet into the shared checkpoint folder and rereads it
as the next stage's documents. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.llm import curriculum, fragment_join, language_mix, phrase_index, simple8b
from clientele.llm.queries import SCHEDULES, table, tokenizer_file
from clientele.llm.text import row_mark, scratch, without


def language(spark, docs, sf_dir):
    """Rejected documents go: those without letters, and those that no mixture of the learned languages explains as well
    as it explains the worst learning document of about their length. Texts in several languages stay. Model and floor
    are learned from all labelled documents that are not held out."""
    model = language_mix.with_floor(language_mix.fit(docs, fit_docs=None), docs, fit_docs=None)
    return language_mix.detect(docs, model).filter("fits").select("kept.*")


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of near duplicates stays, that of the smallest id (five words, similarity 0.8)."""
    return fragment_join.near_duplicate_rows(docs, k=5, percent=80)


def benchmark_passages(spark, docs, sf_dir):
    """Rows with a window of ten words of a benchmark item go."""
    mark = row_mark(F.col("doc_id"), F.col("text"))
    marks = docs.select(mark.alias("doc_id"), "text")
    hit = phrase_index.decontaminate(marks, table(spark, sf_dir, "benchmark"), length=10, slop=0, segment_chars=1_000_000).filter("n_hit > 0")
    return without(docs, hit.select(F.col("doc_id").alias("mark"), F.lit(False).alias("keep")).distinct(), mark)


def source_mixture(spark, docs, sf_dir):
    """Documents in training order, each as often as the mix takes it (whole)."""
    return curriculum.training_order(docs, schedules=SCHEDULES, max_epochs=3, cut_last=False)


def token_files(spark, docs, sf_dir):
    """Token ids of all rows in files; the files' index, read back."""
    folder = scratch(spark, "token-files")
    simple8b.write_ids(docs, folder, tokenizer_file(), end_id=1)
    return simple8b.read_index(spark, folder)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages),
          ("source_mixture", source_mixture), ("token_files", token_files)]

#: Mixture inference and tokenizers have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
