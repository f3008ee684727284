"""The registered query of each operator, over the whole tables of ``sf_dir``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as op12
from . import decontaminate as op4
from . import embedding_dedup as op13
from . import language_id as op8
from . import line_dedup as op2
from . import quality_rank as op9
from . import quality_rules as op1
from . import segmentation as op6
from . import simhash as op10
from . import substring_dedup as op3
from . import token_counts as op5
from . import toxicity as op7
from . import whitening as op11
from .common import read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.quality_rules(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op2.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def line_dedup_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 by increments: the documents arrive in three batches, the second first with
    other texts; the third is deleted and comes again. The state then is that of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    batch = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == i) for i in range(3)]
    state = op2.build_state(batch[0])
    state = op2.insert_documents(state, batch[1].withColumn("text", F.reverse("text")))
    state = op2.insert_documents(state, batch[1].union(batch[2]))
    state = op2.insert_documents(op2.delete_documents(state, batch[2]), batch[2])
    return op2.dedup_lines(docs, state=state).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file: SPENDLABEL_TOKENIZERS, or the installed package's folder."""
    folder = os.environ.get("SPENDLABEL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return op3.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every leaked passage, with its place and edit distance."""
    return op4.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and of its samples, and the digest of what the ids decode to."""
    return op6.segment(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return op7.toxicity(docs, op7.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return op8.identify(docs, op8.fit(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return op9.quality(docs, op9.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.components(read_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12.align(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_line_dedup, op3_substring_dedup, op4_benchmark_decontamination,
    op5_token_counts, op6_sentencepiece, op7_toxicity, op8_language_id, op9_quality_classifier, op10_simhash_near_dedup,
    op11_embedding_whitening, op12_tokenizer_alignment, op13_embedding_near_dedup, line_dedup_increments)}
ORACLE_SQL = {"op1_quality_rules": op1.ORACLE, "op2_line_dedup": op2.ORACLE, "line_dedup_increments": op2.ORACLE,
              "op3_substring_dedup": op3.ORACLE}
