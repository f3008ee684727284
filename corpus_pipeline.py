"""Pipeline over ``documents``: toxicity, line dedup, SimHash near-dedup, benchmark
decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. A stage's result is
written as Parquet below the cluster's shared checkpoint folder and read again before the
next one starts, so a lost executor repeats at most one stage's tasks.

* ``toxicity``: documents scored at or above the threshold go.
* ``line_dedup``: lines shared by many documents go, except in the largest id holding
  them; ``n_chars`` follows the text. Documents stay, also when no line is left.
* ``near_dedup``: of each SimHash component the least id stays.
* ``decontamination``: documents that hold a passage of a benchmark item go.
* ``segmentation``: ids of the library's encoding and sampled segmentations per document, and
  the digest of what the ids decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlabel.llm import decontaminate, line_dedup, segmentation, simhash, toxicity
from spendlabel.llm.common import cut, free_names, read_table
from spendlabel.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a document's own columns named like the operator's results step aside meanwhile
    names = docs.columns
    aside = [free_names(docs, f"own_{c}")[0] if c.lower() in line_dedup.RESULT else c for c in names]
    kept = line_dedup.dedup_lines(docs.toDF(*aside))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    size = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns({"text": text, "n_chars": size}).drop(*line_dedup.RESULT).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.segment(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("segmentation", encode),
]

#: SQL can express neither the model, the trie join, the embedding nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
