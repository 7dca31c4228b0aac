"""A corpus pipeline of five of the operators in palisade.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents, whatever they are called.  Null and empty texts, repeated
rows and ids, and empty tables pass through every stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import op1_toxicity, op3_secrets, op4_decontaminate, op5_jaccard_join, op8_sentencepiece
from palisade.llm._spark import cut, discard, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return op1_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-grams, similarity 0.8) stays: the one with the least id."""
    return op5_jaccard_join.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by test items go."""
    return op4_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return op3_secrets.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids follow the columns; the text is what the ids decode to."""
    return op8_sentencepiece.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", jaccard),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", sentencepiece),
]

#: Learned scores, transitive links and token ids are beyond SQL; the tests hold run() against brute force of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if held is not None:  # nothing reads a stage's input once its rows are written
            discard(held)
        held = docs
    _, last = STAGES[-1]
    return last(spark, docs, sf_dir)
