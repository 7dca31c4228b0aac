"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by UTF-8 bytes rather than by rows, and long texts are cut
where pre-tokens begin, so one very long text costs no more memory than many
short ones and no token spans a cut.  (Only a run without a border, as of one
letter, stays whole.)  The ids never leave the worker.

Null texts count as empty: 0 bytes, 0 tokens.  Every row gives one row, repeated
rows and null or repeated ids included; an empty table gives an empty one.
Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm._spark import prepare, table

MODEL = "byte_bpe_50k.json"
LIMIT = 512


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""
    prepare(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        from palisade.llm._bpe import Encoder

        encoder = Encoder.of(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            counts = [n for n, _ in encoder.encode(text.to_pylist(), want_ids=False)]
            size = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
