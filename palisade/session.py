"""Where intermediate tables lie."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """See that the session has a checkpoint folder: the shared one that spark.checkpoint.dir names.

    Where that is unset a local folder serves a local master, and a cluster is refused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palisade-ckpt-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint()
