"""Tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df, written once to the folder of spark.checkpoint.dir, so that it is not made again and outlives executors.

    Where that setting is missing, a temporary folder serves on a single machine (tests); on a cluster that is an error.
    """
    spark = df.sparkSession
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[.*\])?\Z", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)
