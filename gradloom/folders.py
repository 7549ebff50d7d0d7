"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from gradloom.errors import InvalidParameter


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; one of the two is set as the other where that is unset.

    Only a session in one process (tests) may have neither and gets a temporary folder; on a cluster that raises, because no other machine would see it.
    """
    sc = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not here and not sc.master.startswith("local["):
            raise InvalidParameter("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(here or tempfile.mkdtemp(prefix="gradloom-"))
    return here or sc.getCheckpointDir()
