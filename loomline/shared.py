"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; on a cluster,
    where the machines don't share one, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            master = sc.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
            named = tempfile.mkdtemp(prefix="loomline-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()
