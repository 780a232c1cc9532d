"""Profiles of a session, in place of a choice of executor for each query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Executor:
    """master: None leaves the choice to spark-submit; tasks: shuffle partitions before AQE coalesces them."""

    name: str
    master: str | None
    tasks: int | None = None

    def session(self, app: str = "loomline", **conf: str) -> SparkSession:
        b = SparkSession.builder.appName(app)
        if self.master:
            b = b.master(self.master)
        settings = {
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
        }
        if self.tasks:
            settings["spark.sql.shuffle.partitions"] = str(self.tasks)
        return b.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


sequential = Executor("sequential", "local[1]", 1)
threaded = Executor("threaded", "local[*]", 8)
#: On a cluster; the deployment sets master, memory and spark.checkpoint.dir.
distributed = Executor("distributed", None)
