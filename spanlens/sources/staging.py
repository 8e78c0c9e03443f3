"""Tables that one job hands to the next: written under the folder all executors share, so lineage and plan end there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """A run's own folder under spark.checkpoint.dir; where that is unset and Spark is local, as in tests, under a temporary one that is then set."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
