"""Intermediate tables in the shared checkpoint folder, dropped as soon as a later one stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ._graph import checkpoint_dir


class Scratch:
    """A folder of Parquet tables of one run. A lost executor costs only the tasks that read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """df as it stands in a table, in folders by the columns `by`, which can be dropped one by one."""
        df.write.partitionBy(*by).parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for n in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
