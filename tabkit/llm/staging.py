"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from .shipping import ship


class Scratch:
    """Tables below ``spark.checkpoint.dir`` that cut lineage.

    A written table is computed once and outlives lost executors. ``drop`` frees a table that no
    later step reads; the folder itself goes when the driver's JVM ends, so that a lazy
    result may still read what it needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])
        self._paths: dict[int, str] = {}

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = self.path(name)
        df.write.parquet(path, partitionBy=list(partition_by) or None)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self._paths.pop(id(table), None)
            if path:
                self.remove(path)

    def remove(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)
