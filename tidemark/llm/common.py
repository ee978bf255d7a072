"""What the training-data operators share: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's; where
    neither is set (local tests) a folder in the warehouse, which they share too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tidemark_staging"


class Staging:
    """Written tables in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it again: later steps no longer depend on shuffle files."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all of it; results that are read from it must have been used by then."""
        try:
            sc = self.spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone at interpreter exit
            pass


def crc32_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)
