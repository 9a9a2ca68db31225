"""What the operators share: reading a table, cutting lineage into the cluster's folder, joining rows into digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="refrain-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, kept as Parquet in the shared folder: later readers prune columns and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checksum_bucket(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fixed split between learning and held-out rows (null id: 0)."""
    return F.pmod(F.coalesce(F.crc32(id_column.cast("string").cast("binary")), F.lit(0)), F.lit(modulus))
