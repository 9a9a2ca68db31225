"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, partitions: int | None = None, app: str = "refrain") -> SparkSession:
    """A session with adaptive execution on; cluster values for the rest stay with the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's ``spark.checkpoint.dir``.

    Only a local session with nothing set gets a folder of its own; on a cluster a machine-local
    folder would not survive, so an unset one is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="refrain-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before work that is per row, not per byte: a small file is one task's input however many rows it holds."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep a stage as a Parquet table in the shared folder, so that lost executors never replay earlier passes.

    Later readers prune columns and rows of it, which a row-wise checkpoint does not allow.
    """
    spark = df.sparkSession
    plain = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path)
