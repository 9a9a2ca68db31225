"""Writes that hold what they promise: nothing is left of a write that breaks a rule, and a repeated batch changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RuleBroken(ValueError):
    """A write was given up; ``counts`` has the offending rows by rule."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(", ".join(f"{name}: {n}" for name, n in counts.items()))
        self.counts = counts


def _folder(spark: SparkSession, path: str):
    """The file system that a path lies in, and the path as that knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_checked(df: DataFrame, path: str, broken: dict[str, Column], least_rows: int = 0) -> int:
    """Write rows as Parquet to ``path`` if no row breaks a rule, and tell how many; else raise RuleBroken.

    ``broken`` says by name which rows are wrong (null is not). Rows are counted while they are written, in one pass,
    to a folder beside the target that takes its name only when all is well; what stood at the target until then
    stays as it is. Writes to one target must not run at the same time.
    """
    spark = df.sparkSession
    pending = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    seen = Observation()
    rules = [F.count_if(F.coalesce(wrong, F.lit(False))).alias(f"rule {name}") for name, wrong in broken.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *rules).write.parquet(pending)
    rows = seen.get["rows"]
    counts = {name: n for name in broken if (n := seen.get[f"rule {name}"])}
    if rows < least_rows:
        counts["too few rows"] = least_rows - rows
    (files, written), (_, target) = _folder(spark, pending), _folder(spark, path)
    if counts:
        files.delete(written, True)
        raise RuleBroken(counts)
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(written, target):
        raise OSError(f"{pending} could not take the name {path}")
    return rows


def batch_of(keys: list[str], batches: int) -> Column:
    """The batch of a row, by its keys alone, so that every run deals rows out alike."""
    return F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int")


def answer_in_batches(
    todo: DataFrame, keys: list[str], path: str, ask: Callable[[DataFrame], DataFrame], batches: int
) -> DataFrame:
    """Ask about all rows, a batch at a time, and give all answers; an interrupted run goes on where it stopped.

    ``ask`` turns rows of ``todo`` into answers. A batch is one partition of the table at ``path``, which takes its
    place only as a whole: those that stand there are not asked again, and one that is written twice replaces itself.
    A batch without answers is asked again by a later run.
    """
    spark = todo.sparkSession
    answers = ask(todo.limit(0)).schema
    dealt = todo.withColumn("batch", batch_of(keys, batches))
    for number in range(batches):
        files, place = _folder(spark, f"{path}/batch={number}")
        if not files.exists(place):
            found = ask(dealt.filter(F.col("batch") == number).drop("batch"))
            write_batch(found, path, number)
    files, place = _folder(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], answers)
    kept = T.StructType([*answers.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(kept).parquet(path).drop("batch")


def write_batch(found: DataFrame, path: str, number: int) -> None:
    """One batch in its partition; other batches are not touched."""
    found.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
