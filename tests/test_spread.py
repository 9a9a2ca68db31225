"""Work that is per row is dealt out, however few bytes the rows take."""

from pyspark.sql import functions as F

from refrain.functions import names
from refrain.functions.text import before_first, parted
from refrain.plans import query_branches, standins


def _parts(spark, path):
    spark.range(400).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_every_form_of_one_small_file_is_worked_on_in_many_tasks(spark, tmp_path):
    sf_dir = _parts(spark, tmp_path)
    assert standins.table(spark, sf_dir, "part").rdd.getNumPartitions() == 1
    for query, forms in ((query_branches.credit_branches, query_branches.CREDITS), (query_branches.title_branches, query_branches.TITLES)):
        rows = query(spark, sf_dir)
        tasks = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sum(tasks) == 400 * len(forms)


def test_parts_are_those_of_a_split(spark):
    given = ["A & B", "& B", "A &", "a feat. b, c / d", "&", "", None, "A\x01B & C", "two\nlines & \n more", "a FT b with c & & d", "é，x ö"]
    rows = spark.createDataFrame([(g,) for g in given], "a string")
    for join in (names.JOIN, names.JOIN_GREEDY, names.JOIN_NARROW):
        got = rows.select(before_first(F.col("a"), join).alias("head"), F.split("a", join, 2)[0].alias("h"), parted(F.col("a"), join).alias("parts"), F.split("a", join).alias("p"))
        assert all(r["head"] == r["h"] and r["parts"] == r["p"] for r in got.collect())
