"""Readers and writers of the job's files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.functions.text import SPACE
from refrain.operators.link import prepare_dump

SONGS = "source string, fetchedAt string, count long, songs array<struct<id:long,postId:long,artist:string,song:string>>"
DUMP = (
    "id long, artist_credit_id string, artist_mbids string, artist_credit_name string, release_mbid string, "
    "release_name string, recording_mbid string, recording_name string, combined_lookup string, score string"
)
OVERRIDE = (
    "postId long, artist string, sortAs string, title string, `from` string, categories array<string>, "
    "language string, year int, genres array<string>, artists array<struct<mbid:string,name:string>>, why string"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """post_id, id, artist, song from the scrape's envelope file."""
    rows = spark.read.schema(SONGS).option("multiLine", True).json(path)
    return rows.select(F.explode("songs").alias("s")).select(
        F.col("s.postId").alias("post_id"), F.col("s.id").alias("id"), "s.artist", "s.song"
    )


#: How a song's object ends inside the list of an envelope that is written with an indent of two. Line breaks inside
#: strings are escaped, so this never stands within one.
_SONG_END = "\n    },"
_SONG = "id long, postId long, artist string, song string"


def read_indented_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``read_catalog`` for an envelope of any size that is written with an indent of two, as the scrape writes it.

    The file is cut where songs end, so as many tasks read it as it has blocks. What stands before the first song and
    after the last is left off; an object that cannot be read fails the job.
    """
    pieces = spark.read.option("lineSep", _SONG_END).text(path)
    begin = F.instr("value", "\n    {")
    body = F.col("value").substr(begin, F.char_length("value"))
    last = F.instr(body, "\n    }")
    text = F.concat(F.when(last > 0, body.substr(F.lit(1), last)).otherwise(body), F.lit("}"))
    songs = pieces.filter(begin > 0).select(F.from_json(text, _SONG, {"mode": "FAILFAST"}).alias("s"))
    return songs.select(F.col("s.postId").alias("post_id"), F.col("s.id").alias("id"), "s.artist", "s.song")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The dump's CSV as raw dump rows; short rows and blank keys are dropped.

    The file's own first column is the row number, so order survives any split of the scan.
    """
    rows = spark.read.schema(DUMP).csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    ids = F.array_distinct(F.filter(F.split("artist_mbids", f"(?:,|{SPACE})+"), lambda i: i != ""))
    return rows.filter(
        F.col("score").isNotNull() & (F.coalesce("combined_lookup", F.lit("")) != "")
    ).select(
        F.col("id").alias("row_no"), F.col("recording_mbid").alias("recording_id"),
        F.coalesce("artist_credit_name", F.lit("")).alias("credit"),
        F.coalesce(ids, F.array().cast("array<string>")).alias("artist_ids"),
        F.coalesce("recording_name", F.lit("")).alias("recording"), F.coalesce("release_name", F.lit("")).alias("release"),
        F.col("score").try_cast("long").alias("score"), F.col("combined_lookup").alias("key"),
    )


def write_prepared_dump(dump: DataFrame, path: str) -> None:
    """Keys and grades computed once, stored by columns and clustered by key for all later passes."""
    prepare_dump(dump).repartitionByRange("key", "row_no").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "json") -> DataFrame:
    """An optional input: a missing path is an empty relation of the given schema.

    ``json`` is one object per line, as this module's writers leave it; ``envelope`` is one JSON
    value per file; other kinds are Spark formats.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if kind == "envelope":
        return reader.option("multiLine", True).json(path)
    return reader.format(kind).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(artist): trimmed lines of a text list, comments and blanks dropped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", f"\\A{SPACE}+|{SPACE}+\\z", "").alias("artist"))
    return lines.filter((F.col("artist") != "") & ~F.startswith("artist", F.lit("#")))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(artist_id, name, slug, why) from a JSON object keyed by id."""
    schema = "note string, artists map<string,struct<name:string,slug:string,why:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.explode("artists").alias("artist_id", "a")).select("artist_id", "a.*")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rows with ``present``, the names of the fields each JSON object held."""
    texts = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json(F.get_json_object("value", "$.overrides"), "array<string>")).alias("text")
    )
    return texts.select(F.from_json("text", OVERRIDE).alias("o"), F.expr("json_object_keys(text)").alias("present")).select(
        F.col("o.postId").alias("post_id"), "o.artist", F.col("o.sortAs").alias("sort_as"), "o.title", "o.from",
        "o.categories", "o.language", "o.year", "o.genres", F.transform("o.artists", lambda a: F.struct(
            a["mbid"].alias("artist_id"), a["name"].alias("name")
        )).alias("artists"), "o.why", "present",
    )


def write_with_provenance(df: DataFrame, path: str, note: str, key: str, kind: str = "json") -> None:
    """Rows in key order under ``rows`` and one provenance row under ``about``."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").format(kind).save(f"{path}/rows")
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    about = df.sparkSession.createDataFrame([(stamp, note)], "generated_at string, note string")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def write_search_index(songs: DataFrame, members: DataFrame, artists: DataFrame, path: str) -> None:
    """Search rows with their numbers nested, and artists, both as JSON."""
    ids = members.groupBy("variant_artist", "variant_title").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    songs.join(ids, ["variant_artist", "variant_title"]).drop("variant_artist", "variant_title", "sort_as").write.mode(
        "overwrite"
    ).option("ignoreNullFields", True).json(f"{path}/songs")
    artists.select("name", "slug").write.mode("overwrite").json(f"{path}/artists")
