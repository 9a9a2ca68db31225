"""The engine's inputs as projections of the given tables.

Each stand-in is a table name and one SQL expression per column. The expressions are plain
enough to be read by Spark and by the SQL the results are checked against, so both sides see
the same rows. Every row of the table takes part; parity and size columns only choose how a
row is distorted, never whether it is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER_BRAND = "'Brand#' || CAST(1 + (p_partkey * 7) % 25 AS STRING)"
JOINT = "p_size BETWEEN 46 AND 48"

# A dirty catalogue: every part once, distorted in one of eight ways.
CATALOG = ("part", {
    "post_id": "p_partkey",
    "id": "CAST(floor(p_partkey / 2) AS BIGINT)",
    "artist": f"""CASE WHEN {JOINT} THEN {OTHER_BRAND} || ' & ' || p_brand
        WHEN p_partkey % 8 = 1 THEN upper(p_brand)
        WHEN p_partkey % 8 = 6 AND p_size % 2 = 0 THEN substring(p_brand, 1, 2) || substring(p_brand, 4)
        ELSE p_brand END""",
    "song": """CASE WHEN p_partkey % 8 = 1 THEN upper(p_name)
        WHEN p_partkey % 8 = 2 THEN 'The ' || p_name
        WHEN p_partkey % 8 = 3 THEN p_name || ' (remix)'
        WHEN p_partkey % 8 = 4 THEN p_name || ' (1999)'
        WHEN p_partkey % 8 = 5 THEN substring(p_name, 1, 1) || substring(p_name, 3, 1) || substring(p_name, 2, 1) || substring(p_name, 4)
        WHEN p_partkey % 8 = 6 AND p_size % 2 = 1 THEN substring(p_name, 1, 2) || substring(p_name, 4)
        WHEN p_partkey % 8 = 7 THEN replace(p_name, ' ', ' & ')
        ELSE p_name END""",
})

# The clean reference: credits, ids, recordings, releases and a score per row.
_NAME = "CASE WHEN p_partkey % 8 = 7 THEN replace(p_name, ' ', ' and ') ELSE p_name END"
_RECORDING = f"""CASE WHEN p_size <= 4 THEN {_NAME} || ' (remix)' WHEN p_size <= 6 THEN {_NAME} || ' / Side B'
        WHEN p_size <= 8 THEN {_NAME} || 's' ELSE {_NAME} END"""
DUMP = ("part", {
    "row_no": "p_partkey",
    "recording_id": "'r' || CAST(p_partkey AS STRING)",
    "credit": f"""CASE WHEN {JOINT} THEN p_brand || ' feat. ' || {OTHER_BRAND}
        WHEN p_size BETWEEN 41 AND 45 THEN 'The ' || p_brand ELSE p_brand END""",
    "ids": f"""'a' || substring(p_brand, 7) || CASE WHEN {JOINT} THEN ',a' || substring({OTHER_BRAND}, 7) ELSE '' END""",
    "recording": _RECORDING,
    "release": f"""CASE WHEN p_size BETWEEN 9 AND 12 THEN 'Live at ' || p_type
        WHEN p_size BETWEEN 13 AND 14 THEN {_RECORDING} ELSE p_type END""",
    "score": "p_partkey",
})

# Guesses put to the dump for some songs.
PROPOSALS = ("part", {
    "post_id": "p_partkey",
    "artist": "CASE WHEN p_size % 3 = 0 THEN 'The ' || p_brand ELSE p_brand END",
    "title": "p_name",
    "from": "CASE WHEN p_size % 5 = 0 THEN p_type END",
    "language": "CASE WHEN p_size % 7 = 0 THEN 'eng' END",
    "why": "CASE WHEN p_size BETWEEN 15 AND 20 THEN 'by ear' WHEN p_size BETWEEN 47 AND 50 THEN 'by the cover' END",
})

# Artists: suppliers with a nation, a type and a note; names repeat on purpose.
ARTISTS = ("supplier", {
    "artist_id": "'s' || CAST(s_suppkey AS STRING)",
    "seq": "s_suppkey",
    "name": "'Nation ' || CAST(s_nationkey AS STRING) || CASE WHEN s_suppkey % 13 = 2 THEN ' Group' WHEN s_suppkey % 13 = 5 THEN ' No' ELSE '' END",
    "type": "CASE WHEN s_suppkey % 3 = 0 THEN 'Person' WHEN s_suppkey % 3 = 1 THEN 'Group' END",
    "disambiguation": "CASE WHEN s_suppkey % 2 = 0 THEN 'no ' || CAST(s_nationkey + s_suppkey % 4 AS STRING) END",
    "slug": "CASE WHEN s_acctbal < 0 THEN 'In debt' WHEN s_suppkey % 9 = 1 THEN 'Number ' || CAST(s_suppkey AS STRING) END",
})

# Composed songs for browsing: parts with years, genres, shows and languages.
SONGS = ("part", {
    "post_id": "p_partkey",
    "id": "CAST(floor(p_partkey / 2) AS BIGINT)",
    "artist": "CASE WHEN p_size % 10 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END",
    "song": "CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END",
    "year": "CASE WHEN p_size > 5 THEN CAST(1950 + p_size AS INT) + CAST(p_partkey % 20 AS INT) END",
    "from": """CASE WHEN p_size = 1 THEN 'Frozen' WHEN p_size = 2 THEN 'Mary Poppins' WHEN p_size = 3 THEN 'Goldfinger'
        WHEN p_size = 4 THEN 'Eurovision' WHEN p_size = 5 THEN p_type END""",
    "category": """CASE WHEN p_size % 10 = 0 THEN 'Traditional' WHEN p_size % 10 = 5 THEN 'Disney' END""",
    "genre_a": "lower(p_type)",
    "genre_b": "CASE WHEN p_partkey % 4 = 0 THEN 'hip hop' WHEN p_partkey % 4 = 1 THEN 'r&b' END",
    "language": "CASE WHEN p_size % 4 = 0 THEN 'swe' WHEN p_size % 4 = 1 THEN 'eng' WHEN p_size % 4 = 2 THEN 'xyz' END",
})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, standin: tuple[str, dict[str, str]]) -> DataFrame:
    source, columns = standin
    return table(spark, sf_dir, source).selectExpr(*[f"{sql} AS `{name}`" for name, sql in columns.items()])


def sql(standin: tuple[str, dict[str, str]]) -> str:
    """The same projection as checking SQL."""
    source, columns = standin
    return "SELECT " + ", ".join(f'{text} AS "{name}"' for name, text in columns.items()) + f" FROM {source}"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CATALOG)


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DUMP).withColumn("artist_ids", F.split("ids", ",")).drop("ids")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PROPOSALS).filter(F.col("why").isNotNull())


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed songs; the brand is the one credited artist."""
    rows = view(spark, sf_dir, SONGS)
    nothing = F.lit(None).cast("array<string>")
    return rows.withColumns({
        "genres": F.array_compact(F.array("genre_a", "genre_b")),
        "categories": F.when(F.col("category").isNotNull(), F.array("category")).otherwise(nothing),
        "artists": F.when(F.col("artist") != "", F.array(F.struct(
            F.lower("artist").alias("artist_id"), F.regexp_replace(F.lower("artist"), "#", "-").alias("slug"),
            F.col("artist").alias("name"),
        ))),
        "sort_as": F.when(F.col("artist") == "", "").otherwise(F.col("artist")),
    }).drop("category", "genre_a", "genre_b")
