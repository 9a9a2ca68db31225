"""Enrichment by id: names, genres, earliest dates, works, and what is still to be asked."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.names import display_name
from refrain.functions.text import bind, combined_lookup, js_trim
from refrain.session import shared_folder

NO_STRINGS = "array<string>"


def worklist(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to ask about: those whose keys an earlier run has not answered."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def keep_by_id(lookup: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """The lookup as a table bucketed and sorted by its id: joins on the id never shuffle it again.

    Kept in the shared folder. Give a name to find it again by it; without one the session alone knows it.
    """
    spark = lookup.sparkSession
    own = f"by_id_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{own}"
    lookup.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name or own)
    return spark.table(name or own)


def pick_genres(genres: Column, most: int = 3) -> Column:
    """Names of the first genres with two votes, or with one when none has two."""
    def voted(floor: int) -> Column:
        return F.filter(genres, lambda g: g["count"] >= floor)

    return bind(voted(2), lambda strong: F.transform(
        F.slice(F.when(F.size(strong) > 0, strong).otherwise(voted(1)), 1, most), lambda g: g["name"]
    ))


def keep_vocabulary(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(artist_id, name, count): positive tags that are genre names, ignoring case."""
    known = vocabulary.select(F.lower("name").alias("lowered")).distinct()
    return (
        tags.filter(F.col("count") > 0).withColumn("lowered", F.lower("name"))
        .join(known, "lowered", "left_semi").select("artist_id", "name", "count")
    )


def nested_genres(kept: DataFrame) -> DataFrame:
    """(artist_id, genres): most voted first, then by name."""
    return kept.groupBy("artist_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("low"), "name", "count"))).alias("g")
    ).select("artist_id", F.transform("g", lambda g: F.struct(g["name"].alias("name"), g["count"].alias("count")))
             .alias("genres"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group; Spark prunes each partition to k before the shuffle."""
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("position") <= k)


def to_artists(hits: DataFrame) -> DataFrame:
    """Nested lookup hits projected to artist records; own name and repeats leave the aliases."""
    names = F.array_distinct(F.transform("aliases", lambda a: a["name"]))
    return hits.select(
        F.col("id").alias("artist_id"), "name", "sort_name", "type", "country",
        F.nullif("disambiguation", F.lit("")).alias("disambiguation"), F.col("life_span.begin").alias("began"),
        F.nullif("life_span.end", F.lit("")).alias("ended"),
        F.filter(names, lambda a: a != F.col("name")).alias("aliases"),
    )


def display_artists(artists: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Artist records with the display name and the picked genres; ``names`` is (artist_id, curated)."""
    curated = artists.withColumn("curated", F.lit(None).cast("string")) if names is None else artists.join(
        names.select("artist_id", F.col("name").alias("curated")), "artist_id", "left"
    )
    return curated.withColumns({
        "display": display_name(F.col("name"), F.col("aliases"), F.col("curated")),
        "picked": pick_genres(F.col("genres")),
    }).drop("curated")


def dating_pairs(matches: DataFrame) -> DataFrame:
    """One (recording_id, artist_id, title_key) per recording: the first trusted song's published title."""
    pairs = matches.filter("matched and trusted").select(
        "post_id", "recording_id", F.get("artist_ids", F.lit(0)).alias("artist_id"),
        combined_lookup(F.coalesce("title", "recording")).alias("title_key"),
    ).filter(F.col("artist_id").isNotNull() & F.col("recording_id").isNotNull() & (F.col("title_key") != ""))
    return pairs.groupBy("recording_id").agg(
        F.min_by(F.struct("artist_id", "title_key"), "post_id").alias("p")
    ).select("recording_id", "p.*")


def earliest_release(pairs: DataFrame, hits: DataFrame, artists: DataFrame) -> DataFrame:
    """(recording_id, first_released, year, seen): earliest plausible date of a title by an artist.

    ``hits`` has title, first_released (partial ISO text, nullable) and artist_ids. They are
    summed up per (title, artist) before they meet the pairs, so a popular title costs one row.
    """
    floors = artists.select("artist_id", F.expr("nullif(try_cast(substring(began, 1, 4) as int), 0)").alias("began_year"))
    keyed = hits.select(
        combined_lookup(F.col("title")).alias("title_key"), "first_released",
        F.explode(F.array_distinct("artist_ids")).alias("artist_id"),
    ).join(pairs.select("title_key", "artist_id").distinct(), ["title_key", "artist_id"], "left_semi")
    year = F.expr("try_cast(substring(first_released, 1, 4) as int)")
    dated = keyed.join(floors, "artist_id", "left").withColumn("plausible", F.when(
        year >= F.coalesce("began_year", F.lit(fixed.EARLIEST_YEAR)), F.col("first_released")
    ))
    found = dated.groupBy("title_key", "artist_id").agg(
        F.min("plausible").alias("first_released"), F.count(F.lit(1)).alias("seen")
    ).filter(F.col("first_released").isNotNull())
    return pairs.join(found, ["title_key", "artist_id"]).select(
        "recording_id", "first_released", F.substring("first_released", 1, 4).cast("int").alias("year"), "seen"
    )


def date_quantiles(dated: DataFrame, column: str = "year") -> DataFrame:
    """One row: n, earliest, latest and the values at index floor(n * f) for the quartiles.

    Works on the histogram of values, which stays small however many rows there are.
    """
    counts = dated.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    running = counts.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(
        Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ).alias("total"))

    def at(fraction: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * fraction), F.col("v")))

    return running.agg(
        F.sum("n").alias("n"), F.min("v").alias("earliest"), F.max("v").alias("latest"), at(0.25).alias("lower"),
        at(0.5).alias("median"), at(0.75).alias("upper"),
    )


def pick_work(relations: Column) -> Column:
    """struct(work_id, title, language, languages) of the first work that is no cover or translation."""
    works = F.filter(relations, lambda r: r["work"]["id"].isNotNull())
    plain = F.filter(works, lambda r: ~F.arrays_overlap(
        F.coalesce(r["attributes"], F.array().cast(NO_STRINGS)), F.array(F.lit("cover"), F.lit("translator"))
    ))

    def linked(relation: Column) -> Column:
        work = relation["work"]
        languages = F.filter(F.coalesce(work["languages"], F.array().cast(NO_STRINGS)), lambda c: c != "")
        return F.when(relation.isNotNull(), F.struct(
            work["id"].alias("work_id"), F.nullif(js_trim(work["title"]), F.lit("")).alias("title"),
            F.nullif(F.coalesce(work["language"], F.get(languages, F.lit(0))), F.lit("")).alias("language"),
            F.when(F.size(languages) > 1, languages).alias("languages"),
        ))

    return bind(F.coalesce(F.get(plain, F.lit(0)), F.get(works, F.lit(0))), linked)


def coverage(asked: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: how many were asked, answered, missing, and have each column."""
    joined = asked.select(key).distinct().join(answers.withColumn("answered", F.lit(1)), key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("asked"), F.count("answered").alias("answered"),
        (F.count(F.lit(1)) - F.count("answered")).alias("missing"),
        *[F.count(c).alias(f"with_{c}") for c in columns],
    )
