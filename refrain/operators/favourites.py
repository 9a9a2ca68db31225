"""Favourite numbers per user: the toggle fold and the rows it selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.operators.browse import paged_by
from refrain.operators.linked import components


def fold_favourites(events: DataFrame) -> DataFrame:
    """(user_id, id): what each user holds after toggling rows (arrays of numbers) in order.

    A toggle takes the whole row out if any of its numbers is held, else puts all in. Where a
    user's numbers always come in the same row, order cannot matter and the row is held after an
    odd count of toggles; that is a plain combined count. Rows that overlap partly are folded in
    (ts, event_id) order, one group per set of linked numbers, not per user.
    """
    rows = events.withColumn("row", F.array_sort(F.array_distinct(F.col("ids").cast("array<bigint>")))).filter(F.size("row") > 0)
    counts = rows.groupBy("user_id", "row").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.select("user_id", F.explode("row").alias("id")).groupBy("user_id", "id").agg(
        F.count(F.lit(1)).alias("rows")
    ).filter("rows > 1").select("user_id").distinct()
    steady = counts.join(shared, "user_id", "left_anti").filter(F.col("n") % 2 == 1)
    overlapping = counts.join(shared, "user_id", "left_semi").select("user_id", "row")
    numbers = overlapping.select("user_id", F.get("row", F.lit(0)).alias("u"), F.explode("row").alias("v"))
    first = overlapping.select("user_id", "row", F.get("row", F.lit(0)).alias("node"))
    linked = first.join(components(numbers, ("user_id",)), ["user_id", "node"], "left").select(
        "user_id", "row", F.coalesce("root", "node").alias("link")
    )
    held = F.aggregate(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "row"))), F.array().cast("array<bigint>"),
        lambda kept, e: F.when(F.arrays_overlap(kept, e["row"]), F.array_except(kept, e["row"]))
        .otherwise(F.concat(kept, e["row"])),
    )
    mixed = rows.join(linked, ["user_id", "row"]).groupBy("user_id", "link").agg(held.alias("row"))
    return steady.select("user_id", F.explode("row").alias("id")).unionByName(
        mixed.select("user_id", F.explode("row").alias("id"))
    )


def is_favourite(ids: Column, favourites: Column) -> Column:
    """Whether any of a row's numbers is held."""
    return F.coalesce(F.arrays_overlap(ids, favourites), F.lit(False))


def favourite_rows(favourites: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, variant_artist, variant_title, first_id, place): the rows a user's numbers show, lowest number first.

    ``favourites`` is (user_id, id); ``members`` is ``browse.variant_members``. A number shows one row,
    of rows that share it the last by artist and title; rows of one lowest number show once.
    """
    lowest = members.groupBy("variant_artist", "variant_title").agg(F.min("id").alias("song_id"))
    shown = members.join(lowest, ["variant_artist", "variant_title"]).groupBy("id").agg(
        F.max(F.struct("variant_artist", "variant_title", "song_id")).alias("v")
    )
    rows = favourites.join(shown, "id").groupBy("user_id", F.col("v.song_id").alias("song_id")).agg(
        F.min(F.struct("id", "v")).alias("first")
    ).select("user_id", F.col("first.v.variant_artist"), F.col("first.v.variant_title"), F.col("first.id").alias("first_id"))
    return paged_by(rows, ["user_id"], [F.col("first_id")]).drop("page")
