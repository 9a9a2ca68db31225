"""The offline match: a dirty catalogue against the dump, pass after pass.

Each pass only looks at what the passes before left open, so the winners are materialised
between passes. Songs that ask the same question (same strings, same proposal) are matched
once and the answer is joined back, so repeated catalogue rows cost nothing in the joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.names import artist_annotation_source, is_placeholder
from refrain.functions.titles import published_title
from refrain.operators import link
from refrain.operators.expand import allowed_language, wanted_keys
from refrain.operators.select import best_first, how_name
from refrain.session import cut_lineage

ASK = ["artist", "song", "p_artist", "p_title", "p_from", "p_language", "p_why"]


def with_proposals(catalog: DataFrame, proposals: DataFrame | None) -> DataFrame:
    columns = {"artist": "p_artist", "title": "p_title", "from": "p_from", "language": "p_language", "why": "p_why"}
    if proposals is None:
        return catalog.select("*", *[F.lit(None).cast("string").alias(c) for c in columns.values()])
    return catalog.join(
        proposals.select("post_id", *[F.col(k).alias(v) for k, v in columns.items()]), "post_id", "left"
    )


def questions(catalog: DataFrame, proposals: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct questions, their proposals, post -> question)."""
    full = with_proposals(catalog, proposals)
    asks = cut_lineage(full.groupBy(*ASK).agg(F.min("post_id").alias("ask_id")))
    named = asks.select("ask_id", *[F.col(c).alias(f"asked_{c}") for c in ASK])
    same = [F.col(c).eqNullSafe(F.col(f"asked_{c}")) for c in ASK]
    members = full.join(named, reduce(Column.__and__, same)).select("post_id", "ask_id")
    songs = asks.select(F.col("ask_id").alias("post_id"), "artist", "song")
    put = asks.filter(F.col("p_why").isNotNull()).select(
        F.col("ask_id").alias("post_id"), F.col("p_artist").alias("artist"), F.col("p_title").alias("title"),
        F.col("p_from").alias("from"), F.col("p_language").alias("language"), F.col("p_why").alias("why"),
    )
    return songs, put, members


def match_songs(
    songs: DataFrame, dump: DataFrame, proposals: DataFrame | None = None, mode: str = "fold"
) -> DataFrame:
    """The held candidate per song after all passes; ``dump`` comes from ``link.prepare_dump``."""
    wanted, allow = cut_lineage(wanted_keys(songs, proposals)), allowed_language(songs, proposals)
    best = cut_lineage(link.link_keys(wanted, allow, dump, mode))

    ids = cut_lineage(link.learn_ids(songs, best))
    poor = link.unmatched_or_poor(songs, best)
    better = link.upgrade_scoped(poor, allow, dump, ids, best, mode)
    best = cut_lineage(best.join(better.select("post_id"), "post_id", "left_anti").unionByName(better))

    best = _extend(best, link.link_collab(link.unmatched(songs, best), dump, ids), dump, allow)
    best = _extend(best, link.link_title_first(link.unmatched(songs, best), dump, classes=True), dump, allow)

    again = cut_lineage(link.learn_ids(songs, best, again=True))
    best = _extend(best, link.link_scoped(link.unmatched(songs, best), allow, dump, again, number=5), dump, allow)

    credits = cut_lineage(link.learn_credits(songs, best))
    near = link.best_near(link.unmatched(songs, best), allow, dump, credits, mode)
    return cut_lineage(best.unionByName(near))


def _extend(best: DataFrame, found: DataFrame, dump: DataFrame, allow: DataFrame) -> DataFrame:
    """Add the first hit per still unmatched song."""
    first = link.with_rows(best_first(found), dump, allow)
    return cut_lineage(best.unionByName(first.select(*best.columns)))


def finished(
    catalog: DataFrame, best: DataFrame, proposals: DataFrame | None = None, works: DataFrame | None = None
) -> DataFrame:
    """Match rows for every catalogue song: published title, show, language, trust, placeholder."""
    full = with_proposals(catalog, proposals).join(best.withColumnRenamed("from", "key_from").withColumnRenamed(
        "language", "key_language"
    ), "post_id", "left")
    titled = full.withColumn("work_title", F.lit(None).cast("string")) if works is None else full.join(
        works.filter(F.col("title") != "").select("recording_id", F.col("title").alias("work_title")),
        "recording_id", "left",
    )
    how = how_name(F.col("how"))
    by_dump = published_title(F.col("recording"), F.col("work_title"), how)
    by_hand = published_title(F.col("p_title"), F.lit(None).cast("string"), how)
    matched = F.col("recording").isNotNull()
    return titled.select(
        "post_id", "id", "artist", "song", matched.alias("matched"),
        F.when(matched, how).alias("how"), "rewrites",
        F.when(F.col("proposed"), F.col("why")).alias("proposed"),
        F.when(matched, F.coalesce("p_from", "key_from", by_dump["from"], artist_annotation_source(F.col("artist"))))
        .alias("from"),
        F.when(matched, F.coalesce("p_language", "key_language")).alias("language"),
        F.col("credit"), "artist_ids", "recording", "recording_id", "release", "row_no",
        F.when(matched, F.when(F.col("p_title").isNotNull(), by_hand["title"]).otherwise(by_dump["title"]))
        .alias("title"),
        F.when(matched, ~is_placeholder(F.col("credit")) & ((F.col("how") < 8) | F.col("p_why").isNotNull()))
        .alias("trusted"),
        F.when(matched, is_placeholder(F.col("credit"))).alias("placeholder"),
    )


def match_catalog(
    catalog: DataFrame, dump: DataFrame, proposals: DataFrame | None = None, works: DataFrame | None = None,
    mode: str = "fold",
) -> DataFrame:
    """The whole offline match: post-level match rows from raw inputs."""
    songs, put, members = questions(catalog, proposals)
    best = match_songs(songs, cut_lineage(link.prepare_dump(dump)), put if proposals is not None else None, mode)
    held = members.join(best.withColumnRenamed("post_id", "ask_id"), "ask_id").drop("ask_id")
    return finished(catalog, held, proposals, works)
