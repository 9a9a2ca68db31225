"""Composition: corrections and hand overrides over the catalogue, credits, slugs, artist pages.

Overrides are three-state. A null column means the field is absent; an empty string is a
decision to show nothing. Where a source must tell an explicit null from an absent field it
brings ``present``, the array of field names its JSON object held (``sources.read_overrides``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions.text import slugify
from refrain.operators.enrich import top_k
from refrain.session import cut_lineage

CREDIT = "array<struct<artist_id:string,name:string>>"


def _has(overrides: DataFrame, field: str) -> Column:
    named = F.col(f"`o_{field}`").isNotNull()
    return F.coalesce(F.array_contains("o_present", field) if "present" in overrides.columns else named, F.lit(False))


def published_artist(artist: Column, fixed_artist: Column, fixed_artists: Column, override: Column) -> Column:
    """The performer to check elsewhere: a correction's names beat an override, an emptied artist beats all."""
    joined = F.when(F.size(fixed_artists) > 0, F.array_join(F.transform(fixed_artists, lambda a: a["name"]), " & "))
    return F.when(override == "", F.lit("")).otherwise(F.coalesce(joined, fixed_artist, override, artist))


def published_song(title: Column, fixed_title: Column, override: Column) -> Column:
    return F.coalesce(override, fixed_title, title)


def keeps_enrichment(override_given: Column, artist_given: Column, artist: Column, own: Column, matched: Column) -> Column:
    """Whether a dump's year and genres survive an override: not past an emptied or a different artist."""
    return (
        F.when(~override_given, True)
        .when(artist_given & (F.coalesce(artist, F.lit("")) == ""), False)
        .when(F.coalesce(F.size(own), F.lit(0)) <= 0, True)
        .when(F.coalesce(F.size(matched), F.lit(0)) <= 0, True)
        .otherwise(F.arrays_overlap(own, matched))
    )


def _named(members: DataFrame, records: DataFrame, names: DataFrame) -> DataFrame:
    """(post_id, artists): credits with curated, recorded or given names; nameless ones drop out."""
    named = members.join(records.select("artist_id", F.col("name").alias("recorded")), "artist_id", "left").join(
        names.select("artist_id", F.col("name").alias("curated")), "artist_id", "left"
    ).withColumn("name", F.coalesce("curated", "recorded", "given")).filter(F.col("name").isNotNull())
    return named.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("at", "artist_id", "name"))).alias("a")) \
        .select("post_id", F.transform("a", lambda a: F.struct(
            a["artist_id"].alias("artist_id"), a["name"].alias("name")
        )).alias("artists"))


def compose(
    catalog: DataFrame, corrections: DataFrame, overrides: DataFrame, records: DataFrame, names: DataFrame
) -> DataFrame:
    """The catalogue to show: two left joins and one rule per field.

    ``catalog``: post_id, id, artist, song. ``corrections``: post_id, artist, sort_as, title, from,
    language, artist_ids, artists, genres, year. ``overrides``: post_id, artist, sort_as, title,
    from, categories, language, year, genres, artists[, present].
    """
    c = corrections.select("post_id", *[F.col(f"`{n}`").alias(f"c_{n}") for n in (
        "artist", "sort_as", "title", "from", "language", "artist_ids", "artists", "genres", "year"
    )])
    o = overrides.select("post_id", F.lit(True).alias("overridden"), *[
        F.col(f"`{n}`").alias(f"o_{n}") for n in overrides.columns if n != "post_id"
    ])
    rows = catalog.join(c, "post_id", "left").join(o, "post_id", "left")
    given = F.coalesce("overridden", F.lit(False))
    has_artist = _has(overrides, "artist")
    matched = F.array_union(
        F.coalesce("c_artist_ids", F.array().cast("array<string>")),
        F.coalesce(F.transform("c_artists", lambda a: a["artist_id"]), F.array().cast("array<string>")),
    )
    own = F.transform("o_artists", lambda a: a["artist_id"])
    keep = keeps_enrichment(given, has_artist, F.col("o_artist"), own, matched)
    source = (
        F.when(F.size("o_artists") > 0, F.col("o_artists"))
        .when(has_artist, F.lit(None).cast(CREDIT))
        .when(F.size("c_artists") > 0, F.col("c_artists"))
        .otherwise(F.transform("c_artist_ids", lambda i: F.struct(
            i.alias("artist_id"), F.lit(None).cast("string").alias("name")
        )))
    )
    shown = rows.withColumns({
        "shown_artist": F.when(has_artist, F.coalesce("o_artist", F.lit(""))).otherwise(F.coalesce("c_artist", "artist")),
        "shown_title": F.coalesce("o_title", "c_title", "song"),
        "shown_from": F.when(_has(overrides, "from"), F.nullif("o_from", F.lit(""))).otherwise(F.col("c_from")),
        "shown_categories": F.when(F.size("o_categories") > 0, F.col("o_categories")),
        "shown_language": F.coalesce("o_language", "c_language"),
        "shown_year": F.when(_has(overrides, "year"), F.col("o_year")).when(keep, F.col("c_year")),
        "shown_genres": F.when(_has(overrides, "genres"), F.col("o_genres")).when(keep, F.col("c_genres")),
        "credits": source, "sort_as": F.coalesce("o_sort_as", "c_sort_as"),
    })
    members = shown.select("post_id", F.posexplode("credits").alias("at", "m")).select(
        "post_id", "at", "m.artist_id", F.col("m.name").alias("given")
    )
    return shown.join(_named(members, records, names), "post_id", "left").select(
        "post_id", "id", F.col("shown_artist").alias("artist"), F.col("shown_title").alias("song"), "artists",
        F.col("shown_genres").alias("genres"), F.col("shown_year").alias("year"), F.col("shown_from").alias("from"),
        F.col("shown_categories").alias("categories"), F.col("shown_language").alias("language"),
        F.coalesce("sort_as", F.col("shown_artist")).alias("sort_as"),
        ((F.col("shown_artist") != F.col("artist")) | (F.col("shown_title") != F.col("song"))
         | F.col("shown_categories").isNotNull() | F.col("shown_from").isNotNull()).alias("corrected"),
    )


def credited_index(songs: DataFrame, order: list[Column]) -> DataFrame:
    """(artist_id, credited, seq): each credited id once, with the name of its first credit."""
    members = songs.select(F.struct(*order).alias("o"), F.posexplode("artists").alias("at", "a"))
    return members.groupBy("a.artist_id").agg(
        F.min_by(F.col("a.name"), F.struct("o", "at")).alias("credited"), F.min(F.struct("o", "at")).alias("seq")
    )


def assign_slugs(artists: DataFrame, names: DataFrame) -> DataFrame:
    """(artist_id, slug): curated slugs first (shared on purpose), then name, type, note, id.

    ``artists`` has artist_id, name, type, disambiguation and an orderable seq; ``names`` has
    artist_id, slug. Artists choose in order of first appearance of their name's slug, then of
    their own, each the first wish nobody before them holds, whatever name that one has. Choosing
    in turn has one outcome, and it is reached set-wise: all ask for their wish, the earliest asker
    of a slug holds it, the others move on to their next wish, until nobody has to move.
    """
    curated = cut_lineage(artists.join(names.filter(F.coalesce(F.col("slug"), F.lit("")) != "").select(
        "artist_id", slugify(F.col("slug")).alias("slug")
    ), "artist_id").select("artist_id", "slug"))
    taken = curated.select(F.col("slug").alias("wish"), F.lit(True).alias("reserved")).distinct()
    rest = artists.filter(F.col("name").isNotNull()).join(curated, "artist_id", "left_anti").withColumn("base", slugify(F.col("name")))
    groups = rest.groupBy("base").agg(F.count(F.lit(1)).alias("sharing"), F.min("seq").alias("first"))
    short = F.concat_ws("-", "base", F.substring("artist_id", 1, 8))
    note = F.nullif("disambiguation", F.lit(""))
    asking = cut_lineage(rest.join(groups, "base").select(
        "artist_id", F.struct("first", "seq").alias("turn"), F.lit(0).alias("at"),
        F.array_compact(F.array(
            F.when(F.col("sharing") == 1, F.col("base")),
            F.when(F.col("type").isNotNull(), F.concat_ws("-", "base", slugify(F.col("type")))),
            F.when(note.isNotNull(), F.concat_ws("-", "base", slugify(note))),
            short, F.concat_ws("-", short, F.substring("artist_id", 1, 8)),
        )).alias("wishes"),
    ))
    while True:
        asked = asking.withColumn("wish", F.get("wishes", F.col("at")))
        holders = asked.groupBy("wish").agg(F.min("turn").alias("holder")).join(taken, "wish", "left")
        beaten = (F.col("reserved").isNotNull() | (F.col("holder") != F.col("turn"))) & (F.col("at") < F.size("wishes") - 1)
        asking = cut_lineage(asked.join(holders, "wish").select(
            "artist_id", "turn", (F.col("at") + beaten.cast("int")).alias("at"), "wishes", beaten.alias("moved")
        ))
        if not asking.filter("moved").limit(1).count():
            break
        asking = asking.drop("moved")
    return curated.unionByName(asking.select("artist_id", F.get("wishes", F.col("at")).alias("slug")))


def with_slugs(songs: DataFrame, slugs: DataFrame) -> DataFrame:
    """Credits of each song with slugs; a credit without one is dropped."""
    members = songs.select("post_id", F.posexplode("artists").alias("at", "a")).select(
        "post_id", "at", "a.artist_id", "a.name"
    ).join(slugs, "artist_id")
    nested = members.groupBy("post_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "artist_id", "slug", "name"))).alias("c")
    ).select("post_id", F.transform("c", lambda c: F.struct(
        c["artist_id"].alias("artist_id"), c["slug"].alias("slug"), c["name"].alias("name")
    )).alias("artists"))
    return songs.drop("artists").join(nested, "post_id", "left")


def artist_genres(slugs: DataFrame, records: DataFrame, k: int = 5) -> DataFrame:
    """(slug, genre, votes, position): votes of all ids behind a slug, top k."""
    votes = slugs.join(records.select("artist_id", F.explode("genres").alias("g")), "artist_id").groupBy(
        "slug", F.col("g.name").alias("genre")
    ).agg(F.sum("g.count").alias("votes"))
    return top_k(votes, ["slug"], [F.desc("votes"), F.collate("genre", "sv")], k)


def artist_pages(songs: DataFrame, slugs: DataFrame, records: DataFrame, names: DataFrame, seq: DataFrame) -> DataFrame:
    """One row per slug with a song: preferred id (first person, else first), name, sort name, songs, genres.

    ``songs`` carries slugged credits; ``seq`` is ``credited_index``.
    """
    members = slugs.join(seq, "artist_id").join(
        records.select("artist_id", F.col("name").alias("recorded"), "sort_name", "type"), "artist_id", "left"
    ).join(names.select("artist_id", F.col("name").alias("curated")), "artist_id", "left")
    preferred = members.groupBy("slug").agg(F.min_by(
        F.struct("artist_id", F.coalesce("curated", "recorded", "credited").alias("name"), "sort_name"),
        F.struct(F.when(F.col("type") == "Person", 0).otherwise(1), "seq"),
    ).alias("p"), F.count(F.lit(1)).alias("ids"))
    counts = songs.select("post_id", F.explode("artists").alias("a")).select("post_id", "a.slug").distinct().groupBy(
        "slug"
    ).agg(F.count(F.lit(1)).alias("songs"))
    genres = artist_genres(slugs, records).groupBy("slug").agg(
        F.array_sort(F.collect_list(F.struct("position", "genre"))).alias("g")
    ).select("slug", F.transform("g", lambda g: g["genre"]).alias("genres"))
    return preferred.join(counts, "slug").join(genres, "slug", "left").select(
        "slug", "p.artist_id", "p.name", "p.sort_name", "ids", "songs", "genres"
    )


def slug_review(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Each page with how its slug came about: merged, curated, disambiguated or plain."""
    curated = names.filter(F.coalesce(F.col("slug"), F.lit("")) != "").select(
        "artist_id", slugify(F.col("slug")).alias("slug")
    )
    sizes = curated.groupBy("slug").agg(F.count(F.lit(1)).alias("merged_ids"))
    own = curated.select("artist_id", F.lit(True).alias("is_curated"))
    auto = slugify(F.col("name"))
    return pages.join(sizes, "slug", "left").join(own, "artist_id", "left").withColumn("note", (
        F.when(F.col("merged_ids") > 1, "merged")
        .when(F.col("is_curated"), "curated")
        .when(F.col("slug") != auto, "disambiguated")
        .otherwise("plain")
    )).select("slug", "artist_id", "name", "songs", "note", F.coalesce("merged_ids", F.lit(0)).alias("merged_ids"))


def slug_counts(reviewed: DataFrame) -> DataFrame:
    """One row of counts over a slug review: pages, and how many are of each kind."""
    return reviewed.agg(
        F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("note") == n).alias(n) for n in ("merged", "curated", "disambiguated", "plain")]
    )
