"""Browsing: variants, sorts, pages, facets, collections, search and letters.

Songs here are composed rows: post_id, id, artist, song, artists, genres, year, from,
categories, language, sort_as.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.labels import (
    all_categories, collection_label, decade_key, enrichment_score, in_collection, is_labelled_language, performer,
)
from refrain.functions.names import letter_bucket
from refrain.functions.text import js_trim, slugify
from refrain.session import cut_lineage


def variant_key() -> list[Column]:
    """Same performer and title, ignoring case."""
    return [
        F.lower(performer(F.col("artist"), F.col("categories"))).alias("variant_artist"),
        F.lower("song").alias("variant_title"),
    ]


def merge_variants(songs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per artist and title: the richest copy's fields, the lowest number and how many there are.

    ``within`` names columns that songs must share too, such as the collection they are shown in.
    """
    score = enrichment_score(*[F.col(c) for c in ("year", "from", "artists", "genres", "language", "categories")])
    return songs.select(*variant_key(), "*").groupBy(*within, "variant_artist", "variant_title").agg(
        F.min_by(F.struct(*[c for c in songs.columns if c != "id"]), F.struct(-score, "id", "post_id")).alias("m"),
        F.min("id").alias("id"), F.count_distinct("id").alias("n_ids"),
    ).select("id", "n_ids", "m.*")


def variant_members(songs: DataFrame) -> DataFrame:
    """(variant_artist, variant_title, id): the numbers behind each variant, as rows of any count."""
    return songs.select(*variant_key(), "id").distinct()


def sort_columns(by: str, locale: str = "sv") -> list[Column]:
    """Display order, ending on what no two merged songs share; an unknown name sorts by title."""
    title = F.collate("song", locale)
    orders = {
        "artist": [F.collate(performer(F.col("artist"), F.col("categories")), locale), title],
        "year": [F.coalesce("year", F.lit(9999)), title],
        "catalogue": [F.collate("sort_as", locale), title],
    }
    return [*orders.get(by, [title]), F.col("id"), F.col("post_id")]


def sort_songs(songs: DataFrame, by: str = "az", locale: str = "sv") -> DataFrame:
    return songs.orderBy(*sort_columns(by, locale))


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """A global row number without a single-task window.

    Rows are range-partitioned and sorted; each partition numbers its own rows and adds the sizes
    of the partitions before it. Only one count per partition is ever gathered.
    """
    keys = [F.struct(*order).alias("o")]
    ranged = df.select("*", *keys).repartitionByRange("o").sortWithinPartitions("o")
    placed = cut_lineage(ranged.select(
        *df.columns, F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within"),
    ))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(before, "part").select(*df.columns, (F.col("before") + F.col("within") + 1).alias(name))


def paged(df: DataFrame, order: list[Column], size: int = fixed.PAGE_ROWS) -> DataFrame:
    """Global place and zero-based page of every row."""
    return numbered(df, order).withColumn("page", F.floor((F.col("place") - 1) / size))


def paged_by(df: DataFrame, group: list[str], order: list[Column], size: int = fixed.PAGE_ROWS) -> DataFrame:
    """Place and page within each group, for groups of any size: numbered once over (group, order)."""
    placed = numbered(df, [*[F.col(g) for g in group], *order], "overall")
    starts = placed.groupBy(*group).agg(F.min("overall").alias("start"))
    return placed.join(starts, group).withColumn("place", F.col("overall") - F.col("start") + 1).withColumn(
        "page", F.floor((F.col("place") - 1) / size)
    ).drop("overall", "start")


def window_depth(pages: DataFrame, wanted_place: Column, size: int = fixed.PAGE_ROWS) -> DataFrame:
    """How many rows a list must show to reach the wanted row: its place, at least one page.

    ``wanted_place`` is an aggregate over the placed rows, e.g. the place of one number.
    """
    return pages.agg(F.least(
        F.greatest(F.lit(size), F.coalesce(wanted_place, F.lit(0))), F.count(F.lit(1))
    ).alias("rows"))


def memberships(songs: DataFrame) -> DataFrame:
    """(kind, key, post_id): every collection a song belongs to, all five kinds."""
    parts = [
        songs.filter(F.col("year").isNotNull()).select(F.lit("decade").alias("kind"), decade_key(F.col("year")).alias("key"), "post_id"),
        songs.select(F.lit("genre").alias("kind"), F.explode(F.array_distinct("genres")).alias("key"), "post_id"),
        songs.select(F.lit("category").alias("kind"), F.explode(
            all_categories(F.col("categories"), F.col("from"))).alias("key"), "post_id"),
        songs.filter(F.col("from") != "").select(F.lit("from").alias("kind"), F.col("from").alias("key"), "post_id"),
        songs.filter(F.col("language") != "").select(F.lit("lang").alias("kind"), F.col("language").alias("key"), "post_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def facet(songs: DataFrame, kind: str, floor: int = fixed.FACET_FLOOR, top: int = fixed.GENRE_TILES) -> DataFrame:
    """(key, label, songs) of one browsing facet, in display order."""
    counts = memberships(songs).filter(F.col("kind") == kind).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("songs"))
    if kind in ("decade", "genre"):
        counts = counts.filter(F.col("songs") >= floor)
    if kind == "genre":
        counts = counts.orderBy(F.desc("songs"), F.collate("key", "sv")).limit(top)
    if kind == "lang":
        counts = counts.filter(is_labelled_language(F.col("key")))
    labelled = counts.select("key", collection_label(F.col("kind"), F.col("key")).alias("label"), "songs")
    return labelled.orderBy(F.collate("key", "sv"))


def featured(songs: DataFrame, picks: list[tuple[str, str]] = fixed.FEATURED) -> DataFrame:
    """The curated tiles that have at least one song."""
    chosen = songs.sparkSession.createDataFrame(
        [(i, kind, key) for i, (kind, key) in enumerate(picks)], "place int, kind string, key string"
    )
    held = memberships(songs).select("kind", "key").join(chosen, ["kind", "key"], "left_semi").distinct()
    return chosen.join(held, ["kind", "key"], "left_semi").withColumn(
        "label", collection_label(F.col("kind"), F.col("key"))
    ).orderBy("place")


def collection_lists(songs: DataFrame) -> DataFrame:
    """Every collection's list: variants merged inside the collection, in title order, with place and page."""
    members = memberships(songs).join(songs, "post_id")
    return paged_by(merge_variants(members, ("kind", "key")), ["kind", "key"], sort_columns("az"))


def all_collections(songs: DataFrame) -> DataFrame:
    """(kind, slug, key, songs): each collection page once; the first key in order owns a shared slug."""
    counts = memberships(songs).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("songs")).withColumn(
        "slug", slugify(F.col("key"))
    )
    return counts.groupBy("kind", "slug").agg(
        F.min_by(F.struct("key", "songs"), F.struct(F.collate("key", "sv"), "key")).alias("m")
    ).select("kind", "slug", "m.key", "m.songs")


def resolve_collection(songs: DataFrame, kind: str, slug: str) -> DataFrame:
    return all_collections(songs).filter((F.col("kind") == kind) & (F.col("slug") == slug)).withColumn(
        "label", collection_label(F.col("kind"), F.col("key"))
    )


def songs_in_collection(songs: DataFrame, kind: str, key: str) -> DataFrame:
    return songs.filter(in_collection(kind, key))


def distinct_sorted(df: DataFrame, column: str, locale: str = "sv") -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.collate(column, locale))


def songs_by_artist(songs: DataFrame, slug: str | None = None) -> DataFrame:
    """(slug, song row): each song once under every artist page it is credited on."""
    members = songs.withColumn("credit", F.explode(F.array_distinct(F.transform("artists", lambda a: a["slug"]))))
    named = members.select(F.col("credit").alias("slug"), *songs.columns)
    if slug is not None:
        named = named.filter(F.col("slug") == slug)
    return named.orderBy("slug", F.collate("song", "sv"), "id", "post_id")


def search_index(songs: DataFrame) -> DataFrame:
    """Search rows: merged variants with explicit and derived categories, empty lists as null."""
    merged = merge_variants(songs)
    categories = all_categories(F.col("categories"), F.col("from"))
    return merged.select(
        *variant_key(), "id", F.col("song").alias("title"), "artist", "from",
        F.when(F.size(categories) > 0, categories).alias("categories"), "year",
        F.when(F.size("genres") > 0, F.col("genres")).alias("genres"), "language", "artists", "sort_as",
    )


def search_text() -> Column:
    empty = F.lit("")
    return F.lower(F.concat_ws(
        " ", F.nullif("title", empty), F.nullif("artist", empty), F.nullif("from", empty), "categories", "genres"
    ))


def matches_query(query: str) -> Column:
    """Whether a search row's text holds the query; matches may run across fields."""
    asked = query.strip().lower()
    return F.contains(search_text(), F.lit(asked)) if asked else F.lit(False)


def search_songs(index: DataFrame, members: DataFrame, query: str, limit: int | None = fixed.SEARCH_SONGS) -> DataFrame:
    """Hits in catalogue order: any number that begins with a numeric query, else text."""
    asked = query.strip()
    hit = matches_query(query)
    if asked.isascii() and asked.isdigit():
        numbers = members.filter(F.startswith(F.col("id").cast("string"), F.lit(asked))).select(
            "variant_artist", "variant_title"
        ).distinct().withColumn("by_number", F.lit(True))
        index = index.join(numbers, ["variant_artist", "variant_title"], "left")
        hit = hit | F.coalesce("by_number", F.lit(False))
    found = index.filter(hit).select("id", "title", "artist", "from", "year", "sort_as")
    ordered = found.orderBy(F.collate("sort_as", "sv"), F.collate("title", "sv"), "id")
    return ordered if limit is None else ordered.limit(limit)


#: Letters that a posting is filed under.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct pieces of ``size`` letters, none of a shorter text."""
    places = F.when(F.char_length(text) >= size, F.sequence(F.lit(1), F.char_length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, size)))


#: What tells search rows apart.
VARIANT = ["variant_artist", "variant_title"]


def postings(index: DataFrame) -> DataFrame:
    """(gram, variant): every search row under each of its pieces of one to three letters; write it once."""
    rows = index.select(*VARIANT, search_text().alias("text"))
    pieces = F.flatten(F.array(*[_grams(F.col("text"), F.lit(n)) for n in range(1, GRAM + 1)]))
    return rows.select(F.explode(pieces).alias("gram"), *VARIANT)


def search_batch(queries: DataFrame, filed: DataFrame, index: DataFrame) -> DataFrame:
    """(query, search row) for all search rows whose text holds each query of a table of queries.

    ``queries``: query; ``filed`` comes from ``postings`` of the index. A query asks under one piece only, that which
    fewest rows hold, and what it finds is checked on the whole text, once for queries that ask the same. A blank
    query finds nothing; numbers are looked for in the text like other words.
    """
    asked = queries.select("query", F.lower(F.trim("query")).alias("asked")).distinct().filter(F.col("asked") != "")
    distinct = asked.select("asked").distinct()
    pieces = distinct.select("asked", F.explode(_grams(F.col("asked"), F.least(F.lit(GRAM), F.char_length("asked")))).alias("gram"))
    held = filed.join(pieces.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    # A piece that no row holds settles its question: nothing is found.
    known = pieces.join(held, "gram", "left").groupBy("asked").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram")).alias("p"))
    rarest = known.filter("p.rows > 0").select("asked", "p.gram")
    maybe = rarest.join(filed, "gram").select("asked", *VARIANT)
    texts = index.select(*VARIANT, search_text().alias("text"))
    found = maybe.join(texts, VARIANT).filter(F.contains("text", "asked")).select("asked", *VARIANT)
    return asked.join(found, "asked").drop("asked").join(index, VARIANT)


def search_artists(artists: DataFrame, query: str, limit: int = fixed.SEARCH_ARTISTS) -> DataFrame:
    """Artist hits by name, first in display order."""
    asked = query.strip().lower()
    hits = artists.filter(F.contains(F.lower("name"), F.lit(asked)) if asked else F.lit(False))
    return hits.orderBy(F.collate("name", "sv"), "slug").limit(limit)


def letter_runs(artists: DataFrame) -> DataFrame:
    """Runs of one letter in the sorted artist list: (run, letter, artists); ``#`` may come twice.

    A run starts where the letter differs from the row before, found by joining consecutive
    places; only run starts are windowed.
    """
    placed = numbered(
        artists.select("name", "slug", letter_bucket(F.col("name")).alias("letter")),
        [F.collate("name", "sv"), F.col("slug")],
    )
    before = placed.select((F.col("place") + 1).alias("place"), F.col("letter").alias("previous"))
    starts = placed.join(before, "place", "left").filter(
        F.col("previous").isNull() | (F.col("previous") != F.col("letter"))
    ).select("place", "letter")
    end = placed.agg((F.count(F.lit(1)) + 1).alias("place")).withColumn("letter", F.lit(None).cast("string"))
    order = Window.orderBy("place")
    return starts.unionByName(end).select(
        F.row_number().over(order).alias("run"), "letter", (F.lead("place").over(order) - F.col("place")).alias("artists")
    ).filter(F.col("letter").isNotNull())


def letter_page(artists: DataFrame, letter: str) -> DataFrame:
    return artists.filter(letter_bucket(F.col("name")) == letter).orderBy(F.collate("name", "sv"), "slug")


def trimmed_query(c: Column) -> Column:
    return F.lower(js_trim(c))
