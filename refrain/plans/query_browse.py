"""Registered queries over browsing, search and favourites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.labels import enrichment_score, performer, song_meta, subtitle
from refrain.operators import browse, favourites, overlay
from refrain.plans import standins
from refrain.session import cut_lineage


def _values(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def _case(table: dict[str, str], column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


SHOWN = "coalesce(nullif(artist, ''), category, '')"
SONGS = f"""songs AS MATERIALIZED (SELECT *, {SHOWN} AS performer,
    2 * (year IS NOT NULL)::INT + 2 * coalesce("from" <> '', false)::INT + 2 * (artist <> '')::INT + 1
      + coalesce(language <> '', false)::INT + (category IS NOT NULL)::INT AS score FROM ({standins.sql(standins.SONGS)})),
shows AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{s.replace(chr(39), chr(39) * 2)}')" for c, l in fixed.SHOWS_BY_CATEGORY.items() for s in l)}) t(category, film)),
cats AS MATERIALIZED (SELECT post_id, category FROM songs WHERE category IS NOT NULL
    UNION SELECT s.post_id, h.category FROM songs s JOIN shows h ON h.film = s."from"
    UNION SELECT post_id, "from" FROM songs WHERE "from" IN ({_values(fixed.CONTESTS)})),
members AS MATERIALIZED (SELECT 'decade' AS kind, CAST(CAST(floor(year / 10) * 10 AS INT) AS STRING) AS key, post_id FROM songs WHERE year IS NOT NULL
    UNION ALL SELECT 'genre', genre_a, post_id FROM songs UNION ALL SELECT 'genre', genre_b, post_id FROM songs WHERE genre_b IS NOT NULL
    UNION ALL SELECT 'category', category, post_id FROM cats
    UNION ALL SELECT 'from', "from", post_id FROM songs WHERE "from" <> '' UNION ALL SELECT 'lang', language, post_id FROM songs WHERE language <> ''),
counts AS MATERIALIZED (SELECT kind, key, count(*) AS songs FROM members GROUP BY ALL),
variants AS MATERIALIZED (SELECT * EXCLUDE (id, n), min_id AS id FROM (SELECT *, lower(performer) AS va, lower(song) AS vt,
    min(id) OVER (PARTITION BY lower(performer), lower(song)) AS min_id,
    row_number() OVER (PARTITION BY lower(performer), lower(song) ORDER BY score DESC, id, post_id) AS n FROM songs) WHERE n = 1)"""
GENRE = "CASE key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SPECIAL_GENRES.items()) + \
    " ELSE upper(substring(key, 1, 1)) || substring(key, 2) END"


def _facet(kind: str, **options: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return browse.facet(standins.songs(spark, sf_dir), kind, **options)

    return query


def featured_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.featured(standins.songs(spark, sf_dir)).select("kind", "key", "label")


def category_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.memberships(standins.songs(spark, sf_dir)).filter(F.col("kind") == "category").select("post_id", "key")


def all_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.all_collections(standins.songs(spark, sf_dir))


def resolve_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.resolve_collection(standins.songs(spark, sf_dir), "genre", "hip-hop")


def collection_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = standins.songs(spark, sf_dir)
    return browse.songs_in_collection(songs, "category", "Disney").select("post_id", "song")


def variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = browse.merge_variants(standins.songs(spark, sf_dir))
    return merged.select("id", "n_ids", "post_id", "artist", "song", "year", "from", "language")


def variant_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.variant_members(standins.songs(spark, sf_dir))


def song_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second line, short line and richness of every song row."""
    c = {n: F.col(n) for n in ("artist", "categories", "from", "year", "artists", "genres", "language")}
    return standins.songs(spark, sf_dir).select(
        "post_id", subtitle(c["artist"], c["categories"], c["from"], c["year"]).alias("line"),
        song_meta(c["from"], c["year"]).alias("meta"), performer(c["artist"], c["categories"]).alias("performer"),
        enrichment_score(c["year"], c["from"], c["artists"], c["genres"], c["language"], c["categories"]).alias("score"),
    )


def _page(by: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        merged = browse.merge_variants(standins.songs(spark, sf_dir))
        return browse.paged(merged, browse.sort_columns(by)).select("id", "song", "place", "page")

    return query


def collection_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection's list in title order with place and page."""
    lists = browse.collection_lists(standins.songs(spark, sf_dir))
    return lists.select("kind", "key", "post_id", "id", "n_ids", "place", "page")


def window_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to show to reach each half of the list's last number."""
    merged = browse.merge_variants(standins.songs(spark, sf_dir))
    pages = browse.paged(merged, browse.sort_columns("az"))
    return browse.window_depth(pages, -F.max(F.struct("id", (-F.col("place")).alias("up")))["up"]).select(F.col("rows").cast("long").alias("rows"))


def _artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "supplier").select(
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN '#' || CAST(s_suppkey AS STRING) WHEN s_suppkey % 7 = 1 THEN 'Örn ' || CAST(s_suppkey AS STRING) "
               "WHEN s_suppkey % 7 = 2 THEN 'Åke ' || CAST(s_suppkey AS STRING) ELSE chr(CAST(65 + s_nationkey AS INT)) || 'li ' || CAST(s_suppkey AS STRING) END").alias("name"),
        F.col("s_suppkey").cast("string").alias("slug"),
    )


NAMED = """artists AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN '#' || CAST(s_suppkey AS STRING) WHEN s_suppkey % 7 = 1 THEN 'Örn ' || CAST(s_suppkey AS STRING)
    WHEN s_suppkey % 7 = 2 THEN 'Åke ' || CAST(s_suppkey AS STRING) ELSE chr(CAST(65 + s_nationkey AS INT)) || 'li ' || CAST(s_suppkey AS STRING) END AS name,
    CAST(s_suppkey AS STRING) AS slug FROM supplier)"""


def artist_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.letter_runs(_artists(spark, sf_dir)).select(F.col("run").cast("long").alias("run"), "letter", "artists")


def letter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artists under one letter of the list."""
    return browse.letter_page(_artists(spark, sf_dir), "L").select("name", "slug")


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = standins.songs(spark, sf_dir)
    return browse.search_songs(browse.search_index(songs), browse.variant_members(songs), " Anvil ").drop("sort_as")


def search_across_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that runs over the end of the title into the artist."""
    songs = standins.songs(spark, sf_dir)
    return browse.search_songs(browse.search_index(songs), browse.variant_members(songs), "bolt brand#1", None).drop("sort_as")


def search_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = standins.songs(spark, sf_dir)
    return browse.search_songs(browse.search_index(songs), browse.variant_members(songs), "12", None).drop("sort_as")


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every song's second title word on, and its artist's end, as questions to all search rows at once."""
    songs = standins.songs(spark, sf_dir)
    index = cut_lineage(browse.search_index(songs))
    queries = songs.select(F.explode(F.array(F.expr(QUERY), F.expr("substring(artist, -4)"))).alias("query")).distinct()
    return browse.search_batch(queries, cut_lineage(browse.postings(index)), index).select("query", "id", "title")


QUERY = "CASE WHEN post_id % 50 = 0 THEN ' ' WHEN post_id % 50 = 1 THEN 'zq' ELSE substring(song, instr(song, ' ')) || ' ' || artist END"


def search_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.search_artists(_artists(spark, sf_dir), "LI 1")


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text match over whole documents."""
    docs = standins.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("source").alias("artist"), F.col("lang").alias("from"),
        F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("array<string>").alias("genres"),
    )
    return docs.filter(browse.matches_query("and the")).select("doc_id")


def songs_by_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.songs_by_artist(standins.songs(spark, sf_dir)).select("slug", "post_id", "song")


def artist_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all brands, two of them merged onto one slug, with the slug review's note."""
    songs = standins.songs(spark, sf_dir)
    seq = overlay.credited_index(songs, [F.col("id"), F.col("post_id")])
    records = _brand_records(spark, sf_dir)
    names = records.filter(F.col("artist_id").isin("brand#2", "brand#3")).select(
        "artist_id", F.lit("Twins").alias("name"), F.lit("twins").alias("slug")
    )
    slugs = overlay.assign_slugs(
        seq.join(records.select("artist_id", "name", "type"), "artist_id").withColumn("disambiguation", F.lit(None).cast("string")), names
    )
    pages = overlay.artist_pages(overlay.with_slugs(songs, slugs), slugs, records, names, seq)
    noted = overlay.slug_review(pages, names).select("slug", "note")
    return pages.join(noted, "slug").select(
        "slug", "artist_id", "name", "ids", "songs", F.array_join("genres", ",").alias("genres"), "note"
    )


def _brand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = standins.table(spark, sf_dir, "part").groupBy(
        F.lower("p_brand").alias("artist_id"), F.lower("p_type").alias("name")
    ).agg(F.count(F.lit(1)).alias("count"))
    return votes.groupBy("artist_id").agg(F.collect_list(F.struct("name", "count")).alias("genres")).select(
        "artist_id", F.concat(F.lit("The "), "artist_id").alias("name"), F.concat(F.lit("sort "), "artist_id").alias("sort_name"),
        F.when(F.col("artist_id") > "brand#2", "Person").otherwise("Group").alias("type"), "genres",
    )


def _toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return standins.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", k.alias("k"))


def favourites_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events toggle rows of two numbers each that always come together."""
    low = F.col("k") - F.col("k") % 2
    return favourites.fold_favourites(_toggles(spark, sf_dir).withColumn("ids", F.array(low, low + 1)))


def favourites_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events toggle rows that overlap their neighbours, so order decides."""
    return favourites.fold_favourites(_toggles(spark, sf_dir).withColumn("ids", F.array("k", F.col("k") + 1)))


def favourites_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = browse.variant_members(standins.songs(spark, sf_dir))
    return favourites.favourite_rows(favourites_state(spark, sf_dir), members)


TOGGLES = """toggles AS (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
STEADY = f"""{TOGGLES}, held AS (SELECT user_id, unnest([k - k % 2, k - k % 2 + 1]) AS id FROM
    (SELECT user_id, k - k % 2 AS k, count(*) AS n FROM toggles GROUP BY ALL) WHERE n % 2 = 1)"""
ORDERS = {
    "az": "song COLLATE sv, id, post_id", "artist": "performer COLLATE sv, song COLLATE sv, id, post_id",
    "year": "coalesce(year, 9999), song COLLATE sv, id, post_id", "catalogue": "artist COLLATE sv, song COLLATE sv, id, post_id",
}


def _texts() -> str:
    return f"""WITH {SONGS}, texts AS (SELECT *, lower(concat_ws(' ', song, nullif(artist, ''), nullif("from", ''),
            (SELECT string_agg(category, ' ' ORDER BY (c.category <> coalesce(variants.category, '')), category) FROM cats c WHERE c.post_id = variants.post_id),
            genre_a, genre_b)) AS t FROM variants)"""


def _found(condition: str, limit: str = "") -> str:
    return f"""{_texts()}
        SELECT id, song AS title, artist, "from", year FROM texts WHERE {condition}
        ORDER BY artist COLLATE sv, song COLLATE sv, id {limit}"""


QUERIES = {
    "facet_decades": (_facet("decade"), f"""WITH {SONGS} SELECT key, substring(key, 3) || 's' AS label, songs FROM counts
        WHERE kind = 'decade' AND songs >= 20"""),
    "facet_genres": (_facet("genre"), f"WITH {SONGS} SELECT key, {GENRE} AS label, songs FROM counts WHERE kind = 'genre' AND songs >= 20 ORDER BY songs DESC, key LIMIT 40"),
    "facet_categories": (_facet("category"), f"WITH {SONGS} SELECT key, key AS label, songs FROM counts WHERE kind = 'category'"),
    "facet_films": (_facet("from"), f"WITH {SONGS} SELECT key, key AS label, songs FROM counts WHERE kind = 'from'"),
    "facet_languages": (_facet("lang"), f"""WITH {SONGS} SELECT key, {_case(fixed.LANGUAGE_LABELS, 'key', 'key')} AS label, songs FROM counts
        WHERE kind = 'lang' AND key IN ({_values(list(fixed.LANGUAGE_LABELS))})"""),
    "featured_tiles": (featured_tiles, f"""WITH {SONGS}, picks AS (SELECT * FROM (VALUES {", ".join(str(p) for p in fixed.FEATURED)}) t(kind, key))
        SELECT kind, key, CASE kind WHEN 'decade' THEN substring(key, 3) || 's' WHEN 'lang' THEN {_case(fixed.LANGUAGE_LABELS, 'key', 'key')}
            WHEN 'genre' THEN {GENRE} ELSE key END AS label FROM picks JOIN counts USING (kind, key)"""),
    "category_derive": (category_derive, f"WITH {SONGS} SELECT post_id, category AS key FROM cats"),
    "all_collections": (all_collections, f"""WITH {SONGS} SELECT kind, trim(regexp_replace(replace(lower(key), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug, key, songs FROM counts"""),
    "resolve_collection": (resolve_collection, f"""WITH {SONGS} SELECT kind, 'hip-hop' AS slug, key, songs, 'Hip hop' AS label FROM counts
        WHERE kind = 'genre' AND key = 'hip hop'"""),
    "collection_songs": (collection_songs, f"WITH {SONGS} SELECT post_id, song FROM songs WHERE post_id IN (SELECT post_id FROM cats WHERE category = 'Disney')"),
    "variant_merge": (variant_merge, f"""WITH {SONGS}, n AS (SELECT lower(performer) AS va, lower(song) AS vt, count(DISTINCT id) AS n_ids FROM songs GROUP BY ALL)
        SELECT id, n_ids, post_id, artist, song, year, "from", language FROM variants JOIN n USING (va, vt)"""),
    "variant_members": (variant_members, f"WITH {SONGS} SELECT DISTINCT lower(performer) AS variant_artist, lower(song) AS variant_title, id FROM songs"),
    "song_lines": (song_lines, f"""WITH {SONGS} SELECT post_id, concat_ws(' · ', nullif(performer, ''), nullif("from", ''), CAST(year AS STRING)) AS line,
        concat_ws(' · ', nullif("from", ''), CAST(year AS STRING)) AS meta, performer, score FROM songs"""),
    **{f"browse_page_{by}": (_page(by), f"""WITH {SONGS} SELECT id, song, place, CAST(floor((place - 1) / 80) AS BIGINT) AS page FROM
        (SELECT id, song, row_number() OVER (ORDER BY {order}) AS place FROM variants)""") for by, order in ORDERS.items()},
    "collection_pages": (collection_pages, f"""WITH {SONGS}, inside AS (SELECT kind, key, post_id, song, lower(performer) AS va, lower(song) AS vt, id, score FROM members JOIN songs USING (post_id)),
        richest AS (SELECT kind, key, va, vt, post_id, song FROM inside QUALIFY row_number() OVER (PARTITION BY kind, key, va, vt ORDER BY score DESC, id, post_id) = 1),
        numbers AS (SELECT kind, key, va, vt, min(id) AS id, count(DISTINCT id) AS n_ids FROM inside GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY song COLLATE sv, id, post_id) AS place FROM richest JOIN numbers USING (kind, key, va, vt))
        SELECT kind, key, post_id, id, n_ids, place, CAST(floor((place - 1) / 80) AS BIGINT) AS page FROM placed"""),
    "window_depth": (window_depth, f"""WITH {SONGS}, placed AS (SELECT id, row_number() OVER (ORDER BY song COLLATE sv, id, post_id) AS place FROM variants)
        SELECT least(greatest(80, (SELECT min(place) FROM placed WHERE id = (SELECT max(id) FROM placed))), count(*)) AS rows FROM placed"""),
    "artist_letters": (artist_letters, f"""WITH {NAMED}, placed AS (SELECT CASE WHEN upper(substring(name, 1, 1)) BETWEEN 'A' AND 'Z' THEN upper(substring(name, 1, 1)) ELSE '#' END AS letter,
            row_number() OVER (ORDER BY name COLLATE sv, slug) AS place FROM artists),
        marked AS (SELECT *, CASE WHEN letter IS DISTINCT FROM lag(letter) OVER (ORDER BY place) THEN 1 ELSE 0 END AS s FROM placed),
        runs AS (SELECT letter, sum(s) OVER (ORDER BY place) AS run FROM marked)
        SELECT CAST(run AS BIGINT) AS run, letter, count(*) AS artists FROM runs GROUP BY ALL"""),
    "letter_page": (letter_page, f"WITH {NAMED} SELECT name, slug FROM artists WHERE upper(substring(name, 1, 1)) = 'L'"),
    "search_rows": (search_rows, _found("contains(t, 'anvil')", "LIMIT 80")),
    "search_across_fields": (search_across_fields, _found("contains(t, 'bolt brand#1')")),
    "search_number": (search_number, _found("""contains(t, '12') OR (va, vt) IN (SELECT (lower(performer), lower(song)) FROM songs
        WHERE starts_with(CAST(id AS STRING), '12'))""")),
    "search_batch": (search_batch, f"""{_texts()}, q AS (SELECT DISTINCT unnest([{QUERY.replace('substring(song, instr', 'substring(song, strpos')}, right(artist, 4)]) AS query FROM songs)
        SELECT query, id, song AS title FROM q JOIN texts ON trim(query) <> '' AND contains(t, lower(trim(query)))"""),
    "search_artists": (search_artists, f"WITH {NAMED} SELECT name, slug FROM artists WHERE contains(lower(name), 'li 1') ORDER BY name COLLATE sv, slug LIMIT 6"),
    "search_documents": (search_documents, """SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', nullif(text, ''), source, lang)), 'and the')"""),
    "songs_by_artist": (songs_by_artist, f"WITH {SONGS} SELECT replace(lower(artist), '#', '-') AS slug, post_id, song FROM songs WHERE artist <> ''"),
    "artist_pages": (artist_pages, f"""WITH {SONGS},
        seqs AS (SELECT lower(artist) AS a, min((id, post_id)) AS seq FROM songs WHERE artist <> '' GROUP BY ALL),
        slugs AS (SELECT a, seq, CASE WHEN a IN ('brand#2', 'brand#3') THEN 'twins' ELSE 'the-' || replace(a, '#', '-') END AS slug FROM seqs),
        pages AS (SELECT slug, arg_min(a, (CASE WHEN a > 'brand#2' THEN 0 ELSE 1 END, seq)) AS artist_id, count(*) AS ids FROM slugs GROUP BY slug),
        sizes AS (SELECT slug, count(*) AS songs FROM songs JOIN slugs ON lower(artist) = a GROUP BY slug),
        votes AS (SELECT slug, lower(p_type) AS genre, count(*) AS n FROM part JOIN slugs ON lower(p_brand) = a GROUP BY ALL),
        tops AS (SELECT slug, string_agg(genre, ',' ORDER BY n DESC, genre) AS genres FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, genre) AS k FROM votes)
            WHERE k <= 5 GROUP BY slug)
        SELECT slug, artist_id, CASE WHEN slug = 'twins' THEN 'Twins' ELSE 'The ' || artist_id END AS name, ids, songs, genres,
            CASE WHEN slug = 'twins' THEN 'merged' ELSE 'plain' END AS note FROM pages JOIN sizes USING (slug) JOIN tops USING (slug)"""),
    "favourites_state": (favourites_state, f"WITH {STEADY} SELECT user_id, id FROM held"),
    "favourites_overlapping": (favourites_overlapping, f"""WITH RECURSIVE {TOGGLES},
        steps AS MATERIALIZED (SELECT user_id, [k, k + 1] AS row, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM toggles),
        fold AS (SELECT user_id, n, row AS held FROM steps WHERE n = 1 UNION ALL SELECT f.user_id, s.n,
            CASE WHEN list_has_any(f.held, s.row) THEN list_filter(f.held, lambda x: NOT list_contains(s.row, x)) ELSE list_concat(f.held, s.row) END
            FROM fold f JOIN steps s ON s.user_id = f.user_id AND s.n = f.n + 1)
        SELECT user_id, unnest(held) AS id FROM (SELECT user_id, held FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)"""),
    "favourites_rows": (favourites_rows, f"""WITH {STEADY}, {SONGS}, m AS (SELECT DISTINCT lower(performer) AS va, lower(song) AS vt, id FROM songs),
        lowest AS (SELECT va, vt, min(id) AS song_id FROM m GROUP BY ALL),
        shown AS (SELECT id, va, vt, song_id FROM m JOIN lowest USING (va, vt) QUALIFY row_number() OVER (PARTITION BY id ORDER BY va DESC, vt DESC) = 1),
        kept AS (SELECT user_id, va, vt, id FROM held JOIN shown USING (id) QUALIFY row_number() OVER (PARTITION BY user_id, song_id ORDER BY id) = 1)
        SELECT user_id, va AS variant_artist, vt AS variant_title, id AS first_id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS place FROM kept"""),
}
