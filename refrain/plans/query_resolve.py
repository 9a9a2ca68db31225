"""Registered queries over resolution, enrichment, overlay and slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.functions.text import combined_lookup
from refrain.operators import enrich, overlay, resolve
from refrain.plans import standins
from refrain.plans.query_link import key
from refrain.session import cut_lineage

# Match rows out of orders: the customer group is the artist string, the suppliers of an order's
# lines are the credited ids. A third of the lines credit one act per group, so majorities exist.
LINE_ID = "'s' || CAST(CASE WHEN l_partkey % 3 = 0 THEN o_custkey % 40 ELSE l_suppkey END AS STRING)"
MATCH = {
    "post_id": "o_orderkey", "id": "CAST(floor(o_orderkey / 2) AS BIGINT)",
    "artist": "'Act ' || CAST(o_custkey % 40 AS STRING)", "song": "'Song ' || CAST(o_orderkey % 100 AS STRING)",
    "matched": "o_orderstatus <> 'P'",
    "trusted": "o_orderpriority <> '5-LOW' AND o_totalprice >= 20000",
    "placeholder": "o_totalprice < 20000",
    "how": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'version' ELSE 'exact' END",
    "proposed": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'a guess' END",
    "credit": "CASE WHEN o_totalprice < 20000 THEN '[traditional]' ELSE 'Credit ' || CAST(o_orderkey AS STRING) END",
    "recording": "'Song ' || CAST(o_orderkey % 90 AS STRING)", "recording_id": "CAST(o_orderkey AS STRING)",
    "title": "'Song ' || CAST(o_orderkey % 90 AS STRING)",
    "from": "CASE WHEN o_orderkey % 11 = 0 THEN 'Show' END", "language": "CASE WHEN o_orderkey % 4 = 0 THEN 'swe' END",
}
ACT = {
    "artist_id": "'s' || CAST(s_suppkey AS STRING)",
    "name": """CASE WHEN s_acctbal < -500 THEN '[anonymous]' WHEN s_suppkey % 10 = 0 THEN 'Band ' || CAST(s_nationkey AS STRING)
        ELSE 'Band ' || CAST(s_nationkey AS STRING) || ' of ' || CAST(s_suppkey AS STRING) END""",
    "sort_name": "'B' || CAST(s_suppkey AS STRING)",
    "disambiguation": "CASE WHEN s_suppkey % 2 = 0 THEN 'no ' || CAST(s_suppkey AS STRING) END",
    "first_genre": "'g' || CAST(s_nationkey % 4 AS STRING)", "first_votes": "s_suppkey % 4",
    "second_genre": "'h' || CAST(s_nationkey % 3 AS STRING)", "second_votes": "s_suppkey % 3",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in columns.items())


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = standins.table(spark, sf_dir, "orders")
    lines = standins.table(spark, sf_dir, "lineitem").join(
        orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select("o_orderkey", "l_linenumber", F.expr(LINE_ID).alias("i"))
    ids = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "i"))).alias("l"))
    ids = ids.select(F.col("o_orderkey").alias("post_id"), F.transform("l", lambda x: x["i"]).alias("artist_ids"))
    rows = orders.selectExpr(*[f"{text} AS `{name}`" for name, text in MATCH.items()])
    return rows.join(ids, "post_id", "left").withColumn(
        "artist_ids", F.coalesce("artist_ids", F.array().cast("array<string>"))
    )


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.table(spark, sf_dir, "supplier").selectExpr(*[f"{text} AS `{name}`" for name, text in ACT.items()])
    genres = F.array(*[
        F.struct(F.col(f"{n}_genre").alias("name"), F.col(f"{n}_votes").alias("count")) for n in ("first", "second")
    ])
    return rows.select("artist_id", "name", "sort_name", "disambiguation", genres.alias("genres"),
                       F.lit(None).cast("array<string>").alias("aliases"))


MATCHES = f"""
matches AS MATERIALIZED (SELECT m.*, coalesce(i.ids, []) AS ids FROM (SELECT {_select(MATCH)} FROM orders) m LEFT JOIN (
    SELECT o_orderkey AS post_id, list(i ORDER BY l_linenumber, i) AS ids
    FROM (SELECT o_orderkey, l_linenumber, {LINE_ID} AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    GROUP BY o_orderkey) i USING (post_id)),
acts AS MATERIALIZED (SELECT *, CASE WHEN first_votes >= 2 OR second_votes >= 2 THEN 2 ELSE 1 END AS floor FROM (SELECT {_select(ACT)} FROM supplier)),
picks AS MATERIALIZED (SELECT *, concat_ws(',', CASE WHEN first_votes >= floor THEN first_genre END,
    CASE WHEN second_votes >= floor THEN second_genre END) AS genres FROM acts),
votes AS (SELECT artist, ids[1] AS artist_id, count(*) AS songs FROM matches
    WHERE matched AND trusted AND proposed IS NULL AND len(ids) = 1 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY songs DESC, artist_id) AS place,
    coalesce(lead(songs) OVER (PARTITION BY artist ORDER BY songs DESC, artist_id), 0) AS runner_up FROM votes),
majority AS MATERIALIZED (SELECT artist, artist_id, songs, runner_up FROM ranked WHERE place = 1 AND songs > runner_up)"""

DECIDED = f"""WITH {MATCHES},
members AS (SELECT post_id, i, min(pos) AS pos FROM (SELECT post_id, unnest(ids) AS i, generate_subscripts(ids, 1) AS pos FROM matches WHERE matched)
    GROUP BY post_id, i),
credits AS (SELECT m.post_id, count(*) AS n_ids, count(a.name) AS n_known, string_agg(a.name, ', ' ORDER BY m.pos) AS names,
    arg_min(a.sort_name, CASE WHEN a.name IS NOT NULL THEN m.pos END) AS lead_sort,
    arg_min(a.genres, CASE WHEN a.name IS NOT NULL THEN m.pos END) AS lead_genres,
    arg_min(m.i, m.pos) AS first_id, arg_min(coalesce(a.name, ''), m.pos) AS first_name
    FROM members m LEFT JOIN picks a ON a.artist_id = m.i GROUP BY m.post_id),
joined AS (SELECT m.*, coalesce(c.n_ids, 0) AS n_ids, coalesce(c.n_known, 0) AS n_known, c.lead_sort, c.lead_genres, c.first_id, c.first_name,
    CASE WHEN c.n_known = c.n_ids AND c.n_known > 0 THEN c.names ELSE m.credit END AS canonical,
    j.artist_id AS sole_id, s.name AS sole_name, s.sort_name AS sole_sort, s.genres AS sole_genres,
    regexp_replace(lower(c.first_name), '[^a-z0-9]', '', 'g') AS ka, regexp_replace(lower(s.name), '[^a-z0-9]', '', 'g') AS kb
    FROM matches m LEFT JOIN credits c USING (post_id) LEFT JOIN majority j USING (artist) LEFT JOIN picks s ON s.artist_id = j.artist_id),
decided AS MATERIALIZED (SELECT *, CASE WHEN NOT matched THEN 'unmatched'
    WHEN NOT trusted AND proposed IS NULL THEN 'weak'
    WHEN proposed IS NULL AND n_ids = 1 AND sole_id IS NOT NULL AND first_id <> sole_id
      AND NOT coalesce(first_name <> '' AND ka <> kb AND (starts_with(ka, kb) OR starts_with(kb, ka)), false) THEN 'namesake'
    WHEN regexp_matches(canonical, '^\\[.*\\]$') THEN 'placeholder' ELSE 'normal' END AS "case" FROM joined)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided match rows, materialised because every caller reads them more than once."""
    return cut_lineage(resolve.decide(matches(spark, sf_dir), acts(spark, sf_dir)))


def artist_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nested lookup hits, made into artist records."""
    hits = standins.table(spark, sf_dir, "supplier").selectExpr(
        "'s' || CAST(s_suppkey AS STRING) AS id", "s_name AS name", "'B' || CAST(s_suppkey AS STRING) AS sort_name",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'Group' END AS type", "CAST(s_nationkey AS STRING) AS country",
        "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'no ' || CAST(s_suppkey AS STRING) END AS disambiguation",
        """named_struct('begin', CASE WHEN s_acctbal > 0 THEN '1970-05' END, 'end', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '1999' END) AS life_span""",
        """array(named_struct('name', s_name), named_struct('name', upper(s_name)), named_struct('name', 'S' || CAST(s_nationkey AS STRING)),
            named_struct('name', upper(s_name))) AS aliases""")
    return enrich.to_artists(hits).withColumn("aliases", F.array_join("aliases", "|"))


def majority_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.majority_entity(matches(spark, sf_dir))


def resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match row's case and, where it is corrected, what it becomes."""
    decided = _decided(spark, sf_dir)
    resolved = resolve.resolved_songs(decided).select(
        "post_id", F.col("artist").alias("new_artist"), "sort_as", F.col("title").alias("new_title"),
        F.size("artist_ids").alias("n"), F.array_join("genres", ",").alias("genres"), F.col("language").alias("new_language"),
        F.lit(1).alias("corrected"),
    )
    return decided.select("post_id", "case").join(resolved, "post_id", "left").select(
        "post_id", "case", "new_artist", "sort_as", "new_title",
        F.when(F.col("n") > 0, F.col("n").cast("long")).alias("n_ids"), "genres", "new_language",
        F.coalesce("corrected", F.lit(0)).alias("corrected"),
    )


# Lookups beside the matches: dates by an order's first shipping, works, curated names, proposals and overrides.
WORK_TITLE = "CASE WHEN o_orderkey % 3 = 0 THEN upper('Song ' || CAST(o_orderkey % 90 AS STRING)) WHEN o_orderkey % 3 = 1 THEN 'Entirely different words' ELSE '' END"
WORK_LANGUAGE = "CASE WHEN o_orderkey % 5 < 2 THEN 'eng' END"
CURATED = "'Curated ' || CAST(s_suppkey AS STRING)"


def resolve_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with all that is looked up by id: what it becomes, its year and language, and why it waits."""
    orders, lines = (standins.table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    dates = lines.groupBy(F.col("l_orderkey").cast("string").alias("recording_id")).agg(F.year(F.min("l_shipdate")).alias("year"))
    works = orders.select(F.col("o_orderkey").cast("string").alias("recording_id"), F.expr(WORK_TITLE).alias("title"), F.expr(WORK_LANGUAGE).alias("language"))
    dates, works = (enrich.keep_by_id(t, "recording_id", 16) for t in (dates, works))
    names = standins.table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.expr(ACT["artist_id"]).alias("artist_id"), F.expr(CURATED).alias("name"))
    put, settled = (orders.where(c).select(F.col("o_orderkey").alias("post_id")) for c in ("o_orderkey % 7 = 0", "o_orderkey % 6 = 0"))
    decided = cut_lineage(resolve.decide(matches(spark, sf_dir), acts(spark, sf_dir), names, dates, works, put, settled))
    resolved = resolve.resolved_songs(decided).select(
        "post_id", F.col("artist").alias("new_artist"), F.col("title").alias("new_title"), "year", F.col("language").alias("new_language"))
    waiting = resolve.review_entries(decided).select("post_id", "reason")
    return decided.select("post_id", "case").join(resolved, "post_id", "left").join(waiting, "post_id", "left")


def namesake_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).filter(F.col("case") == "namesake").select(
        "post_id", "artist", F.get("ids", F.lit(0)).alias("credited_id"), "sole_id", "sole_name"
    )


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = resolve.review_queue(resolve.review_entries(_decided(spark, sf_dir)))
    return queue.select("post_id", "id", "artist", "song", "reason", "reason_size", "artist_size", "suggestion")


def resolve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = standins.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("recording_id")).agg(
        F.year(F.min("l_shipdate")).alias("year"))
    decided = cut_lineage(resolve.decide(matches(spark, sf_dir), acts(spark, sf_dir), dates=dates))
    return resolve.resolve_summary(decided, resolve.resolved_songs(decided))


# --- enrichment ---------------------------------------------------------------------------


def earliest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dated by the earliest plausible shipping of their name by their brand's act."""
    parts = standins.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.expr("'b' || substring(p_brand, 7)").alias("artist_id")
    )
    pairs = parts.select(F.col("p_partkey").alias("recording_id"), "artist_id", combined_lookup(F.col("p_name")).alias("title_key"))
    lines = standins.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    hits = lines.select(
        F.col("p_name").alias("title"), F.array("artist_id").alias("artist_ids"),
        F.when(F.col("l_returnflag") != "R", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("first_released"),
    )
    acts = parts.select("artist_id").distinct().withColumn(
        "began", F.when(F.col("artist_id") < "b2", F.lit("1994-05")).otherwise(F.lit(None))
    )
    return enrich.earliest_release(pairs, hits, acts)


def date_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = standins.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"))
    return enrich.date_quantiles(dated)


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "customer").groupBy(
        F.expr("'n' || CAST(c_nationkey AS STRING)").alias("artist_id"), F.col("c_mktsegment").alias("name")
    ).agg((F.count(F.lit(1)) - 8).alias("count"))


GENRE_NAME = "CASE WHEN c_acctbal > 9500 THEN lower(c_mktsegment) ELSE 'poor ' || lower(c_mktsegment) END"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genre names: segments of the richest customers; what the others call theirs is no tag's name."""
    return standins.table(spark, sf_dir, "customer").select(F.expr(GENRE_NAME).alias("name")).distinct()


def genre_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.keep_vocabulary(_tags(spark, sf_dir), _vocabulary(spark, sf_dir))


def pick_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = enrich.nested_genres(enrich.keep_vocabulary(_tags(spark, sf_dir), _vocabulary(spark, sf_dir)))
    return nested.select("artist_id", F.array_join(enrich.pick_genres(F.col("genres")), ",").alias("genres"))


def artist_genres_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of all brands behind one page slug (the brand's last digit), top five types."""
    parts = standins.table(spark, sf_dir, "part")
    records = parts.groupBy(F.col("p_brand").alias("artist_id"), F.col("p_type").alias("name")).agg(
        F.count(F.lit(1)).alias("count")
    ).groupBy("artist_id").agg(F.collect_list(F.struct("name", "count")).alias("genres"))
    slugs = parts.select(F.col("p_brand").alias("artist_id"), F.expr("right(p_brand, 1)").alias("slug")).distinct()
    return overlay.artist_genres(slugs, records).select("slug", "genre", "votes", F.col("position").cast("long").alias("position"))


def pick_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings, their lines as work relations."""
    lines = standins.table(spark, sf_dir, "lineitem")
    relation = F.struct(
        "l_linenumber", F.when(F.col("l_returnflag") == "R", F.array(F.lit("cover"))).alias("attributes"),
        F.struct(
            F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")).alias("id"),
            F.concat(F.lit(" Work "), F.col("l_suppkey").cast("string")).alias("title"),
            F.when(F.col("l_quantity") > 25, "eng").alias("language"), F.array(F.lit("swe"), F.lit("")).alias("languages"),
        ).alias("work"),
    )
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", relation.alias("r")))).alias("g"))
    works = grouped.select("l_orderkey", enrich.pick_work(F.transform("g", lambda g: g["r"])).alias("w"))
    return works.filter(F.col("w").isNotNull()).select(F.col("l_orderkey").alias("recording_id"), "w.work_id", "w.title", "w.language")


def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = standins.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recording_id"))
    return enrich.coverage(asked, pick_work(spark, sf_dir), "recording_id", ["title", "language"])


def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders no returned line has answered yet."""
    done = standins.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return enrich.worklist(standins.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


# --- overlay ------------------------------------------------------------------------------

CORRECTION = {
    "post_id": "p_partkey", "given": "p_size > 12",
    "artist": "CASE WHEN p_size % 4 = 1 THEN 'Brand ' || substring(p_brand, 7) END",
    "sort_as": "CASE WHEN p_size % 8 = 1 THEN substring(p_brand, 7) END",
    "title": "CASE WHEN p_size % 4 = 2 THEN upper(p_name) END", "from": "CASE WHEN p_size % 5 = 1 THEN p_type END",
    "language": "CASE WHEN p_size % 3 = 1 THEN 'eng' END", "year": "CAST(1950 + p_size AS INT)",
    "genre": "lower(p_type)", "id_given": "p_size % 3 <> 0",
}
OVERRIDE = {
    "post_id": "p_partkey", "given": "p_size >= 40",
    "artist": "CASE WHEN p_size IN (40, 41) THEN '' WHEN p_size = 42 THEN 'Somebody' END",
    "sort_as": "CASE WHEN p_size = 42 THEN 'Body' END", "title": "CASE WHEN p_size = 43 THEN 'A title' END",
    "from": "CASE WHEN p_size = 44 THEN '' WHEN p_size = 45 THEN 'A show' END",
    "category": "CASE WHEN p_size IN (40, 46) THEN 'Carol' END", "language": "CASE WHEN p_size = 47 THEN 'swe' END",
    "year": "CASE WHEN p_size = 48 THEN CAST(1901 AS INT) END",
    "other_id": "CASE WHEN p_size = 49 THEN 'brand1' WHEN p_size = 50 THEN lower(replace(p_brand, '#', '')) END",
}


def overlay_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = standins.table(spark, sf_dir, "part")
    own_id = F.expr("lower(replace(p_brand, '#', ''))")
    catalog = part.select(
        F.col("p_partkey").alias("post_id"), F.expr("CAST(floor(p_partkey / 2) AS BIGINT)").alias("id"),
        F.col("p_brand").alias("artist"), F.col("p_name").alias("song"),
    )
    ids = F.when(F.col("id_given"), F.array("own_id"))
    corrections = part.withColumn("own_id", own_id).selectExpr(
        "own_id", *[f"{text} AS `{name}`" for name, text in CORRECTION.items()]
    ).filter("given").select(
        "post_id", "artist", "sort_as", "title", "from", "language", "year", F.array("genre").alias("genres"),
        ids.alias("artist_ids"), F.lit(None).cast(overlay.CREDIT).alias("artists"),
    )
    overrides = part.selectExpr(*[f"{text} AS `{name}`" for name, text in OVERRIDE.items()]).filter("given").select(
        "post_id", "artist", "sort_as", "title", "from", "language", "year",
        F.when(F.col("category").isNotNull(), F.array("category")).alias("categories"),
        F.lit(None).cast("array<string>").alias("genres"),
        F.when(F.col("other_id").isNotNull(), F.array(F.struct(
            F.col("other_id").alias("artist_id"), F.lit("given").alias("name")
        ))).alias("artists"),
    )
    records = part.select(own_id.alias("artist_id"), F.concat(F.lit("The "), "p_brand").alias("name")).distinct()
    names = part.filter(F.col("p_brand").isin("Brand#2", "Brand#3")).select(
        own_id.alias("artist_id"), F.lower("p_brand").alias("name")
    ).distinct()
    return {"catalog": catalog, "corrections": corrections, "overrides": overrides, "records": records, "names": names}


def overlay_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = overlay.compose(**overlay_inputs(spark, sf_dir))
    return songs.select(
        "post_id", "id", "artist", "song", "year", "from", "language", "sort_as", F.array_join("genres", ",").alias("genres"),
        F.array_join("categories", ",").alias("categories"),
        F.array_join(F.transform("artists", lambda a: a["name"]), ",").alias("artists"),
        F.col("corrected").cast("int").alias("corrected"),
    )


def retain_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many songs keep their dump year, by what their override sets."""
    composed = overlay.compose(**overlay_inputs(spark, sf_dir)).select("post_id", "year")
    sizes = standins.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("post_id"), F.col("p_size").cast("long").alias("p_size"))
    return composed.join(sizes, "post_id").groupBy("p_size").agg(
        F.count("year").alias("with_year"), F.count(F.lit(1)).alias("songs")
    )


COMPOSED = f"""WITH c AS (SELECT * FROM (SELECT {_select(CORRECTION)}, lower(replace(p_brand, '#', '')) AS own_id FROM part) WHERE given),
o AS (SELECT * FROM (SELECT {_select(OVERRIDE)} FROM part) WHERE given),
joined AS (SELECT p.p_partkey AS post_id, CAST(floor(p.p_partkey / 2) AS BIGINT) AS id, p.p_size, p.p_brand, p.p_name,
    CASE WHEN o.artist IS NOT NULL THEN o.artist ELSE coalesce(c.artist, p.p_brand) END AS artist,
    coalesce(o.title, c.title, p.p_name) AS song,
    CASE WHEN o."from" IS NOT NULL THEN nullif(o."from", '') ELSE c."from" END AS "from",
    coalesce(o.language, c.language) AS language, o.category AS categories, coalesce(o.sort_as, c.sort_as) AS sort_as,
    NOT (coalesce(o.artist = '', false) OR coalesce(o.other_id IS NOT NULL AND c.id_given AND c.own_id <> o.other_id, false)) AS keep,
    o.year AS o_year, c.year AS c_year, c.genre,
    CASE WHEN o.other_id IS NOT NULL THEN o.other_id WHEN o.artist IS NOT NULL THEN NULL WHEN c.id_given THEN c.own_id END AS credit_id
  FROM part p LEFT JOIN c ON c.post_id = p.p_partkey LEFT JOIN o ON o.post_id = p.p_partkey),
composed AS (SELECT *, coalesce(o_year, CASE WHEN keep THEN c_year END) AS year, CASE WHEN keep THEN genre END AS genres FROM joined)"""


def slug_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists = standins.view(spark, sf_dir, standins.ARTISTS)
    return overlay.assign_slugs(artists.drop("slug"), artists.select("artist_id", "slug"))


def slug_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many artists' pages are merged, curated, told apart or plain."""
    artists = standins.view(spark, sf_dir, standins.ARTISTS)
    pages = slug_assign(spark, sf_dir).join(artists.select("artist_id", "name"), "artist_id").groupBy("slug").agg(
        F.min(F.struct("artist_id", "name")).alias("p"), F.count(F.lit(1)).alias("songs")
    ).select("slug", "p.*", "songs")
    return overlay.slug_counts(overlay.slug_review(pages, artists.select("artist_id", "slug")))


SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
SLUGS = f"""WITH RECURSIVE a AS (SELECT *, {SLUG.format('name')} AS base, substring(artist_id, 1, 8) AS short FROM ({standins.sql(standins.ARTISTS)})),
curated AS (SELECT artist_id, {SLUG.format('slug')} AS slug FROM a WHERE slug <> ''),
rest AS (SELECT *, count(*) OVER (PARTITION BY base) AS sharing, min(seq) OVER (PARTITION BY base) AS first FROM a
    WHERE artist_id NOT IN (SELECT artist_id FROM curated)),
turns AS MATERIALIZED (SELECT artist_id, base || '-' || short AS own, row_number() OVER (ORDER BY first, seq) AS n,
    list_filter([CASE WHEN sharing = 1 THEN base END, CASE WHEN type IS NOT NULL THEN base || '-' || {SLUG.format('type')} END,
        CASE WHEN disambiguation <> '' THEN base || '-' || {SLUG.format('disambiguation')} END], lambda w: w IS NOT NULL) AS wishes, short FROM rest),
fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS artist_id, CAST(NULL AS VARCHAR) AS slug,
        coalesce((SELECT list(DISTINCT slug) FROM curated), []) AS used
    UNION ALL SELECT n, artist_id, slug, list_append(used, slug) FROM (SELECT t.n, t.artist_id, f.used,
        coalesce(list_filter(t.wishes, lambda w: NOT list_contains(f.used, w))[1],
            CASE WHEN list_contains(f.used, t.own) THEN t.own || '-' || t.short ELSE t.own END) AS slug
        FROM fold f JOIN turns t ON t.n = f.n + 1))
SELECT artist_id, slug FROM curated UNION ALL SELECT artist_id, slug FROM fold WHERE n > 0"""

TAGS = f"""tags AS (SELECT 'n' || CAST(c_nationkey AS STRING) AS artist_id, c_mktsegment AS name, count(*) - 8 AS count FROM customer GROUP BY ALL),
kept AS (SELECT * FROM tags WHERE count > 0 AND lower(name) IN (SELECT {GENRE_NAME} FROM customer))"""
WORKS = """works AS (SELECT l_orderkey AS recording_id, CAST(l_partkey AS STRING) AS work_id, 'Work ' || CAST(l_suppkey AS STRING) AS title,
    CASE WHEN l_quantity > 25 THEN 'eng' ELSE 'swe' END AS language FROM lineitem WHERE l_linestatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R'), l_linenumber, l_partkey) = 1)"""
RESOLVED = """SELECT post_id, "case", full_row,
    CASE WHEN "case" = 'normal' THEN nullif(canonical, artist) WHEN alone THEN nullif(sole_name, artist) END AS new_artist,
    CASE WHEN "case" = 'normal' THEN lead_sort WHEN alone THEN sole_sort END AS sort_as,
    CASE WHEN full_row THEN nullif(title, song) END AS new_title,
    CASE WHEN "case" = 'normal' AND n_ids > 0 THEN n_ids WHEN alone THEN 1 END AS n_ids,
    CASE WHEN full_row THEN nullif(lead_genres, '') WHEN alone THEN nullif(sole_genres, '') END AS genres,
    CASE WHEN full_row THEN language END AS new_language, CASE WHEN full_row OR alone THEN 1 ELSE 0 END AS corrected
  FROM (SELECT *, "case" IN ('normal', 'placeholder') AS full_row,
    "case" NOT IN ('normal', 'placeholder') AND coalesce(NOT regexp_matches(sole_name, '^\\[.*\\]$'), false) AS alone FROM decided)"""
REASON = """CASE WHEN "case" = 'unmatched' THEN CASE WHEN sole_id IS NOT NULL THEN 'title not found' ELSE 'artist not found' END
    WHEN "case" = 'weak' AND NOT coalesce(placeholder, false) THEN 'weak match' WHEN "case" IN ('weak', 'placeholder') THEN 'placeholder act'
    WHEN "case" = 'namesake' THEN 'other act' END"""

# The same decisions with proposals, overrides, curated names, years and works beside the matches.
ENRICHED = DECIDED.replace("picks AS MATERIALIZED (SELECT *,", f"picks AS MATERIALIZED (SELECT *, CASE WHEN CAST(substring(artist_id, 2) AS INT) % 4 = 0 "
    "THEN 'Curated ' || substring(artist_id, 2) ELSE name END AS shown,").replace("string_agg(a.name, ', '", "string_agg(a.shown, ', '").replace(
    "s.name AS sole_name,", "s.name AS sole_name, s.shown AS sole_shown,").replace(
    "NOT trusted AND proposed IS NULL", "NOT trusted AND proposed IS NULL AND post_id % 7 <> 0").replace(
    "WHEN proposed IS NULL AND n_ids = 1", "WHEN proposed IS NULL AND post_id % 7 <> 0 AND n_ids = 1")
ENRICHED_ROWS = f"""{ENRICHED}, extra AS (SELECT o_orderkey AS post_id, {WORK_TITLE} AS work, {WORK_LANGUAGE} AS work_language, y.year FROM orders
    LEFT JOIN (SELECT l_orderkey AS o_orderkey, CAST(year(min(l_shipdate)) AS INT) AS year FROM lineitem GROUP BY ALL) y USING (o_orderkey))
SELECT post_id, "case", CASE WHEN "case" = 'normal' THEN nullif(canonical, artist) WHEN alone THEN nullif(sole_shown, artist) END AS new_artist,
    CASE WHEN full_row THEN nullif(CASE WHEN lower(work) = lower(recording) THEN work ELSE title END, song) END AS new_title,
    CASE WHEN full_row THEN year END AS year, CASE WHEN full_row THEN coalesce(work_language, language) END AS new_language,
    CASE WHEN "case" <> 'normal' AND post_id % 6 <> 0 THEN {REASON} END AS reason
FROM (SELECT *, "case" IN ('normal', 'placeholder') AS full_row, "case" NOT IN ('normal', 'placeholder')
    AND coalesce(NOT regexp_matches(sole_name, '^\\[.*\\]$'), false) AS alone FROM decided) JOIN extra USING (post_id)"""

QUERIES = {
    "artist_records": (artist_records, """SELECT 's' || s_suppkey AS artist_id, s_name AS name, 'B' || s_suppkey AS sort_name,
        CASE WHEN s_suppkey % 3 = 0 THEN 'Group' END AS type, CAST(s_nationkey AS VARCHAR) AS country, CASE WHEN s_suppkey % 2 <> 0 THEN 'no ' || s_suppkey END AS disambiguation,
        CASE WHEN s_acctbal > 0 THEN '1970-05' END AS began, CASE WHEN s_suppkey % 5 <> 0 THEN '1999' END AS ended,
        upper(s_name) || '|S' || s_nationkey AS aliases FROM supplier"""),
    "resolve_enriched": (resolve_enriched, ENRICHED_ROWS),
    "majority_entity": (majority_entity, f"WITH {MATCHES} SELECT * FROM majority"),
    "resolve_cases": (resolve_cases, f"{DECIDED} SELECT * EXCLUDE (full_row) FROM ({RESOLVED})"),
    "namesake_queue": (namesake_queue, f"""{DECIDED} SELECT post_id, artist, first_id AS credited_id, sole_id, sole_name
        FROM decided WHERE "case" = 'namesake'"""),
    "review_queue": (review_queue, f"""{DECIDED}, entries AS (SELECT *, {REASON} AS reason FROM decided WHERE "case" <> 'normal')
        SELECT post_id, id, artist, song, reason, count(*) OVER (PARTITION BY reason) AS reason_size,
            count(*) OVER (PARTITION BY reason, artist) AS artist_size,
            CASE WHEN "case" IN ('weak', 'namesake') THEN credit || ' – ' || recording END AS suggestion FROM entries"""),
    "resolve_summary": (resolve_summary, f"""{DECIDED}, r AS ({RESOLVED})
        SELECT sum(corrected) AS resolved, count(new_title) AS title_fixes, count(new_artist) AS artist_fixes, count(genres) AS with_genre,
            count(*) FILTER (WHERE full_row AND post_id IN (SELECT l_orderkey FROM lineitem)) AS with_year, count(new_language) AS with_language,
            count(*) FILTER (WHERE corrected = 1 AND "case" NOT IN ('normal', 'placeholder')) AS artist_only,
            count(*) FILTER (WHERE "case" <> 'normal') AS review FROM r"""),
    "earliest_release": (earliest_release, f"""WITH hits AS (SELECT {key('p_name')} AS k, 'b' || substring(p_brand, 7) AS artist_id,
            CASE WHEN l_returnflag <> 'R' THEN strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
        found AS (SELECT k, artist_id, count(*) AS seen, min(d) FILTER (WHERE CAST(substring(d, 1, 4) AS INT) >=
            CASE WHEN artist_id < 'b2' THEN 1994 ELSE 1890 END) AS first_released FROM hits GROUP BY ALL)
        SELECT p_partkey AS recording_id, first_released, CAST(substring(first_released, 1, 4) AS INT) AS year, seen
        FROM part JOIN found ON k = {key('p_name')} AND artist_id = 'b' || substring(p_brand, 7) WHERE first_released IS NOT NULL"""),
    "date_quantiles": (date_quantiles, """WITH y AS (SELECT year(l_shipdate) AS v, row_number() OVER (ORDER BY year(l_shipdate)) - 1 AS pos,
            count(*) OVER () AS n FROM lineitem)
        SELECT max(n) AS n, min(v) AS earliest, max(v) AS latest, min(v) FILTER (WHERE pos = floor(n * 0.25)) AS lower,
            min(v) FILTER (WHERE pos = floor(n * 0.5)) AS median, min(v) FILTER (WHERE pos = floor(n * 0.75)) AS upper FROM y"""),
    "genre_vocab": (genre_vocab, f"WITH {TAGS} SELECT * FROM kept"),
    "pick_genres": (pick_genres, f"""WITH {TAGS}, best AS (SELECT *, max(count) OVER (PARTITION BY artist_id) AS top FROM kept),
        named AS (SELECT artist_id, name, row_number() OVER (PARTITION BY artist_id ORDER BY count DESC, name) AS n FROM best
            WHERE count >= CASE WHEN top >= 2 THEN 2 ELSE 1 END)
        SELECT artist_id, string_agg(name, ',' ORDER BY n) AS genres FROM named WHERE n <= 3 GROUP BY artist_id"""),
    "artist_genres_top5": (artist_genres_top5, """SELECT * FROM (SELECT slug, genre, votes, row_number() OVER (PARTITION BY slug
            ORDER BY votes DESC, genre) AS position FROM (SELECT right(p_brand, 1) AS slug, p_type AS genre, count(*) AS votes FROM part GROUP BY ALL))
        WHERE position <= 5"""),
    "pick_work": (pick_work, f"WITH {WORKS} SELECT * FROM works"),
    "lookup_coverage": (lookup_coverage, f"""WITH {WORKS} SELECT count(*) AS asked, count(work_id) AS answered, count(*) - count(work_id) AS missing,
        count(title) AS with_title, count(language) AS with_language FROM orders LEFT JOIN works ON recording_id = o_orderkey"""),
    "resume_worklist": (resume_worklist, """SELECT o_orderkey, o_custkey FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""),
    "overlay_compose": (overlay_compose, f"""{COMPOSED} SELECT post_id, id, artist, song, year, "from", language, coalesce(sort_as, artist) AS sort_as,
        genres, categories, CASE WHEN credit_id IN ('brand2', 'brand3') THEN replace(credit_id, 'brand', 'brand#')
            WHEN credit_id IS NOT NULL THEN 'The ' || replace(credit_id, 'brand', 'Brand#') END AS artists,
        CASE WHEN artist <> p_brand OR song <> p_name OR categories IS NOT NULL OR "from" IS NOT NULL THEN 1 ELSE 0 END AS corrected FROM composed"""),
    "retain_enrichment": (retain_enrichment, f"""{COMPOSED} SELECT CAST(p_size AS BIGINT) AS p_size, count(year) AS with_year, count(*) AS songs
        FROM composed GROUP BY p_size"""),
    "slug_assign": (slug_assign, SLUGS),
    "slug_counts": (slug_counts, f"""WITH pages AS (SELECT slug, min(artist_id) AS artist_id FROM ({SLUGS}) GROUP BY slug),
        all_artists AS (SELECT * EXCLUDE (slug), {SLUG.format("coalesce(slug, '')")} AS given FROM ({standins.sql(standins.ARTISTS)})),
        sizes AS (SELECT given, count(*) AS n FROM all_artists WHERE given <> '' GROUP BY given),
        noted AS (SELECT CASE WHEN n > 1 THEN 'merged' WHEN given <> '' THEN 'curated' WHEN p.slug <> {SLUG.format('name')} THEN 'disambiguated' ELSE 'plain' END AS note
            FROM pages p JOIN all_artists a USING (artist_id) LEFT JOIN sizes USING (given))
        SELECT count(*) AS pages, count(*) FILTER (note = 'merged') AS merged, count(*) FILTER (note = 'curated') AS curated,
            count(*) FILTER (note = 'disambiguated') AS disambiguated, count(*) FILTER (note = 'plain') AS plain FROM noted"""),
}
