"""Registered queries over audits, reviews, second opinions, verdicts, evidence, profiles and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.operators import evidence, quality
from refrain.plans import standins
from refrain.plans.query_keys import _alnum, corroborate_sql
from refrain.plans.query_resolve import MATCHES, OVERRIDE, _select, matches
from refrain.sources import listing

# --- audit and reviews --------------------------------------------------------------------

AUDITED = {
    "post_id": "p_partkey", "song": "p_name", "matched": "p_size <> 30", "trusted": "p_size <> 31", "how": "'exact'",
    "recording": """CASE WHEN p_size = 25 THEN p_name || ' vs. Another' WHEN p_size = 26 THEN p_name || ' (bootleg)'
        WHEN p_size = 27 THEN p_name || ' (live in town)' WHEN p_size = 28 THEN p_name || ' - Live' ELSE p_name END""",
    "release": "CASE WHEN p_size = 29 THEN 'Wembley ' || p_type WHEN p_size = 32 THEN 'A bootleg' ELSE p_type END",
    "title": "p_name",
    "fixed": """CASE WHEN p_size = 20 THEN p_name || ' (Radio Edit)' WHEN p_size = 21 THEN p_name || ' (English version)'
        WHEN p_size = 22 THEN p_name || ' (1999)' WHEN p_size = 23 THEN p_name || ' (Bob''s club mix)'
        WHEN p_size = 24 THEN p_name || ' (part 2 mix)' END""",
}


def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.view(spark, sf_dir, ("part", AUDITED))
    resolved = rows.select("post_id", F.col("fixed").alias("title")).filter(F.col("title").isNotNull())
    return quality.audit(rows, resolved).withColumn("must_be_empty", F.col("must_be_empty").cast("int"))


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewrites = F.when(F.col("id") % 3 == 0, F.array(F.lit("title-article-added"))).when(
        F.col("id") % 3 == 1, F.array(F.lit("annotation-stripped"), F.lit("title-article-added"))
    ).otherwise(F.array().cast("array<string>"))
    return quality.match_summary(matches(spark, sf_dir).withColumn("rewrites", rewrites))


def overrides_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.view(spark, sf_dir, ("part", OVERRIDE)).filter("given").withColumn(
        "categories", F.when(F.col("category").isNotNull(), F.array("category", "category"))
    ).withColumn("why", F.lit("by hand"))
    return quality.overrides_review(rows, standins.catalog(spark, sf_dir))


PUT = {
    "post_id": "o_orderkey", "artist": "CASE WHEN o_custkey % 2 = 0 THEN 'Act ' || CAST(o_custkey AS STRING) END",
    "title": "CASE WHEN o_custkey % 3 = 0 THEN '' END", "from": "CASE WHEN o_custkey % 5 = 0 THEN 'Show' END",
    "language": "CASE WHEN o_custkey % 7 = 0 THEN 'fin' END", "why": "o_orderpriority",
}


def proposals_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.proposals_review(standins.view(spark, sf_dir, ("orders", PUT)), matches(spark, sf_dir))


# --- second opinions ----------------------------------------------------------------------

HITS = {
    "query_artist": "CASE WHEN p_size % 6 = 5 THEN 'Brand#1' ELSE p_brand END", "query_title": "p_name",
    "free": "p_size % 3 = 0", "hit_rank": "p_partkey",
    "artist": "CASE WHEN p_size % 6 = 4 THEN 'Somebody else' ELSE 'The ' || p_brand END",
    "title": "CASE WHEN p_size % 5 = 0 THEN p_name || ' (remastered)' WHEN p_size % 5 = 1 THEN 'Another thing' ELSE upper(p_name) END",
    "album": "CASE WHEN p_size % 7 = 0 THEN 'Karaoke hits' END",
}
PUBLISHED = {
    "post_id": "p_partkey",
    "artist": "CASE WHEN p_size % 9 = 0 THEN ' ' WHEN p_size % 9 = 1 THEN p_brand || ' & Friends' ELSE p_brand END",
    "title": "p_name",
}


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corroborate(standins.view(spark, sf_dir, ("part", PUBLISHED)), standins.view(spark, sf_dir, ("part", HITS)))


def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).withColumn("ok", F.col("ok").cast("int"))


RELEASE = "CASE WHEN p_size % 4 = 0 THEN p_brand || ' - ' || p_type WHEN p_size % 4 = 2 THEN 'Hits of ' || p_type END"


def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases per (artist, title), asked only where the first source did not agree."""
    published = standins.view(spark, sf_dir, ("part", PUBLISHED))
    releases = standins.view(spark, sf_dir, ("part", {
        "query_artist": "p_brand", "query_title": "p_name", "hit_rank": "p_partkey",
        "title": RELEASE,
    }))
    return quality.second_source(published, releases, _first(spark, sf_dir)).withColumn("ok", F.col("ok").cast("int"))


CHECK = {
    "post_id": "p_partkey", "artist": "p_brand", "title": "p_name",
    "first_ok": "CASE WHEN p_size % 5 <> 0 THEN p_size % 3 = 0 END",
    "first_title": "CASE WHEN p_size % 5 <> 0 AND p_size % 4 <> 0 THEN upper(p_name) END",
    "first_note": "CASE WHEN p_size = 11 THEN 'HTTP 429 for x' END",
    "second_ok": "CASE WHEN p_size % 7 <> 0 THEN p_size % 2 = 0 END",
    "second_title": "CASE WHEN p_size % 7 <> 0 AND p_size % 3 = 0 THEN p_brand || ' - ' || p_name END",
    "new_title": "CASE WHEN p_size % 10 < 3 THEN p_name WHEN p_size % 10 < 6 THEN p_name || 's' ELSE p_type END",
}


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.view(spark, sf_dir, ("part", CHECK))

    def source(name: str, note) -> F.Column:
        return F.when(F.col(f"{name}_ok").isNotNull(), F.struct(
            F.col(f"{name}_ok").alias("ok"), F.lit(None).cast("string").alias("artist"),
            F.col(f"{name}_title").alias("title"), note.alias("note"),
        ))

    return rows.select(
        "post_id", "artist", "title", source("first", F.col("first_note")).alias("first"),
        source("second", F.lit(None).cast("string")).alias("second"), "new_title",
    )


def corroboration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corroboration_summary(_checks(spark, sf_dir))


def corroboration_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corroboration_review(_checks(spark, sf_dir)).select("post_id", "artist", "title", "kind")


def corroboration_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over checks graded again after titles changed."""
    checks = _checks(spark, sf_dir)
    done = quality.rescore(checks.drop("new_title"), checks.select("post_id", "artist", F.col("new_title").alias("title")))
    return done.agg(
        F.count_if("changed").alias("retitled"), F.sum("rescored").alias("rescored"), F.sum("invalidated").alias("invalidated"),
        F.count_if(F.col("first.ok")).alias("first_ok"), F.count_if(F.col("second.ok")).alias("second_ok"),
    )


def unchecked_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unchecked(standins.catalog(spark, sf_dir).select("post_id"), _checks(spark, sf_dir))


def unchecked_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 500 songs to ask about, the batch of one run."""
    return quality.unchecked(standins.catalog(spark, sf_dir).select("post_id"), _checks(spark, sf_dir), 500)


# --- verdicts and evidence ----------------------------------------------------------------

EXPECTED = {
    "artist": "CASE WHEN c_acctbal < 9000 THEN c_name ELSE c_name || ' unheard of' END", "status": "CASE WHEN c_custkey % 4 <> 0 THEN 'resolved' END",
    "artist_count": "CASE WHEN c_custkey % 3 = 0 THEN CAST(1 AS INT) END",
    "collaboration": "CASE WHEN c_custkey % 5 = 0 THEN true END",
    "expect_name": "CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END",
    "same_entity_as": "CASE WHEN c_custkey % 7 = 0 THEN 'Customer#' || lpad(CAST(c_custkey + 1 AS STRING), 9, '0') END",
    "must_not_resolve": "CASE WHEN c_custkey % 11 = 0 THEN true END",
    "observe_only": "CASE WHEN c_custkey % 13 = 0 THEN 'undecided' END",
}
VERDICT = {
    "artist": "CASE WHEN c_acctbal > -500 THEN c_name ELSE c_name || ' by another name' END", "status": "CASE WHEN c_acctbal > 2000 THEN 'resolved' ELSE 'ambiguous' END",
    "name": "c_mktsegment", "artist_id": "'n' || CAST(c_nationkey AS STRING)", "two": "c_acctbal > 8000",
    "is_collaboration": "CASE WHEN c_acctbal > 8000 THEN true END",
}


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = standins.view(spark, sf_dir, ("customer", VERDICT))
    one = F.struct("name", "artist_id")
    verdicts = rows.select("artist", "status", F.when(F.col("two"), F.array(one, one)).otherwise(F.array(one)).alias("artists"), "is_collaboration")
    checks = standins.view(spark, sf_dir, ("customer", EXPECTED))
    return checks, verdicts


def verdict_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdict_assertions(*_verdicts(spark, sf_dir)).groupBy("assertion").agg(
        F.count_if("passed").alias("passed"), F.count("passed").alias("checked"), F.count(F.lit(1)).alias("asserted")
    )


def verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_verdicts(*_verdicts(spark, sf_dir))


def same_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks, verdicts = _verdicts(spark, sf_dir)
    pairs = checks.filter(F.col("same_entity_as").isNotNull()).select("artist", F.col("same_entity_as").alias("other"))
    return quality.same_entity_checks(pairs, verdicts).withColumn("same", F.col("same").cast("int"))


PAIRED = "p_brand || ' & ' || 'Brand#' || CAST(1 + (CAST(substring(p_brand, 7) AS INT) + 3) % 25 AS STRING)"
ENTITY = "CASE WHEN p_type = 'ECONOMY' THEN '[economy]' ELSE p_type END"


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = standins.table(spark, sf_dir, "part")
    hits = part.groupBy(F.col("p_brand").alias("query"), F.col("p_type").alias("artist_id"), F.expr(ENTITY).alias("name")).agg(
        F.min("p_partkey").alias("hit_rank")
    ).withColumn("disambiguation", F.when(F.col("artist_id") == "PROMO", "a tribute band"))
    recordings = part.select(
        F.col("p_type").alias("artist_id"), F.expr("p_name").alias("query"), F.col("p_partkey").alias("hit_rank"),
        F.expr("CASE WHEN p_size % 2 = 0 THEN p_name || ' (live)' ELSE 'baby ' || p_name END").alias("title"),
    )
    catalog = part.select(F.col("p_partkey").alias("post_id"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("song"))
    return {"artists": part.select(F.col("p_brand").alias("artist")).distinct(), "catalog": catalog, "hits": hits, "recordings": recordings}


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    titles = evidence.sampled_titles(e["catalog"], e["artists"])
    checks = evidence.title_checks(evidence.candidates_for(e["artists"], e["hits"]), titles, e["recordings"])
    return checks.select("artist", "artist_id", "song", "hit", *[
        F.col(c).cast("int").alias(c) for c in ("placeholder", "tribute", "found", "loose")
    ])


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested evidence row per artist string, summed up."""
    nested = evidence.collect_evidence(**_evidence(spark, sf_dir))
    return nested.select(
        "artist", "songs", F.array_join("sampled_titles", "|").alias("titles"),
        F.array_join(F.transform("candidates", lambda c: c["artist_id"]), "|").alias("candidates"),
        F.col("corroborated").cast("int").alias("corroborated"),
    )


def evidence_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence on brands and on pairs of brands, told again as one row per part, candidate and title."""
    e = _evidence(spark, sf_dir)
    part = standins.table(spark, sf_dir, "part")
    joint = F.expr(PAIRED)
    strings = part.select(F.explode(F.array(F.col("p_brand"), joint)).alias("artist")).distinct()
    catalog = e["catalog"].unionByName(part.select(
        F.col("p_partkey").alias("post_id"), F.col("p_partkey").alias("id"), joint.alias("artist"), F.col("p_name").alias("song")))
    hits = e["hits"].withColumns({
        "score": (F.lit(100) - F.col("hit_rank") % 50).cast("int"), "type": F.when(F.col("hit_rank") % 2 == 0, "Group"), "country": F.lower("artist_id"),
        "began": F.when(F.col("hit_rank") % 3 == 0, "1970"), "aliases": F.array("name", F.lower("name"), F.col("name")),
    })
    others = part.select(F.col("p_name").alias("query"), F.col("p_partkey").alias("hit_rank"), F.upper("p_name").alias("title"), F.col("p_brand").alias("artists"))
    found = evidence.collect_evidence(strings, catalog, hits, e["recordings"], others)
    whole = F.struct(F.lit(-1).alias("place"), F.lit(None).cast("string").alias("fragment"), F.col("candidates"))
    asked = found.select("artist", "songs", "corroborated", F.explode(F.concat(F.array(whole), "fragments")).alias("f"))
    candidate = asked.select("artist", "songs", "corroborated", F.col("f.place").cast("long").alias("place"), "f.fragment", F.explode_outer("f.candidates").alias("c"))
    checked = candidate.select(
        "artist", "songs", "corroborated", "place", "fragment", "c.position", "c.artist_id", "c.name", "c.score", "c.type", "c.country", "c.began",
        F.array_join("c.aliases", "|").alias("aliases"), F.explode_outer("c.title_checks").alias("t"))
    fallback = found.select("artist", "songs", "corroborated", F.explode("title_only").alias("o")).select(
        "artist", "songs", "corroborated", F.col("o.song").alias("song"), F.explode_outer("o.hits").alias("h"))
    none = {c: F.lit(None).cast(t) for c, t in (("place", "long"), ("fragment", "string"), ("position", "int"), ("artist_id", "string"), ("name", "string"), (
        "score", "int"), ("type", "string"), ("country", "string"), ("began", "string"), ("aliases", "string"), ("found", "int"), ("loose", "int"))}
    rows = checked.select("*", "t.song", "t.hit", F.col("t.found").cast("int").alias("found"), F.col("t.loose").cast("int").alias("loose")).drop("t")
    rows = rows.withColumn("credited", F.lit(None).cast("string"))
    rest = fallback.select("artist", "songs", "corroborated", "song", F.col("h.title").alias("hit"), F.col("h.artists").alias("credited")).withColumns(none)
    return rows.unionByName(rest).withColumn("corroborated", F.col("corroborated").cast("int"))


def split_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = standins.catalog(spark, sf_dir).select("artist").distinct()
    return evidence.split_fragments(strings).withColumn("place", F.col("place").cast("long"))


# --- profiles -----------------------------------------------------------------------------


def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage_profile(standins.catalog(spark, sf_dir))


def case_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.case_clusters(standins.catalog(spark, sf_dir))


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_pairs(standins.catalog(spark, sf_dir))


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shared_ids(standins.catalog(spark, sf_dir))


def scrape_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as scraped rows: one per conversation, the first page's."""
    rows = standins.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("post_id"), F.col("conv_id").alias("id"), F.col("turn").alias("page"), F.lit(0).alias("place"),
        "role", F.md5("text").alias("text_hash"),
    )
    return quality.dedupe_scrape(rows).select("post_id", "id", "page", "role", "text_hash")


# --- pages --------------------------------------------------------------------------------

SPEC = listing.ListingSpec(
    container='<div class="listing"[^>]*>', provider="songs", row="<li ", post_id=r'data-post-id="(\d+)"',
    fields={"id": r'data-post-id="(\d+)"', "artist": r'<a href="/([^"]*)"', "song": r"<a [^>]*>([\s\S]*?)</"},
)
NAV = '<div class="listing" data-nav="{&quot;query&quot;:{&quot;jet_smart_filters&quot;:&quot;songs&quot;,&quot;posts_per_page&quot;:6}}" data-pages="1">'


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages with their navigation lists marked up as listings of numbered rows."""
    html = F.replace(F.col("html"), F.lit("<nav>"), F.lit(NAV))
    numbered = F.replace(html, F.lit("<li>"), F.concat(F.lit('<li data-post-id="'), F.col("page_id").cast("string"), F.lit('">')))
    return standins.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), numbered.alias("html"))


def pages_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.extract_listing(_pages(spark, sf_dir), SPEC).select(
        "page", F.col("place").cast("long").alias("place"), "post_id", "artist", "song"
    )


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listing pages, some with each kind of damage a scrape must notice."""
    page, html = F.col("page"), F.col("html")

    def where(remainder: int, modulus: int, old: str, new: str):
        return lambda text: F.when(page % modulus == remainder, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)

    for damage in (
        where(1, 5, 'data-post-id="', 'data-post-id="x'), where(2, 5, '<a href="/', '<a title="/'), where(3, 5, ' data-pages="1"', ""),
        where(4, 5, "&quot;posts_per_page&quot;:6", "&quot;posts_per_page&quot;:0"), where(0, 7, "<a ", "<b "),
        where(0, 35, ' data-pages="1"', ' data-pages="9999999"'),
    ):
        html = damage(html)
    return _pages(spark, sf_dir).select("page", html.alias("html"))


def pages_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _damaged(spark, sf_dir)
    return listing.listing_violations(listing.extract_listing(pages, SPEC), listing.find_listing(pages, SPEC), ["artist", "song"])


def pages_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with their known entities decoded."""
    return standins.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(listing.decode_entities(F.col("html"))).alias("decoded_hash")
    )


def entity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = standins.table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), "html")
    return listing.unknown_entities(pages)


_HITS = f"""hits AS (SELECT query_artist, query_title, free, artist AS ha, title AS ht, min(hit_rank) AS hit_rank FROM ({standins.sql(('part', HITS))})
    WHERE album IS NULL GROUP BY ALL),
published AS (SELECT {_select(PUBLISHED)} FROM part),
questions AS (SELECT DISTINCT artist, title, CASE WHEN artist LIKE '% & %' THEN string_split(artist, ' & ')[1] ELSE artist END AS lead
    FROM published WHERE trim(artist) <> ''),
turns AS (SELECT artist, title, artist AS qa, false AS free, 0 AS turn FROM questions UNION ALL
    SELECT artist, title, lead, false, 100 FROM questions WHERE lead <> artist UNION ALL SELECT artist, title, lead, true, 10000 FROM questions),
graded AS (SELECT *, (contains(kh, ka) OR contains(ka, kh) OR contains(kh, kq) OR contains(kq, kh)) AND ({corroborate_sql('a', 'b')}) AS agrees FROM (
    SELECT t.artist, t.title, t.turn, h.*, {_alnum('h.ha')} AS kh, {_alnum('t.artist')} AS ka, {_alnum('t.qa')} AS kq,
        {_alnum('h.ht')} AS a, {_alnum('t.title')} AS b
    FROM turns t JOIN hits h ON h.query_artist = t.qa AND h.query_title = t.title AND h.free = t.free)),
verdicts AS (SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY artist, title ORDER BY NOT agrees, turn, hit_rank, ha, ht) = 1),
opinions AS MATERIALIZED (SELECT p.post_id, p.artist, p.title, trim(p.artist) = '' OR coalesce(v.agrees, false) AS ok, v.ha AS hit_artist, v.ht AS hit_title,
    CASE WHEN trim(p.artist) = '' THEN 'no artist' WHEN v.ha IS NULL THEN 'no hits' WHEN NOT v.agrees THEN 'best hit did not agree' END AS note
    FROM published p LEFT JOIN verdicts v USING (artist, title))"""
_CHECKS = f"checks AS (SELECT {_select(CHECK)}, coalesce(p_size = 11 AND p_size % 5 <> 0, false) AS limited FROM part)"
_AGREED = f"""({corroborate_sql("regexp_replace(lower({t}), '[^a-z0-9]+', '', 'g')", "regexp_replace(lower(new_title), '[^a-z0-9]+', '', 'g')")})"""
_ASSERTED = f"""checks AS (SELECT {_select(EXPECTED)} FROM customer),
given AS (SELECT {_select(VERDICT)} FROM customer),
rows AS (SELECT c.*, g.artist IS NOT NULL AS answered, g.status AS got, g.name, g.artist_id, CASE WHEN g.two THEN 2 ELSE 1 END AS n,
    coalesce(g.is_collaboration, false) AS joint, o.artist_id AS other_id
    FROM checks c LEFT JOIN given g USING (artist) LEFT JOIN given o ON o.artist = c.same_entity_as),
plain AS (SELECT * FROM rows WHERE answered AND observe_only IS NULL AND must_not_resolve IS NULL AND same_entity_as IS NULL),
asserted AS (SELECT 'answered' AS assertion, false AS passed FROM rows WHERE NOT answered
    UNION ALL SELECT 'observed', NULL FROM rows WHERE answered AND observe_only IS NOT NULL
    UNION ALL SELECT 'not resolved', got <> 'resolved' FROM rows WHERE answered AND observe_only IS NULL AND must_not_resolve
    UNION ALL SELECT 'same entity', coalesce(artist_id = other_id, false) FROM rows
      WHERE answered AND observe_only IS NULL AND must_not_resolve IS NULL AND same_entity_as IS NOT NULL
    UNION ALL SELECT 'status', got = status FROM plain WHERE status IS NOT NULL
    UNION ALL SELECT 'artist_count', n = artist_count FROM plain WHERE artist_count IS NOT NULL
    UNION ALL SELECT 'collaboration', joint = collaboration FROM plain WHERE collaboration IS NOT NULL
    UNION ALL SELECT 'expect_name', name = expect_name FROM plain WHERE expect_name IS NOT NULL)"""
_EVIDENCE = f"""titles AS (SELECT p_brand AS artist, p_name AS song, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3),
ranked AS (SELECT p_brand AS artist, p_type AS artist_id, min(p_partkey) AS hit_rank FROM part GROUP BY p_brand, p_type),
candidates AS (SELECT *, artist_id = 'ECONOMY' AS placeholder, artist_id = 'PROMO' AS tribute FROM ranked
    QUALIFY row_number() OVER (PARTITION BY artist ORDER BY hit_rank) <= 3),
best AS (SELECT p_type AS artist_id, p_name AS song, arg_min(CASE WHEN p_size % 2 = 0 THEN p_name || ' (live)' ELSE 'baby ' || p_name END, p_partkey) AS hit
    FROM part GROUP BY ALL),
flags AS (SELECT c.artist, c.artist_id, t.song, t.place, b.hit, c.hit_rank, c.placeholder, c.tribute, b.hit IS NOT NULL AS found,
    coalesce(b.hit LIKE 'baby %', false) AS loose FROM candidates c JOIN titles t USING (artist) LEFT JOIN best b USING (artist_id, song))"""
_NESTED = f"""pairs AS (SELECT *, {PAIRED.replace('STRING', 'VARCHAR')} AS paired FROM part),
songs AS (SELECT p_partkey, p_brand AS artist, p_name AS song FROM part UNION ALL SELECT p_partkey, paired, p_name FROM pairs),
n AS (SELECT artist, count(*) AS songs FROM songs GROUP BY artist),
titles AS (SELECT artist, song, row_number() OVER (PARTITION BY artist ORDER BY p_partkey) AS title_place FROM songs
    QUALIFY row_number() OVER (PARTITION BY artist ORDER BY p_partkey) <= 3),
asks AS (SELECT artist, -1 AS place, NULL AS fragment, artist AS query FROM n UNION ALL
    SELECT artist, generate_subscripts(parts, 1) - 1, unnest(parts), unnest(parts) FROM (SELECT artist, string_split(artist, ' & ') AS parts FROM n WHERE artist LIKE '% & %')),
ranked AS (SELECT p_brand AS query, p_type AS artist_id, {ENTITY} AS name, min(p_partkey) AS hit_rank,
    row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS position FROM part GROUP BY p_brand, p_type),
best AS (SELECT p_type AS artist_id, p_name AS song, arg_min(CASE WHEN p_size % 2 = 0 THEN p_name || ' (live)' ELSE 'baby ' || p_name END, p_partkey) AS hit
    FROM part GROUP BY ALL),
told AS (SELECT a.artist, a.place, a.fragment, r.position, r.artist_id, r.name, r.hit_rank, t.song, b.hit,
    CASE WHEN r.name IS NOT NULL THEN b.hit IS NOT NULL END AS found, CASE WHEN r.name IS NOT NULL THEN coalesce(b.hit LIKE 'baby %', false) END AS loose
    FROM asks a LEFT JOIN ranked r ON r.query = a.query AND r.position <= CASE WHEN a.place = -1 THEN 3 ELSE 2 END
    LEFT JOIN titles t ON t.artist = a.artist AND r.name IS NOT NULL AND (a.place = -1 OR t.title_place = 1)
    LEFT JOIN best b ON b.artist_id = r.artist_id AND b.song = t.song),
sure AS (SELECT artist, coalesce(bool_or(found AND NOT loose AND artist_id NOT IN ('ECONOMY', 'PROMO')) FILTER (place = -1), false) AS corroborated FROM told GROUP BY artist),
others AS (SELECT p_name AS song, upper(p_name) AS hit, p_brand AS credited FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) <= 5)
SELECT artist, songs, CAST(corroborated AS INT) AS corroborated, CAST(place AS BIGINT) AS place, fragment, CAST(position AS INT) AS position, artist_id, name,
    CAST(100 - hit_rank % 50 AS INT) AS score, CASE WHEN hit_rank % 2 = 0 THEN 'Group' END AS type, lower(artist_id) AS country,
    CASE WHEN hit_rank % 3 = 0 THEN '1970' END AS began, name || CASE WHEN lower(name) <> name THEN '|' || lower(name) ELSE '' END AS aliases,
    song, hit, CAST(found AS INT) AS found, CAST(loose AS INT) AS loose, NULL::VARCHAR AS credited
FROM told JOIN n USING (artist) JOIN sure USING (artist)
UNION ALL SELECT artist, songs, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, song, hit, NULL, NULL, credited
FROM titles JOIN n USING (artist) JOIN sure USING (artist) LEFT JOIN others USING (song) WHERE NOT corroborated"""
_CAT = f"cat AS (SELECT * FROM ({standins.sql(standins.CATALOG)}))"
_ROWS = """rows AS (SELECT page_id, unnest(m) AS m, generate_subscripts(m, 1) - 1 AS place FROM
    (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>') AS m FROM pages))"""


def _decode(text: str) -> str:
    return f"""replace(replace({text}, '&quot;', '"'), '&amp;', '&')"""


QUERIES = {
    "audit_buckets": (audit_buckets, f"""WITH m AS (SELECT *, coalesce(fixed, title) AS shown FROM (SELECT {_select(AUDITED)} FROM part) WHERE matched),
        flags AS (SELECT count(*) FILTER (regexp_matches(recording, '(?i)\\bbootleg\\b') OR regexp_matches(release, '(?i)\\bbootleg\\b')) AS bootleg_match,
            count(*) FILTER (regexp_matches(shown, '(?i)\\([^)]*\\b(edit|version|mix|live)\\b[^)]*\\)\\s*$') AND NOT regexp_matches(shown, '(?i)\\benglish\\s+version\\b')
              AND NOT regexp_matches(shown, '(?i)\\bpart\\s*[0-9]\\b')) AS version_published,
            count(*) FILTER (regexp_matches(shown, '(?i)\\([^)]*(''s)\\s+[^)]*(mix)[^)]*\\)')) AS remixer_published,
            count(*) FILTER (regexp_matches(shown, '\\((19|20)[0-9]{{2}}\\)\\s*$')) AS year_published,
            count(*) FILTER (regexp_matches(recording, '(?i)\\bvs\\.?\\b')) AS mashup_recording,
            count(*) FILTER (regexp_matches(release, '(?i)\\b(wembley|bootleg)\\b') OR regexp_matches(recording, '(?i)\\(.*\\blive\\b.*\\)|-\\s*live\\s*$')) AS live_release,
            count(*) FILTER (NOT trusted) AS untrusted FROM m)
        SELECT bucket, songs, CASE WHEN bucket IN ('live_release', 'untrusted') THEN 0 ELSE 1 END AS must_be_empty FROM (UNPIVOT flags ON COLUMNS(*) INTO NAME bucket VALUE songs)"""),
    "match_summary": (match_summary, f"""WITH {MATCHES} SELECT 'total' AS measure, 'all' AS name, count(*) AS songs FROM matches
        UNION ALL SELECT 'total', 'matched', count(*) FROM matches WHERE matched UNION ALL SELECT 'total', 'trusted', count(*) FROM matches WHERE trusted
        UNION ALL SELECT 'total', 'placeholder', count(*) FROM matches WHERE placeholder
        UNION ALL SELECT 'how', how, count(*) FROM matches WHERE matched GROUP BY how
        UNION ALL SELECT 'rewrite', 'title-article-added', count(*) FROM matches WHERE matched AND id % 3 < 2
        UNION ALL SELECT 'rewrite', 'annotation-stripped', count(*) FROM matches WHERE matched AND id % 3 = 1"""),
    "overrides_review": (overrides_review, f"""WITH {_CAT}, o AS (SELECT * FROM (SELECT {_select(OVERRIDE)} FROM part) WHERE given)
        SELECT o.post_id, c.id, c.artist, c.song, coalesce(o.artist, c.artist) AS shown_artist, coalesce(o.title, c.song) AS shown_title,
            o.category AS categories, 'by hand' AS why FROM o LEFT JOIN cat c USING (post_id)"""),
    "proposals_review": (proposals_review, f"""WITH {MATCHES}, p AS (SELECT * FROM (SELECT {_select(PUT)} FROM orders))
        SELECT p.post_id, m.id, m.artist AS had_artist, m.song, coalesce(p.artist, m.artist) AS shown_artist, coalesce(p.title, m.song) AS shown_title,
            p."from", p.language, p.why, CASE WHEN NOT m.matched THEN 'no' WHEN m.proposed IS NOT NULL THEN 'yes' ELSE 'other' END AS status
        FROM p JOIN matches m USING (post_id)"""),
    "corroborate": (corroborate, f"WITH {_HITS} SELECT post_id, artist, title, CAST(ok AS INT) AS ok, hit_artist, hit_title, note FROM opinions"),
    "second_source": (second_source, f"""WITH {_HITS}, releases AS (SELECT p_brand AS artist, p_name AS title, arg_min({RELEASE}, p_partkey) AS release
            FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
        SELECT post_id, artist, title, CAST(ok OR release IS NOT NULL AS INT) AS ok, CASE WHEN NOT ok THEN release END AS hit_title,
            CASE WHEN trim(artist) = '' THEN 'no artist' WHEN ok THEN 'skipped; first source agreed' WHEN release IS NULL THEN 'no release hits'
                WHEN NOT contains({_alnum('release')}, {_alnum('artist')}) THEN 'release without the artist' END AS note
        FROM opinions LEFT JOIN releases USING (artist, title)"""),
    "corroboration_summary": (corroboration_summary, f"""WITH {_CHECKS} SELECT count(*) AS checked, count(*) FILTER (first_ok AND second_ok) AS both,
        count(*) FILTER (coalesce(first_ok, false) OR coalesce(second_ok, false)) AS either,
        count(*) FILTER (NOT first_ok AND NOT second_ok AND NOT limited) AS neither,
        count(*) FILTER (first_ok IS NULL OR second_ok IS NULL) AS incomplete, count(*) FILTER (limited) AS rate_limited FROM checks"""),
    "corroboration_review": (corroboration_review, f"""WITH {_CHECKS} SELECT post_id, artist, title,
        CASE WHEN first_title IS NOT NULL OR second_title IS NOT NULL THEN 'conflict' ELSE 'not found' END AS kind
        FROM checks WHERE NOT first_ok AND NOT second_ok AND NOT limited"""),
    "corroboration_rescore": (corroboration_rescore, f"""WITH {_CHECKS}, s AS (SELECT *, new_title <> title AS changed,
            (new_title <> title AND first_ok IS NOT NULL AND NOT limited) AS f, (new_title <> title AND second_ok IS NOT NULL) AS g FROM checks)
        SELECT count(*) FILTER (changed) AS retitled, count(*) FILTER (f AND first_title IS NOT NULL) + count(*) FILTER (g AND second_title IS NOT NULL) AS rescored,
            count(*) FILTER (f AND first_title IS NULL) + count(*) FILTER (g AND second_title IS NULL) AS invalidated,
            count(*) FILTER (CASE WHEN NOT f THEN first_ok WHEN first_title IS NOT NULL THEN {_AGREED.replace('{t}', 'first_title')} END) AS first_ok,
            count(*) FILTER (CASE WHEN NOT g THEN second_ok WHEN second_title IS NOT NULL THEN {_AGREED.replace('{t}', 'second_title')} END) AS second_ok FROM s"""),
    "unchecked_songs": (unchecked_songs, f"WITH {_CHECKS} SELECT post_id FROM checks WHERE first_ok IS NULL OR second_ok IS NULL OR limited"),
    "unchecked_batch": (unchecked_batch, f"""WITH {_CHECKS} SELECT post_id FROM checks WHERE first_ok IS NULL OR second_ok IS NULL OR limited
        ORDER BY post_id LIMIT 500"""),
    "verdict_assertions": (verdict_assertions, f"""WITH {_ASSERTED} SELECT assertion, count(*) FILTER (passed) AS passed, count(passed) AS checked, count(*) AS asserted
        FROM asserted GROUP BY assertion"""),
    "verdict_score": (verdict_score, f"""WITH {_ASSERTED} SELECT count(*) FILTER (passed) AS passed, count(passed) AS checked, count(*) FILTER (NOT passed) AS failed,
        count(*) FILTER (passed IS NULL) AS observed, (SELECT count(*) FROM given WHERE artist NOT IN (SELECT artist FROM checks)) AS unexpected FROM asserted"""),
    "same_entity": (same_entity, f"""WITH {_ASSERTED} SELECT artist, same_entity_as AS other, CAST(coalesce(artist_id = other_id, false) AS INT) AS same
        FROM rows WHERE same_entity_as IS NOT NULL"""),
    "evidence_flags": (evidence_flags, f"""WITH {_EVIDENCE} SELECT artist, artist_id, song, hit, CAST(placeholder AS INT) AS placeholder, CAST(tribute AS INT) AS tribute,
        CAST(found AS INT) AS found, CAST(loose AS INT) AS loose FROM flags"""),
    "evidence_summary": (evidence_summary, f"""WITH {_EVIDENCE}, n AS (SELECT p_brand AS artist, count(*) AS songs FROM part GROUP BY ALL),
        t AS (SELECT artist, string_agg(song, '|' ORDER BY place) AS titles FROM titles GROUP BY artist),
        c AS (SELECT artist, string_agg(artist_id, '|' ORDER BY hit_rank) AS candidates FROM candidates GROUP BY artist)
        SELECT artist, songs, titles, candidates, max(CAST(found AND NOT loose AND NOT placeholder AND NOT tribute AS INT)) AS corroborated
        FROM flags JOIN n USING (artist) JOIN t USING (artist) JOIN c USING (artist) GROUP BY ALL"""),
    "evidence_nested": (evidence_nested, f"WITH {_NESTED}"),
    "split_fragments": (split_fragments, f"""WITH {_CAT} SELECT artist, unnest(parts) AS fragment, generate_subscripts(parts, 1) - 1 AS place
        FROM (SELECT DISTINCT artist, list_distinct_ordered AS parts FROM (SELECT artist, CASE WHEN p[1] = p[2] THEN [p[1]] ELSE p END AS list_distinct_ordered
            FROM (SELECT artist, string_split(artist, ' & ') AS p FROM cat WHERE artist LIKE '% & %')))"""),
    "catalog_profile": (catalog_profile, f"""WITH {_CAT}, s AS (SELECT count(*) AS songs_each FROM cat GROUP BY artist),
        b AS (SELECT songs_each, count(*) AS artists, sum(songs_each) AS songs FROM s GROUP BY songs_each)
        SELECT songs_each, artists, songs, sum(songs) OVER (ORDER BY songs_each DESC) AS cumulative FROM b"""),
    "case_clusters": (case_clusters, f"""WITH {_CAT} SELECT lower(artist) AS folded, count(DISTINCT artist) AS spellings, count(*) AS songs FROM cat
        GROUP BY lower(artist) HAVING count(DISTINCT artist) > 1"""),
    "duplicate_pairs": (duplicate_pairs, f"WITH {_CAT} SELECT artist, song, count(*) AS copies FROM cat GROUP BY ALL HAVING count(*) > 1"),
    "shared_ids": (shared_ids, f"WITH {_CAT} SELECT id, count(DISTINCT post_id) AS songs FROM cat GROUP BY id HAVING count(DISTINCT post_id) > 1"),
    "scrape_dedupe": (scrape_dedupe, """SELECT conv_id AS post_id, conv_id AS id, turn AS page, role, md5(text) AS text_hash FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"""),
    "pages_extract": (pages_extract, f"""WITH {_ROWS} SELECT page_id AS page, place, page_id AS post_id,
        trim({_decode("regexp_extract(m, 'href=\"/([^\"]*)\"', 1)")}) AS artist, trim({_decode("regexp_extract(m, '>([^<>]*)</a>', 1)")}) AS song FROM rows"""),
    "pages_violations": (pages_violations, f"""WITH {_ROWS}, tallied AS (SELECT count(*) FILTER (page_id % 5 = 1) AS ids,
            count(*) FILTER (page_id % 5 = 2 OR page_id % 7 = 0) AS artists, count(*) FILTER (page_id % 7 = 0) AS songs,
            count(DISTINCT page_id) FILTER (page_id % 5 <> 1) AS found FROM rows),
        lists AS (SELECT count(*) FILTER (page_id % 5 = 3) AS pages, count(*) FILTER (page_id % 5 = 4) AS sizes,
            max(CASE WHEN page_id % 35 = 0 THEN 9999998 * 6 ELSE 0 END) AS promised FROM pages WHERE contains(html, '<nav>'))
        SELECT rule, CAST(n AS BIGINT) AS violations FROM tallied, lists, LATERAL (VALUES ('no post id', ids), ('id not numeric', ids), ('no artist', artists),
            ('no song', songs), ('no page count', pages), ('no page size', sizes), ('too few songs', CASE WHEN found < promised THEN 1 ELSE 0 END)) t(rule, n)"""),
    "pages_decoded": (pages_decoded, f"SELECT page_id, md5({_decode('html')}) AS decoded_hash FROM pages"),
    "entity_report": (entity_report, """SELECT entity, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM (
            SELECT page_id, unnest(regexp_extract_all(html, '&([a-zA-Z][a-zA-Z0-9]*);', 1)) AS entity FROM pages)
        WHERE entity NOT IN ('amp', 'lt', 'gt', 'quot', 'apos', 'nbsp', 'ndash', 'mdash', 'hellip', 'lsquo', 'rsquo', 'ldquo', 'rdquo', 'deg') GROUP BY entity"""),
}
