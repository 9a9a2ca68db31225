"""Audits, reviews, second opinions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.names import is_karaoke_junk, lead_name
from refrain.functions.similarity import names_agree, titles_corroborate
from refrain.functions.text import any_word, pattern
from refrain.functions.titles import title_variants

AUDIT_EMPTY = ["bootleg_match", "version_published", "remixer_published", "year_published", "mashup_recording"]


def _holds(c: Column, regex: str) -> Column:
    return F.coalesce(c.rlike(pattern(regex)), F.lit(False))


def audit_flags(matches: DataFrame, resolved: DataFrame) -> DataFrame:
    """Seven pollution flags per matched song; the first five must never be set."""
    rows = matches.filter("matched").join(resolved.select(
        "post_id", F.col("title").alias("fixed_title")
    ), "post_id", "left")
    shown = F.coalesce("fixed_title", "title", "song")
    recording, release = F.col("recording"), F.col("release")
    master = r"(?i)\(([^)]*{B}(?:" + "|".join(fixed.AUDIT_MASTER_WORDS) + r"){B}[^)]*)\){S}*\z"
    version = r"(?i){B}(?:" + "|".join(fixed.LANGUAGES) + r"){S}+version{B}"
    return rows.withColumn("shown", shown).select(
        "post_id", "shown", "recording", "release", "how",
        (_holds(recording, "(?i){B}bootleg{B}") | _holds(release, "(?i){B}bootleg{B}")).alias("bootleg_match"),
        (_holds(F.col("shown"), master) & ~_holds(F.col("shown"), version)
         & ~_holds(F.col("shown"), any_word(fixed.AUDIT_SUBTITLES))).alias("version_published"),
        _holds(F.col("shown"), fixed.AUDIT_REMIXER).alias("remixer_published"),
        _holds(F.col("shown"), fixed.AUDIT_YEAR).alias("year_published"),
        _holds(recording, r"(?i){B}vs\.?{B}").alias("mashup_recording"),
        (_holds(release, any_word(fixed.AUDIT_LIVE_RELEASES)) | _holds(recording, r"(?i)\(.*{B}live{B}.*\)")
         | _holds(recording, r"(?i)-{S}*Live{S}*\z")).alias("live_release"),
        F.coalesce(~F.col("trusted"), F.lit(False)).alias("untrusted"),
    )


def audit(matches: DataFrame, resolved: DataFrame) -> DataFrame:
    """(bucket, songs, must_be_empty): one pass of counts over all flags."""
    buckets = [*AUDIT_EMPTY, "live_release", "untrusted"]
    counts = audit_flags(matches, resolved).agg(*[F.count_if(F.col(b)).alias(b) for b in buckets])
    return counts.unpivot([], buckets, "bucket", "songs").withColumn(
        "must_be_empty", F.col("bucket").isin(*AUDIT_EMPTY)
    )


def match_summary(matches: DataFrame) -> DataFrame:
    """(measure, name, songs): totals, ways found, rewritings needed, placeholders."""
    totals = matches.agg(
        F.count(F.lit(1)).alias("all"), F.count_if("matched").alias("matched"),
        F.count_if(F.coalesce("trusted", F.lit(False))).alias("trusted"),
        F.count_if(F.coalesce("placeholder", F.lit(False))).alias("placeholder"),
    ).unpivot([], ["all", "matched", "trusted", "placeholder"], "name", "songs").select(
        F.lit("total").alias("measure"), "name", "songs"
    )
    found = matches.filter("matched")
    hows = found.groupBy(F.col("how").alias("name")).agg(F.count(F.lit(1)).alias("songs"))
    rewrites = found.select("post_id", F.explode(F.array_distinct("rewrites")).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).alias("songs")
    )
    return totals.unionByName(hows.select(F.lit("how").alias("measure"), "name", "songs")).unionByName(
        rewrites.select(F.lit("rewrite").alias("measure"), "name", "songs")
    )


def overrides_review(overrides: DataFrame, catalog: DataFrame) -> DataFrame:
    """What the catalogue had beside what each override decided, in catalogue order."""
    return overrides.select(
        "post_id", F.col("artist").alias("set_artist"), F.col("title").alias("set_title"), "categories", "why"
    ).join(catalog.select("post_id", "id", "artist", "song"), "post_id", "left").select(
        "post_id", "id", "artist", "song", F.coalesce("set_artist", "artist").alias("shown_artist"),
        F.coalesce("set_title", "song").alias("shown_title"),
        F.array_join(F.array_distinct("categories"), ", ").alias("categories"), "why",
    ).orderBy(F.coalesce("id", "post_id"), "post_id")


def proposals_review(proposals: DataFrame, matches: DataFrame) -> DataFrame:
    """Each proposal with its fate: yes, other (something else matched) or no."""
    venue = matches.select("post_id", "id", F.col("artist").alias("had_artist"), "song", "matched", "proposed")
    return proposals.join(venue, "post_id", "left").select(
        "post_id", "id", "had_artist", "song", F.coalesce("artist", "had_artist").alias("shown_artist"),
        F.coalesce("title", "song").alias("shown_title"), "from", "language", "why",
        F.when(~F.coalesce("matched", F.lit(False)), "no").when(F.col("proposed").isNotNull(), "yes")
        .otherwise("other").alias("status"),
    ).orderBy(F.coalesce("id", "post_id"), "post_id")


# --- second opinions -----------------------------------------------------------------------


def _asked(questions: DataFrame) -> DataFrame:
    """Queries per (artist, title), in order: exact fields by artist then spelling, then free text by the lead."""
    artists = F.array_distinct(F.filter(F.array(F.col("artist"), lead_name(F.col("artist"))), lambda a: a != ""))
    spelled = questions.select("artist", "title", F.posexplode(title_variants(F.col("title"))).alias("t", "query_title"))
    fielded = spelled.select("*", F.posexplode(artists).alias("a", "query_artist")).select(
        "artist", "title", "query_artist", "query_title", F.lit(False).alias("free"), (F.col("a") * 100 + F.col("t")).alias("turn")
    )
    return fielded.unionByName(spelled.select(
        "artist", "title", lead_name(F.col("artist")).alias("query_artist"), "query_title", F.lit(True).alias("free"),
        (F.col("t") + 10_000).alias("turn"),
    ))


def corroborate(published: DataFrame, hits: DataFrame) -> DataFrame:
    """First-source verdict per published (post_id, artist, title).

    ``hits``: query_artist, query_title, free, hit_rank, artist, title, album. Karaoke rows never
    count. The first hit agreeing on artist and title wins; else the first hit of any kind is
    reported as a miss. Songs sharing both strings ask once, and equal hits of a query count once.
    """
    questions = published.filter(F.trim("artist") != "").select("artist", "title").distinct()
    usable = hits.filter(
        F.col("artist").isNotNull() & F.col("title").isNotNull()
        & ~is_karaoke_junk(F.col("artist"), F.col("title"), F.col("album"))
    ).groupBy(
        "query_artist", "query_title", "free", F.col("artist").alias("hit_artist"), F.col("title").alias("hit_title")
    ).agg(F.min("hit_rank").alias("hit_rank"))
    graded = _asked(questions).join(usable, ["query_artist", "query_title", "free"]).withColumn("agrees", (
        (names_agree(F.col("hit_artist"), F.col("artist")) | names_agree(F.col("hit_artist"), F.col("query_artist")))
        & titles_corroborate(F.col("hit_title"), F.col("title"))
    ))
    best = graded.groupBy("artist", "title").agg(F.min_by(
        F.struct("agrees", "hit_artist", "hit_title"), F.struct(~F.col("agrees"), "turn", "hit_rank", "hit_artist", "hit_title")
    ).alias("b"))
    blank = F.trim(F.col("artist")) == ""
    return published.join(best, ["artist", "title"], "left").select(
        "post_id", "artist", "title", (blank | F.coalesce("b.agrees", F.lit(False))).alias("ok"),
        F.col("b.hit_artist").alias("hit_artist"), F.col("b.hit_title").alias("hit_title"),
        F.when(blank, "no artist").when(F.col("b").isNull(), "no hits")
        .when(~F.col("b.agrees"), "best hit did not agree").alias("note"),
    )


def second_source(published: DataFrame, releases: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Weaker second source: any release hit for (artist, title) is enough; optionally only on a first miss.

    ``releases``: query_artist, query_title, hit_rank, title. The note tells whether the hit names the artist.
    """
    hits = releases.filter(F.col("title").isNotNull()).groupBy("query_artist", "query_title").agg(
        F.min_by("title", "hit_rank").alias("release")
    ).withColumnsRenamed({"query_artist": "artist", "query_title": "title"})
    rows = published.join(hits, ["artist", "title"], "left")
    blank = F.trim("artist") == ""
    head = F.substring(F.lower("artist"), 1, 12)
    named = names_agree(F.col("release"), F.col("artist")) | F.contains(F.lower("release"), head)
    skipped = F.lit(False)
    if first is not None:
        rows = rows.join(first.select("post_id", F.col("ok").alias("first_ok")), "post_id", "left")
        skipped = F.coalesce("first_ok", F.lit(False))
    return rows.select(
        "post_id", "artist", "title", (blank | skipped | F.col("release").isNotNull()).alias("ok"),
        F.when(~blank & ~skipped, F.col("release")).alias("hit_title"),
        F.when(blank, "no artist").when(skipped, "skipped; first source agreed")
        .when(F.col("release").isNull(), "no release hits").when(~named, "release without the artist").alias("note"),
    )


def is_rate_limited(note: Column) -> Column:
    return F.coalesce(note.rlike(pattern(r"{B}HTTP (?:403|429){B}")), F.lit(False))


def adopt_legacy(checks: DataFrame) -> DataFrame:
    """Earlier runs' third source: an agreeing result stands in where the first source has none.

    Checks are post_id, artist, title, first, second, legacy; each source a struct(ok, artist,
    title, note) or null. Rate-limited second answers are dropped so that they are asked again.
    """
    stand_in = F.when(F.col("legacy.ok"), F.struct(
        F.col("legacy.ok").alias("ok"), F.col("legacy.artist").alias("artist"), F.col("legacy.title").alias("title"),
        F.coalesce(F.col("legacy.note"), F.lit("taken over from an earlier source")).alias("note"),
    ))
    return checks.withColumns({
        "first": F.coalesce("first", stand_in),
        "second": F.when(~is_rate_limited(F.col("second.note")), F.col("second")),
    }).drop("legacy")


def unchecked(songs: DataFrame, checks: DataFrame, limit: int | None = None) -> DataFrame:
    """Songs still to ask: no complete answer, or a rate-limited one."""
    complete = checks.filter(
        F.col("first").isNotNull() & F.col("second").isNotNull()
        & ~is_rate_limited(F.col("first.note")) & ~is_rate_limited(F.col("second.note"))
    ).select("post_id")
    todo = songs.join(complete, "post_id", "left_anti")
    return todo if limit is None else todo.orderBy("post_id").limit(limit)


def corroboration_summary(checks: DataFrame) -> DataFrame:
    """One row: checked, both, either, neither, incomplete, rate_limited."""
    def ok(source: str) -> Column:
        return F.coalesce(F.col(f"{source}.ok"), F.lit(False))

    limited = is_rate_limited(F.col("first.note")) | is_rate_limited(F.col("second.note"))
    present = F.col("first").isNotNull() & F.col("second").isNotNull()
    return checks.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(ok("first") & ok("second")).alias("both"),
        F.count_if(ok("first") | ok("second")).alias("either"),
        F.count_if(present & ~ok("first") & ~ok("second") & ~limited).alias("neither"),
        F.count_if(~present).alias("incomplete"), F.count_if(limited).alias("rate_limited"),
    )


def corroboration_review(checks: DataFrame) -> DataFrame:
    """Songs neither source agreed on, split into conflicting and not found."""
    agreed = F.coalesce(F.col("first.ok"), F.lit(True)) | F.coalesce(F.col("second.ok"), F.lit(True))
    limited = is_rate_limited(F.col("first.note")) | is_rate_limited(F.col("second.note"))
    shown = F.coalesce("first.artist", "first.title", "second.artist", "second.title")
    return checks.filter(~agreed & ~limited).select(
        "post_id", "artist", "title", F.when(shown.isNotNull(), "conflict").otherwise("not found").alias("kind"),
        F.concat_ws(" – ", "first.artist", "first.title").alias("first_says"),
        F.concat_ws(" – ", "second.artist", "second.title").alias("second_says"),
    )


def rescore(checks: DataFrame, published: DataFrame) -> DataFrame:
    """Old checks against new published strings: found hits are graded again, not-founds are dropped.

    Adds ``changed``, ``rescored`` and ``invalidated`` (sources touched) per check.
    """
    new = published.select("post_id", F.col("artist").alias("new_artist"), F.col("title").alias("new_title"))
    rows = checks.join(new, "post_id", "left").withColumn("changed", F.coalesce(
        (F.col("new_artist") != F.col("artist")) | (F.col("new_title") != F.col("title")), F.lit(False)
    ))

    def has_hit(source: Column) -> Column:
        return source["artist"].isNotNull() | source["title"].isNotNull()

    def graded(source: Column) -> Column:
        agrees = F.coalesce(names_agree(source["artist"], F.col("new_artist")), F.lit(True)) & F.coalesce(
            titles_corroborate(source["title"], F.col("new_title")), F.lit(True)
        )
        redone = F.struct(agrees.alias("ok"), source["artist"].alias("artist"), source["title"].alias("title"),
                          source["note"].alias("note"))
        return (
            F.when(~F.col("changed") | is_rate_limited(source["note"]), source)
            .when(has_hit(source), redone)
        )

    def touched(kind: str) -> Column:
        tests = []
        for name in ("first", "second"):
            source = F.col(name)
            hit = has_hit(source) if kind == "rescored" else ~has_hit(source)
            tests.append(F.when(
                F.col("changed") & source.isNotNull() & ~is_rate_limited(source["note"]) & hit, 1
            ).otherwise(0))
        return tests[0] + tests[1]

    marked = rows.withColumns({"rescored": touched("rescored"), "invalidated": touched("invalidated")})
    return marked.select(
        "post_id", F.when(F.col("changed"), F.col("new_artist")).otherwise(F.col("artist")).alias("artist"),
        F.when(F.col("changed"), F.col("new_title")).otherwise(F.col("title")).alias("title"),
        graded(F.col("first")).alias("first"), graded(F.col("second")).alias("second"),
        "changed", "rescored", "invalidated",
    )


# --- verdicts ------------------------------------------------------------------------------


def verdict_assertions(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(artist, assertion, passed): every scored assertion; observed cases carry a null outcome.

    ``checks``: artist, status, artist_count, collaboration, expect_name, same_entity_as,
    must_not_resolve, observe_only. ``verdicts``: artist, status, artists, is_collaboration.
    """
    known = verdicts.select(
        "artist", F.lit(True).alias("answered"), F.col("status").alias("got"),
        F.coalesce("artists", F.array().cast("array<struct<name:string,artist_id:string>>")).alias("named"),
        F.coalesce("is_collaboration", F.lit(False)).alias("joint"),
    )
    other = known.select(F.col("artist").alias("same_entity_as"), F.get("named", F.lit(0))["artist_id"].alias("other_id"))
    rows = checks.join(known, "artist", "left").join(other, "same_entity_as", "left")

    def one(name: str, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("assertion"), passed.cast("boolean").alias("passed"))

    def asked(column: str, name: str, passed: Column) -> Column:
        return F.when(F.col(column).isNotNull(), one(name, F.coalesce(passed, F.lit(False))))

    fields = F.array_compact(F.array(
        asked("status", "status", F.col("got") == F.col("status")),
        asked("artist_count", "artist_count", F.size("named") == F.col("artist_count")),
        asked("collaboration", "collaboration", F.col("joint") == F.col("collaboration")),
        asked("expect_name", "expect_name", F.exists("named", lambda a: a["name"] == F.col("expect_name"))),
    ))
    first_id = F.get("named", F.lit(0))["artist_id"]
    chosen = (
        F.when(F.col("answered").isNull(), F.array(one("answered", F.lit(False))))
        .when(F.col("observe_only").isNotNull(), F.array(one("observed", F.lit(None))))
        .when(F.coalesce("must_not_resolve", F.lit(False)), F.array(one("not resolved", F.col("got") != "resolved")))
        .when(F.col("same_entity_as").isNotNull(), F.array(one(
            "same entity", F.coalesce(first_id == F.col("other_id"), F.lit(False))
        )))
        .otherwise(fields)
    )
    return rows.select("artist", F.explode(chosen).alias("a")).select("artist", "a.assertion", "a.passed")


def score_verdicts(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: passed, checked, failed, observed, and verdicts nobody expected."""
    extra = verdicts.join(checks.select("artist"), "artist", "left_anti").select(F.lit("unexpected").alias("assertion"))
    rows = verdict_assertions(checks, verdicts).select("assertion", "passed").unionByName(extra, allowMissingColumns=True)
    return rows.agg(
        F.count_if("passed").alias("passed"), F.count("passed").alias("checked"), F.count_if(~F.col("passed")).alias("failed"),
        F.count_if(F.col("assertion") == "observed").alias("observed"),
        F.count_if(F.col("assertion") == "unexpected").alias("unexpected"),
    )


def same_entity_checks(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Whether two artist strings were given one first id: (artist, other, same)."""
    ids = verdicts.select("artist", F.get("artists", F.lit(0))["artist_id"].alias("artist_id"))
    return pairs.join(ids, "artist", "left").join(
        ids.withColumnsRenamed({"artist": "other", "artist_id": "other_id"}), "other", "left"
    ).select("artist", "other", F.coalesce(F.col("artist_id") == F.col("other_id"), F.lit(False)).alias("same"))


# --- profiles ------------------------------------------------------------------------------


def coverage_profile(catalog: DataFrame) -> DataFrame:
    """(songs_each, artists, songs, cumulative): how few artists hold how much of the catalogue."""
    sizes = catalog.groupBy("artist").agg(F.count(F.lit(1)).alias("songs_each"))
    buckets = sizes.groupBy("songs_each").agg(
        F.count(F.lit(1)).alias("artists"), F.sum("songs_each").alias("songs")
    )
    largest_first = Window.orderBy(F.desc("songs_each")).rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("cumulative", F.sum("songs").over(largest_first))


def case_clusters(catalog: DataFrame) -> DataFrame:
    """(folded, spellings, songs): artist strings that differ only by case."""
    spelled = catalog.groupBy("artist").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(F.lower("artist").alias("folded")).agg(
        F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("songs")
    ).filter("spellings > 1")


def duplicate_pairs(catalog: DataFrame) -> DataFrame:
    """(artist, song, copies): pairs listed more than once."""
    return catalog.groupBy("artist", "song").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dedupe_scrape(rows: DataFrame) -> DataFrame:
    """One row per post id, the earliest page's, ordered by id and post id."""
    return rows.groupBy("post_id").agg(F.min_by(
        F.struct(*[c for c in rows.columns if c != "post_id"]), F.struct("page", "place")
    ).alias("m")).select("post_id", "m.*").orderBy("id", "post_id")


def shared_ids(rows: DataFrame) -> DataFrame:
    """(id, songs): numbers more than one post carries."""
    return rows.groupBy("id").agg(F.count_distinct("post_id").alias("songs")).filter("songs > 1")
