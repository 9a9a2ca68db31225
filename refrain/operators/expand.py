"""Expansion: every key a catalogue song could be filed under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.names import ARTICLE, has_article, strip_artist_annotation
from refrain.functions.text import any_word, bind, combined_lookup, pattern
from refrain.functions.titles import (
    VERSION_WORD, asks_for_language_version, is_language_version, note_language, strip_annotation, trailing_bracket,
    with_language_capitalised,
)

AND = pattern(r"(?i){S}and{S}")
LYING = any_word(["lying"])
LYIN = any_word(["lyin'?"])
PROPOSAL_FIELDS = {
    "why": "string", "from": "string", "language": "string", "proposal_artist": "string", "venue_artist": "string",
}


def _form(value: Column, *rewrites: str) -> Column:
    return F.struct(
        value.alias("value"), F.array(*[F.lit(r) for r in rewrites]).cast("array<string>").alias("rewrites")
    )


def _rewritten(forms: Column, when, value, rewrite: str) -> Column:
    """One more form for each that qualifies, with the rewriting noted."""
    return F.transform(
        F.filter(forms, lambda f: when(f["value"])),
        lambda f: F.struct(
            value(f["value"]).alias("value"), F.array_append(f["rewrites"], F.lit(rewrite)).alias("rewrites")
        ),
    )


def _spelled_out(unspelled: Column) -> Column:
    return bind(unspelled, lambda forms: F.concat(
        forms,
        _rewritten(
            forms, lambda v: F.contains(v, F.lit("&")), lambda v: F.replace(v, F.lit("&"), F.lit(" and ")),
            "ampersand-spelled-out",
        ),
        _rewritten(forms, lambda v: v.rlike(AND), lambda v: F.regexp_replace(v, AND, " & "), "ampersand-spelled-out"),
    ))


def artist_forms(artist: Column) -> Column:
    """array<struct(value, rewrites)>: as written, without a show note, with an article, & and and."""
    bare = strip_artist_annotation(artist)
    base = F.filter(
        F.array(F.when(artist.isNotNull(), _form(artist)),
                F.when((bare != artist) & (bare != ""), _form(bare, "annotation-stripped"))),
        lambda f: f.isNotNull(),
    )
    return _spelled_out(bind(base, lambda forms: F.concat(forms, _rewritten(
        forms, lambda v: ~has_article(v), lambda v: F.concat(F.lit("The "), v), "artist-article-added"
    ))))


def title_forms(title: Column) -> Column:
    """array<struct(value, rewrites)> over brackets, articles, contractions, & and and."""
    def base(note: Column, bare: Column, normal: Column) -> Column:
        by_language = is_language_version(note)
        named = F.concat(bare, F.lit(" ("), note_language(note), F.lit(" version)"))
        return F.filter(
            F.array(
                F.when(title.isNotNull(), _form(title)),
                F.when(by_language & (normal != title), _form(normal)),
                F.when(by_language & ~note.rlike(VERSION_WORD), _form(named)),
                F.when(~by_language & (bare != title) & (bare != ""), _form(bare, "annotation-stripped")),
            ),
            lambda f: f.isNotNull(),
        )

    def other_articles(f: Column) -> Column:
        def noted(value: Column, rewrite: str) -> Column:
            return F.struct(value.alias("value"), F.array_append(f["rewrites"], F.lit(rewrite)).alias("rewrites"))

        return F.when(
            has_article(f["value"]),
            F.array(noted(F.regexp_replace(f["value"], ARTICLE, ""), "title-article-dropped")),
        ).otherwise(F.array(*[
            noted(F.concat(F.lit(f"{word} "), f["value"]), "title-article-added") for word in ("The", "A", "An")
        ]))

    def contracted(forms: Column) -> Column:
        return F.concat(
            forms,
            _rewritten(forms, lambda v: v.rlike(LYING), lambda v: F.regexp_replace(v, LYING, "lyin'"),
                       "title-contraction"),
            _rewritten(forms, lambda v: v.rlike(LYIN), lambda v: F.regexp_replace(v, LYIN, "lying"),
                       "title-contraction"),
        )

    notes = F.struct(trailing_bracket(title).alias("note"), strip_annotation(title).alias("bare"))
    bases = bind(notes, lambda k: bind(
        F.when(is_language_version(k["note"]), with_language_capitalised(title, k["note"])),
        lambda normal: base(k["note"], k["bare"], normal),
    ))
    articled = bind(bases, lambda forms: F.concat(forms, F.flatten(F.transform(forms, other_articles))))
    return _spelled_out(bind(articled, contracted))


def keys_for(artist: Column, title: Column) -> Column:
    """array<struct(key, rank, seq, rewrites)>: one entry per key, its least rewritten form.

    A key folds character by character, so each form is folded once and the pairs only
    concatenate. Sorting by (key, rank, seq) inside the row replaces a shuffle for the
    de-duplication.
    """
    def folded(forms: Column) -> Column:
        return F.transform(forms, lambda f, i: F.struct(
            combined_lookup(f["value"]).alias("key"), f["rewrites"].alias("rewrites"), i.alias("at")
        ))

    def pair(a: Column, t: Column) -> Column:
        return F.struct(
            F.concat(a["key"], t["key"]).alias("key"),
            (F.size(a["rewrites"]) + F.size(t["rewrites"])).alias("rank"),
            (a["at"] * 1000 + t["at"]).alias("seq"),
            F.concat(a["rewrites"], t["rewrites"]).alias("rewrites"),
        )

    pairs = bind(folded(title_forms(title)), lambda titles: F.flatten(F.transform(
        folded(artist_forms(artist)), lambda a: F.transform(titles, lambda t: pair(a, t))
    )))
    return bind(F.array_sort(pairs), lambda ordered: F.filter(
        ordered, lambda p, i: (p["key"] != "") & ((i == 0) | (F.get(ordered, i - 1)["key"] != p["key"]))
    ))


def _keys_of(df: DataFrame, artist: str, title: str, carried: list[str]) -> DataFrame:
    return (
        df.select("post_id", *carried, F.explode(keys_for(F.col(artist), F.col(title))).alias("k"))
        .select("post_id", "k.key", "k.rank", "k.rewrites", *[F.col(f"`{c}`") for c in carried])
    )


def wanted_keys(catalog: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(post_id, key, rank, rewrites, proposed, ...) for the catalogue's strings and for proposals.

    ``catalog`` has post_id, artist, song; ``proposals`` has post_id and nullable artist, title,
    from, language, why. Proposal entries carry rank 99 so that they never win a plain tie. Every
    entry says whether its song asks for a language version.
    """
    asks = asks_for_language_version(F.col("song"))
    catalog = _spread(catalog)
    if proposals is None:
        own = _keys_of(catalog.withColumn("allow_language", asks), "artist", "song", ["allow_language"])
        return _plain_entries(own)
    put = proposals.select(
        "post_id", F.col("artist").alias("proposal_artist"), F.col("title").alias("proposal_title"), "from", "language",
        "why", F.lit(True).alias("has_proposal"),
    )
    full = catalog.select("post_id", "artist", "song").join(put, "post_id", "left").withColumn(
        "allow_language", asks | asks_for_language_version(F.col("proposal_title"))
    )
    own = _keys_of(full, "artist", "song", ["allow_language"])
    asked = full.filter("has_proposal").withColumns({
        "as_artist": F.coalesce("proposal_artist", "artist"), "as_title": F.coalesce("proposal_title", "song"),
        "venue_artist": F.col("artist"),
    })
    entries = _keys_of(asked, "as_artist", "as_title", ["allow_language", *PROPOSAL_FIELDS])
    return _plain_entries(own).unionByName(
        entries.withColumn("rank", F.lit(fixed.PROPOSED_RANK)).withColumn("proposed", F.lit(True))
    )


def _spread(catalog: DataFrame) -> DataFrame:
    """Narrow rows dealt out evenly before each becomes dozens: the work is per row, not per byte."""
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return catalog.select("post_id", "artist", "song").repartition(parts, "post_id")


def _plain_entries(own: DataFrame) -> DataFrame:
    return own.withColumn("proposed", F.lit(False)).select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in PROPOSAL_FIELDS.items()]
    )


def allowed_language(catalog: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(post_id, allow_language): songs that ask for a language version themselves."""
    asks = catalog.select("post_id", asks_for_language_version(F.col("song")).alias("allow_language"))
    if proposals is None:
        return asks
    named = proposals.select("post_id", asks_for_language_version(F.col("title")).alias("by_proposal"))
    return asks.join(named, "post_id", "left").select(
        "post_id", (F.col("allow_language") | F.coalesce("by_proposal", F.lit(False))).alias("allow_language")
    )


def explode_list(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per element of an array column (credits, genres, categories, ids), position kept."""
    return df.select("*", F.posexplode(column).alias("position", alias))
