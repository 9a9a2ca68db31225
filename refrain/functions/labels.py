"""Labels and keys of the browsing side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def decade_key(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("string")


def decade_label(key: Column) -> Column:
    return F.concat(F.substring(key, 3, 8), F.lit("s"))


def genre_label(genre: Column) -> Column:
    """Every ASCII word capitalised, but for a few fixed spellings."""
    lowered = F.lower(genre)
    words = F.regexp_extract_all(lowered, F.lit(r"(?s)[a-z]?(?:[A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(0))
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.coalesce(_lookup(fixed.SPECIAL_GENRES, lowered), titled)


def language_label(code: Column) -> Column:
    return F.coalesce(_lookup(fixed.LANGUAGE_LABELS, code), code)


def is_labelled_language(code: Column) -> Column:
    return F.coalesce(code.isin(*fixed.LANGUAGE_LABELS), F.lit(False))


def collection_label(kind: Column, key: Column) -> Column:
    return (
        F.when(kind == "decade", decade_label(key)).when(kind == "lang", language_label(key))
        .when(kind == "genre", genre_label(key)).otherwise(key)
    )


def categories_from_show(source: Column) -> Column:
    """Categories a show implies: contests name themselves, films and stage shows are looked up."""
    derived = F.array_compact(F.array(*[
        F.when(source.isin(*shows), F.lit(category)) for category, shows in fixed.SHOWS_BY_CATEGORY.items()
    ]))
    return (
        F.when(source.isNull() | (source == ""), F.array().cast("array<string>"))
        .when(source.isin(*fixed.CONTESTS), F.array(source)).otherwise(derived)
    )


def all_categories(categories: Column, source: Column) -> Column:
    """Explicit categories, then derived ones, each once."""
    return F.array_distinct(F.concat(
        F.coalesce(categories, F.array().cast("array<string>")), categories_from_show(source)
    ))


def categories_label(categories: Column) -> Column:
    return F.coalesce(F.array_join(categories, ", "), F.lit(""))


def performer(artist: Column, categories: Column) -> Column:
    """The artist, or the joined categories where there is none."""
    return F.coalesce(F.nullif(artist, F.lit("")), categories_label(categories))


def subtitle(artist: Column, categories: Column, source: Column, year: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(
        " · ", F.nullif(performer(artist, categories), empty), F.nullif(source, empty),
        F.nullif(year, F.lit(0)).cast("string"),
    )


def song_meta(source: Column, year: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(source, F.lit("")), F.nullif(year, F.lit(0)).cast("string"))


def _points(present: Column, points: int) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), points).otherwise(0)


def enrichment_score(
    year: Column, source: Column, artists: Column, genres: Column, language: Column, categories: Column
) -> Column:
    """How much is known about a song; the richest copy represents its variants."""
    return (
        _points(year.isNotNull(), 2) + _points(source != "", 2) + _points(F.size(artists) > 0, 2)
        + _points(F.size(genres) > 0, 1) + _points(language != "", 1) + _points(F.size(categories) > 0, 1)
    )


def in_collection(kind: str, key: str) -> Column:
    """Membership of a composed song (year, genres, categories, from, language) in one collection."""
    tests = {
        "decade": lambda: decade_key(F.col("year")) == key,
        "genre": lambda: F.array_contains("genres", key),
        "category": lambda: F.array_contains(all_categories(F.col("categories"), F.col("from")), key),
        "from": lambda: F.col("from") == key,
        "lang": lambda: F.col("language") == key,
    }
    return F.coalesce(tests[kind](), F.lit(False))
