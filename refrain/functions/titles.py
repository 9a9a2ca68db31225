"""Titles: bracket notes, masters, language versions and the title to publish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.similarity import title_names_work, titles_corroborate
from refrain.functions.text import SPACE, any_word, before_first, bind, combined_lookup, combined_lookup_of, js_trim, pattern, squeeze, title_key

TRAILING = pattern(fixed.TRAILING_BRACKET)
MASTER = any_word(fixed.MASTER_MARKERS)
LANGUAGE = any_word(fixed.LANGUAGES)
VERSION_WORD = any_word(["version"])
EXCERPT_NAME = r"""Excerpt From{S}+['"“”‘’]?[^'"“”‘’/]+['"“”‘’]?"""
QUOTED_EDGE = r"""\A(?:{S}|["'“”‘’])+|(?:{S}|["'“”‘’])+\z"""


def trailing_bracket(title: Column) -> Column:
    """Text inside one trailing bracket, null when there is none."""
    return F.when(title.rlike(TRAILING), F.regexp_extract(title, TRAILING, 1))


def strip_annotation(title: Column) -> Column:
    return js_trim(F.regexp_replace(title, TRAILING, ""))


def is_language_version(note: Column) -> Column:
    alone = r"(?i)\A(?:" + "|".join(fixed.LANGUAGES) + r")\z"
    text = js_trim(note)
    return F.coalesce(text.rlike(alone) | (text.rlike(LANGUAGE) & text.rlike(VERSION_WORD)), F.lit(False))


def asks_for_language_version(title: Column) -> Column:
    """Whether the title itself names a language version."""
    return F.coalesce(
        is_language_version(trailing_bracket(title)) | (title.rlike(LANGUAGE) & title.rlike(VERSION_WORD)),
        F.lit(False),
    )


def note_language(note: Column) -> Column:
    """First language word of a note, capitalised."""
    return F.initcap(F.lower(F.regexp_extract(note, LANGUAGE, 0)))


def with_language_capitalised(title: Column, note: Column) -> Column:
    """The title with the first spelling of the note's language capitalised."""
    word = F.regexp_extract(note, LANGUAGE, 0)
    first = F.regexp_replace(
        title, F.concat(F.lit(r"(?is)\A(.*?)"), word), F.concat(F.lit("$1"), note_language(note))
    )
    return squeeze(first)


def is_master(note: Column) -> Column:
    return F.coalesce(js_trim(note).rlike(MASTER), F.lit(False))


def is_subtitle(note: Column) -> Column:
    """A bracket that belongs to the song's name rather than to one recording of it."""
    text = js_trim(note)
    return (
        F.when(text.isNull() | (text == ""), False)
        .when(is_language_version(text), True)
        .when(text.rlike(pattern(r"(?i)\Afrom{B}")), True)
        .when(text.rlike(MASTER), False)
        .otherwise(text.rlike(any_word(fixed.SUBTITLE_MARKERS)))
    )


def source_annotation(recording: Column) -> Column:
    """The show or film named by a trailing ``(from ...)`` note, else null."""
    def shown(note: Column) -> Column:
        named = F.regexp_replace(note, pattern(r"(?i)\A{S}*from{S}+"), "")
        named = F.regexp_replace(
            named, pattern(r"(?i){S}*(?:original{S}+)?(?:motion{S}+picture{S}+)?soundtrack{S}*\z"), ""
        )
        return js_trim(F.regexp_replace(named, pattern(QUOTED_EDGE), ""))

    return bind(trailing_bracket(recording), lambda note: F.when(
        note.rlike(any_word(["from"])), F.nullif(shown(note), F.lit(""))
    ))


def strip_excerpt(title: Column) -> Column:
    """Drop a ``/ Excerpt From '...'`` tail; never leaves nothing."""
    cleaned = F.regexp_replace(title, pattern("(?i){S}*/{S}*" + EXCERPT_NAME), "")
    cleaned = squeeze(F.regexp_replace(cleaned, pattern("(?i){B}" + EXCERPT_NAME), ""))
    return bind(cleaned, lambda c: F.when(c == "", title).otherwise(c))


def _titled(title: Column, source: Column | None = None) -> Column:
    source = F.lit(None).cast("string") if source is None else source
    return F.struct(title.alias("title"), source.alias("from"))


def title_from_recording(recording: Column) -> Column:
    """struct(title, from) with master notes and excerpt tails dropped."""
    def kept() -> Column:
        return bind(strip_annotation(recording), lambda bare: F.when(bare == "", recording).otherwise(bare))

    return bind(trailing_bracket(recording), lambda note: (
        F.when(~is_master(note), _titled(strip_excerpt(recording)))
        .when(is_language_version(note), _titled(strip_excerpt(with_language_capitalised(recording, note))))
        .otherwise(_titled(strip_excerpt(kept()), source_annotation(recording)))
    ))


def medley_head(recording: Column) -> Column:
    """First half of an ``A / B`` title, null when the title is not one."""
    return bind(
        js_trim(before_first(recording, f"{SPACE}/{SPACE}")),
        lambda head: F.when((head != "") & (head != recording), head),
    )


def published_title(recording: Column, work: Column, how: Column) -> Column:
    """struct(title, from, source): the work's title where it is the same song, else the recording's."""
    facts = F.struct(
        recording.alias("recording"), work.alias("work"), F.coalesce(how == "version", F.lit(False)).alias("version"),
        strip_annotation(recording).alias("bare"), strip_annotation(medley_head(recording)).alias("head"),
    )

    def own_title(k: Column) -> Column:
        head, bare = strip_excerpt(k["head"]), strip_excerpt(k["bare"])
        return (
            F.when(k["version"] & F.coalesce(k["head"] != "", F.lit(False)), _titled(head))
            .when(
                k["version"] & k["recording"].rlike(TRAILING) & (k["bare"] != ""),
                _titled(bare, source_annotation(k["recording"])),
            )
            .otherwise(title_from_recording(k["recording"]))
        )

    def chosen(k: Column, own: Column) -> Column:
        whole = F.when(k["bare"] == "", k["recording"]).otherwise(k["bare"])
        takes_work = F.coalesce(
            title_names_work(strip_excerpt(whole), k["work"])
            & (
                (title_key(own["title"]) == title_key(k["work"]))
                | (~k["version"] & ~titles_corroborate(own["title"], k["work"]))
            ),
            F.lit(False),
        )
        return bind(takes_work, lambda w: F.struct(
            F.when(w, k["work"]).otherwise(own["title"]).alias("title"), own["from"].alias("from"),
            F.when(w, F.lit("work")).otherwise(F.lit("recording")).alias("source"),
        ))

    return bind(facts, lambda k: bind(own_title(k), lambda own: chosen(k, own)))


def is_live_release(release: Column) -> Column:
    """Concerts, bootlegs and releases named after a venue."""
    return F.coalesce(
        release.rlike(pattern(fixed.DATED_RELEASE))
        | release.rlike(any_word(fixed.LIVE_RELEASE_WORDS))
        | release.rlike(any_word(fixed.LIVE_VENUES)),
        F.lit(False),
    )


def is_variant_recording(recording: Column, allow_language: Column) -> Column:
    """Remixes, acoustic takes, mash-ups and unasked language versions."""
    note = js_trim(trailing_bracket(recording))
    return F.coalesce(
        F.when(note.isNull(), recording.rlike(pattern(r"(?i){B}vs\.?{B}")) | recording.rlike(any_word(fixed.VARIANT_WORDS)))
        .when(is_language_version(note), ~allow_language)
        .when(is_master(note), True)
        .when(is_subtitle(note), False)
        .when(note.rlike(r"\A(?:19|20)[0-9]{2}\z"), True)
        .when(note.rlike(pattern(r"(?i)\A(?:feat\.?|ft\.?|featuring){B}")), True)
        .when(note.rlike(pattern(r"(?i){B}(?:dj|vs\.?|versus){B}|{S}x{S}")), True)
        .otherwise(note.rlike(pattern(fixed.REMIXER_NAMES))),
        F.lit(False),
    )


def match_quality(score: Column, release: Column, recording: Column, allow_language: Column) -> Column:
    """Lower is better: live and variant rows sink, a release named for the song rises."""
    return (
        score
        + F.when(is_live_release(release), fixed.LIVE_PENALTY).otherwise(0)
        + F.when(is_variant_recording(recording, allow_language), fixed.VARIANT_PENALTY).otherwise(0)
        - F.when(
            combined_lookup(release) == combined_lookup_of(strip_annotation(recording)), fixed.TITLE_RELEASE_BONUS
        ).otherwise(0)
    )


def title_alternatives(title: Column) -> Column:
    """The title and its bracket-stripped form, distinct."""
    return F.array_distinct(F.array(title, strip_annotation(title)))


def title_variants(title: Column) -> Column:
    """Spellings another catalogue may use: U for You, no trailing Anymore."""
    def dropped(c: Column) -> Column:
        return js_trim(F.regexp_replace(c, pattern(r"(?i){S}+Anymore{S}*\z"), ""))

    you = F.regexp_replace(title, pattern("{B}U{B}"), "You")
    u = F.regexp_replace(title, pattern("{B}You{B}"), "U")
    others = F.filter(F.array(you, u, dropped(title), dropped(you)), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(title), others))
