"""Artist strings: leads, fragments, annotations and the name to display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed
from refrain.functions.text import NOT_ASCII, any_word, before_first, bind, js_trim, name_key, parted, pattern, unmarked

JOIN = pattern(fixed.CREDIT_JOIN)
JOIN_GREEDY = pattern(fixed.CREDIT_JOIN_GREEDY)
JOIN_NARROW = pattern(fixed.CREDIT_JOIN_NARROW)
ARTIST_NOTE = pattern(fixed.ARTIST_ANNOTATION)
ARTICLE = pattern(fixed.LEADING_ARTICLE)
LATIN = r"\p{IsLatin}"
LETTER = r"\p{L}"


def strip_artist_annotation(artist: Column) -> Column:
    """Drop a bracket that names a show rather than a performer."""
    return js_trim(F.regexp_replace(artist, ARTIST_NOTE, ""))


def artist_annotation_source(artist: Column) -> Column:
    """The show named by such a bracket, else null."""
    note = F.regexp_extract(artist, ARTIST_NOTE, 1)
    for words in ("soundtrack", "original motion picture", "the movie"):
        note = F.regexp_replace(note, any_word([words]), "")
    note = js_trim(F.regexp_replace(note, pattern(r"""\A(?:{S}|["'“”‘’])+|(?:{S}|["'“”‘’])+\z"""), ""))
    return bind(note, lambda n: F.when(
        artist.rlike(ARTIST_NOTE) & (n != ""),
        F.when(F.lower(n) == "fellowship of the ring", "The Fellowship of the Ring").otherwise(n),
    ))


def lead_artist(artist: Column) -> Column:
    """First name of a joint credit, null when the credit has one name."""
    return bind(js_trim(before_first(artist, JOIN)), lambda lead: F.when((lead != "") & (lead != js_trim(artist)), lead))


def lead_name(artist: Column) -> Column:
    """First name by spaced join words only; the whole string when there is no lead."""
    lead = js_trim(before_first(artist, JOIN_NARROW))
    return F.when(lead == "", artist).otherwise(lead)


def artist_fragments(artist: Column, greedy: bool = False) -> Column:
    """Every named part; the greedy form over-splits, and is empty unless there are two parts."""
    parts = F.transform(parted(artist, JOIN_GREEDY if greedy else JOIN), js_trim)
    if not greedy:
        return F.filter(parts, lambda p: p != "")
    return bind(F.filter(parts, lambda p: F.length(p) > 1), lambda kept: F.when(
        F.size(kept) > 1, F.array_distinct(kept)
    ).otherwise(F.array().cast("array<string>")))


def has_article(name: Column) -> Column:
    return name.rlike(ARTICLE)


def is_placeholder(name: Column) -> Column:
    """Bracketed stand-in entities such as ``[traditional]``."""
    return F.coalesce(name.rlike(r"\A\[.*\]\z"), F.lit(False))


def is_tribute(disambiguation: Column) -> Column:
    return F.coalesce(disambiguation.rlike(any_word(fixed.TRIBUTE_WORDS)), F.lit(False))


def is_karaoke_junk(artist: Column, title: Column, album: Column) -> Column:
    junk = any_word(fixed.KARAOKE_JUNK)
    tests = [F.coalesce(c.rlike(junk), F.lit(False)) for c in (artist, title, album)]
    return tests[0] | tests[1] | tests[2]


def plain_hyphens(name: Column) -> Column:
    return F.translate(name, "‐‑‒–—―−", "-------")


def has_stylised_letters(name: Column) -> Column:
    """A letter outside ASCII, also one that only appears after decomposition."""
    foreign = F.regexp_replace(name, r"[\x00-\x7F]+", "")
    return foreign.rlike(LETTER) | unmarked(foreign).rlike(LETTER)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def _display_order(a: Column, b: Column) -> Column:
    """Negative when alias ``a`` is the better display form (both plain ASCII but for hyphens)."""
    ah, bh = plain_hyphens(a), plain_hyphens(b)
    spaced = ~F.contains(ah, F.lit("-")) & ~F.contains(bh, F.lit("-"))
    steps = [
        _flag(b.rlike("[★☆°]")) - _flag(a.rlike("[★☆°]")),
        _flag(bh.rlike(pattern(r"\A(?:(?!{S}).)+-(?:(?!{S}).)+\z")))
        - _flag(ah.rlike(pattern(r"\A(?:(?!{S}).)+-(?:(?!{S}).)+\z"))),
        _flag(a.rlike(pattern("{S}-{S}"))) - _flag(b.rlike(pattern("{S}-{S}"))),
        _flag(spaced & F.contains(b, F.lit(" "))) - _flag(spaced & F.contains(a, F.lit(" "))),
    ]
    order = F.length(a) - F.length(b)
    for step in reversed(steps):
        order = F.when(step != 0, step).otherwise(order)
    return order


def display_name(name: Column, aliases: Column, curated: Column) -> Column:
    """Curated name, else the primary one unless a plain or Latin alias reads better."""
    known = F.coalesce(aliases, F.array().cast("array<string>"))
    plain = F.filter(
        known,
        lambda a: ~plain_hyphens(a).rlike(NOT_ASCII) & a.rlike(LATIN) & (name_key(a) == name_key(name)),
    )
    best_plain = F.try_element_at(F.array_sort(plain, _display_order), F.lit(1))
    first_latin = F.try_element_at(F.filter(known, lambda a: a.rlike(LATIN)), F.lit(1))
    return F.coalesce(
        curated,
        F.when(~name.rlike(LETTER), name)
        .when(
            name.rlike(LATIN),
            plain_hyphens(F.coalesce(F.when(has_stylised_letters(name), best_plain), name)),
        )
        .otherwise(F.coalesce(first_latin, name)),
    )


def letter_bucket(name: Column) -> Column:
    first = F.upper(F.substring(js_trim(name), 1, 1))
    return F.when(first.rlike(r"\A[A-Z]\z"), first).otherwise("#")
