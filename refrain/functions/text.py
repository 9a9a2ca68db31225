"""Match keys and slugs: text folded to comparable keys with built-in functions only.

Unicode decomposition is not a Spark function. Its one-to-one part becomes a ``translate`` table
generated from Python's ``unicodedata``, letters that become several are looked up in a second one, sign by
sign and only in text that has any, and Hangul syllables are taken apart by arithmetic. Text that is ASCII,
which is nearly all of it, skips the folding altogether.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions import fixed_values as fixed

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOT_ASCII = r"[^\x00-\x7F]"

#: Hangul syllables decompose by arithmetic: first of them, parts of each kind, and where the kinds of jamo begin.
HANGUL, VOWELS, TAILS = 0xAC00, 21, 28
JAMO = (0x1100, 0x1161, 0x11A7)
HANGUL_SIGNS = r"[\x{AC00}-\x{D7A3}]"


@lru_cache(maxsize=512)
def _literal(value: str, gateway: int) -> Column:
    return F.lit(value)


def text_literal(value: str) -> Column:
    """A string literal, built once per running JVM."""
    return _literal(value, id(SparkContext._gateway))


def pattern(template: str) -> str:
    """Fill the boundary and white-space marks of a fixed pattern."""
    return template.replace("{S}", SPACE).replace("{B}", BOUNDARY)


def any_word(words: list[str]) -> str:
    """A case-blind pattern for any of the words standing alone; words begin with a word character."""
    return pattern(r"(?i)(?<!\w)(?:" + "|".join(words) + "){B}")


@lru_cache(maxsize=1)
def decomposition() -> tuple[str, str, str, str]:
    """(letters, the one sign each becomes, letters that become several, these parted by NUL), marks removed.

    Over all code points but Hangul syllables. Marks become nothing, also those that Java does not know yet.
    """
    single, several = {}, {}
    for code in (*range(0x80, HANGUL), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        letter = chr(code)
        category = unicodedata.category(letter)
        if category in ("Cn", "Co"):
            continue
        base = "".join(p for p in unicodedata.normalize("NFKD", letter) if unicodedata.category(p)[0] != "M")
        if base != letter:
            (single if len(base) < 2 else several)[letter] = base
    # translate drops a letter that has no partner, so those with nothing left stand last.
    order = sorted(single, key=lambda x: (single[x] == "", x))
    return "".join(order), "".join(single[x] for x in order), "".join(several), "\0".join(several.values())


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once; keeps deeply composed expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A{SPACE}+|{SPACE}+\\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return js_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def before_first(c: Column, separator: str) -> Column:
    """The text before the first match of a pattern, else the whole; a split would compile the pattern for every row."""
    return F.regexp_replace(c, f"(?:{separator})(?s:.*)\\z", "")


def parted(c: Column, separator: str) -> Column:
    """The texts between the matches of a pattern, split at one sign that stands in for them."""
    marked = F.split(F.regexp_replace(c, separator, "\x01"), "\x01")
    return F.when(F.contains(c, F.lit("\x01")), F.split(c, separator)).otherwise(marked)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def _replaced(c: Column, table: dict[str, str]) -> Column:
    for letter, spelled in table.items():
        c = F.replace(c, text_literal(letter), text_literal(spelled))
    return c


def _jamo(sign: Column) -> Column:
    """A Hangul syllable as lead, vowel and, if any, tail."""
    signs = ["".join(chr(at + k) for k in range(n)) for at, n in zip(JAMO, (19, VOWELS, TAILS), strict=True)]

    def part(k: Column, of: int) -> Column:
        return F.substring(text_literal(signs[of]), k.cast("int") + 1, F.lit(1))

    return bind(F.ascii(sign) - HANGUL, lambda k: F.concat(
        part(F.floor(k / (VOWELS * TAILS)), 0), part(F.floor(k % (VOWELS * TAILS) / TAILS), 1),
        F.when(k % TAILS == 0, F.lit("")).otherwise(part(k % TAILS, 2)),
    ))


def _decomposed(c: Column) -> Column:
    """Compatibility decomposition of text outside ASCII, with marks dropped; the text is evaluated once."""
    letters, bases, several, spelled = decomposition()
    known = F.split(text_literal(spelled), "\0")

    def of_sign(sign: Column) -> Column:
        return bind(F.instr(text_literal(several), sign), lambda at: F.when(at > 0, F.element_at(known, at)).when(
            sign.rlike(HANGUL_SIGNS), _jamo(sign)).otherwise(sign))

    def whole(one: Column) -> Column:
        rare = (F.translate(one, several, "") != one) | one.rlike(HANGUL_SIGNS)
        return F.when(rare, F.array_join(F.transform(F.split(one, ""), of_sign), "")).otherwise(one)

    return bind(F.translate(c, letters, bases), whole)


def unmarked(c: Column) -> Column:
    """Compatibility decomposition with combining marks dropped."""
    return F.when(is_ascii(c), c).otherwise(_decomposed(c))


def combined_lookup(*parts: Column) -> Column:
    """The linkage key: letters, digits and underscores of the joined parts, lower-cased and folded.

    Pure ASCII takes a short path. Parts should be plain columns; anything computed goes through
    ``combined_lookup_of``, which evaluates it once.
    """
    joined = F.concat(*parts) if len(parts) > 1 else parts[0]
    folded = F.lower(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", ""))
    ones = {k: v for k, v in fixed.FOLDED_LETTERS.items() if len(v) == 1}
    folded = F.translate(folded, "".join(ones), "".join(ones.values()))
    folded = _replaced(folded, {k: v for k, v in fixed.FOLDED_LETTERS.items() if len(v) > 1})
    plain = F.lower(F.regexp_replace(joined, "[^A-Za-z0-9_]+", ""))
    return F.when(is_ascii(joined), plain).otherwise(_decomposed(folded))


def combined_lookup_of(*parts: Column) -> Column:
    """``combined_lookup`` of computed text."""
    return bind(F.concat(*parts) if len(parts) > 1 else parts[0], lambda text: combined_lookup(text))


def title_key(c: Column) -> Column:
    """ASCII letters and digits only; letters without a decomposition disappear."""
    return F.regexp_replace(F.lower(unmarked(c)), "[^a-z0-9]+", "")


def loosened(key: Column) -> Column:
    """A title key with ``you`` as ``u`` and no trailing ``anymore``."""
    return F.regexp_replace(F.replace(key, F.lit("you"), F.lit("u")), r"anymore\z", "")


def title_key_loose(c: Column) -> Column:
    return loosened(title_key(c))


def name_key(c: Column) -> Column:
    lowered = F.lower(c)
    folded = F.when(is_ascii(c), lowered).otherwise(_decomposed(lowered))
    return F.regexp_replace(folded, "[^a-z0-9]+", "")


def ascii_key(c: Column) -> Column:
    """Case and punctuation only: accented letters are dropped, not folded."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slugify(c: Column) -> Column:
    """A readable path part; never empty."""
    plain = F.lower(F.regexp_replace(unmarked(c), "[ʻʼˈ‘’＇']", ""))
    plain = F.translate(plain, "ø$", "os")
    plain = F.replace(F.replace(plain, F.lit("æ"), F.lit("ae")), F.lit("&"), F.lit(" and "))
    dashed = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")
    return F.regexp_replace(dashed, r"\A\z", "artist")
