"""Spelling variants: words one edit apart, found by sorting all rotations of terminator-marked words.

The rotations of ``word$`` are sorted. Skip the last sign of a rotation and what is left is a prefix that
the rotations of all words with another sign at that place share, and that is itself a whole rotation of the
word that lacks the sign. So a prefix range holds one word, without the sign, and at most one word for each
sign of the alphabet: groups are bounded by the alphabet however large the vocabulary grows, and a group is
scanned once. A sign that repeats the one before it can be left out in several places to the same word; only
the first place counts for that, so every pair is met exactly once.

Defined results: null text has no words; a null id is the empty text in the checksum; a document that
repeats, repeats its words; a word without near words is its own root; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import written

#: One of so many words of a document loses a sign (fixed value).
SLIP = 199
#: The shortest word, the fewest occurrences, and how much more often a form occurs.
LEAST_SIGNS, LEAST_TIMES, TIMES_MORE = 6, 5, 5
#: Words a task counts before it sends its counts on.
HELD_WORDS = 300_000
MARK = "$"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, one byte per code point (Latin-1)."""
    return (text or "").encode("latin-1", "replace").translate(_LOWER).split(b" ") if text else []


def slipped(word: bytes, doc_id: str) -> bytes:
    """The word, without one sign if the checksum of document and word says so."""
    h = zlib.crc32(f"{doc_id}:{word.decode('latin-1')}".encode())
    return word if h % SLIP else word[: (at := h % len(word))] + word[at + 1 :]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_SIGNS) -> DataFrame:
    """word, n: occurrences over all documents of the words of at least ``least`` code points."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def sent() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})

        for part in parts:
            for doc_id, text in zip(part.id, part.text, strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(runs(text)).items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield sent()
                    total.clear()
        if total:
            yield sent()

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """word, n, head, skipped, first for every rotation of word$ that does not end in the mark's place.

    With a sign skipped, ``head`` is the rotation without it, and ``first`` tells whether no equal sign stands before
    it; without one, ``head`` is the whole rotation.
    """
    size = F.char_length("word")
    at = F.posexplode(F.sequence(F.lit(0), size))
    turned = words.select("word", "n", size.alias("size"), at.alias("at", "_")).drop("_")
    after, before = F.col("word").substr(F.col("at") + 1, F.col("size")), F.col("word").substr(F.lit(1), F.col("at"))
    whole = turned.select("word", "n", F.concat(after, F.lit(MARK), before).alias("head"), F.lit("").alias("skipped"), F.lit(True).alias("first"))
    sign = F.col("word").substr(F.col("at") + 1, F.lit(1))
    cut = turned.where("at < size").select(
        "word", "n", F.concat(F.col("word").substr(F.col("at") + 2, F.col("size")), F.lit(MARK), before).alias("head"), sign.alias("skipped"),
        ((F.col("at") == 0) | (F.col("word").substr(F.col("at"), F.lit(1)) != sign)).alias("first"))
    return whole.unionByName(cut)


def _better(n: Column, word: Column) -> Column:
    """A value that orders by large n, then by small word."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_summary(words: DataFrame) -> DataFrame:
    """word, n_near, best (less = -n, word): the number of near words and the best of them, for words that have any.

    Sorted by head, every group holds the word without a sign and the words with one; each row takes the best
    of the others from the two best with a sign, and the one without.
    """
    found = rotations(words)
    group = Window.partitionBy("head")
    order = group.orderBy(F.col("skipped") == "", F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    signed = F.col("skipped") != ""
    self = F.struct("n", "word")
    scanned = (
        found.withColumn("one", F.first(F.when(signed, self)).over(order))
        .withColumn("two", F.nth_value(F.when(signed, self), 2).over(order))
        .withColumn("bare", F.max(F.when(~signed, self)).over(group))
        .withColumn("n_signed", F.count(F.when(signed, 1)).over(group))
        .withColumn("n_first", F.count(F.when(signed & F.col("first"), 1)).over(group))
        # the best that lacks the sign only counts words whose place is the first of equal signs
        .withColumn("one_first", F.min(F.when(signed & F.col("first"), _better(F.col("n"), F.col("word")))).over(group))
    )
    other = F.when(F.col("one.word") == F.col("word"), F.col("two")).otherwise(F.col("one"))
    swap = F.when(other.isNotNull(), _better(other["n"], other["word"]))
    bare = F.when(F.col("first") & F.col("bare").isNotNull(), _better(F.col("bare.n"), F.col("bare.word")))
    seen = scanned.select(
        "word",
        F.when(signed, F.col("n_signed") - 1 + F.when(F.col("first") & F.col("bare").isNotNull(), 1).otherwise(0)).otherwise(F.col("n_first")).alias("n_near"),
        F.when(signed, F.least(swap, bare)).otherwise(F.col("one_first")).alias("best"))
    return seen.where("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: every word with every word one edit away, one row each."""
    found = rotations(words)
    a, b = found.alias("a"), found.alias("b")
    met = (F.col("a.head") == F.col("b.head")) & (F.col("a.skipped") != F.col("b.skipped"))
    once = ((F.col("a.skipped") != "") & (F.col("b.skipped") != "")) | (F.col("a.first") & F.col("b.first"))
    return a.join(b, met & once).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form with the root added: every form is followed to the last, twice as far each round."""
    now = written(forms.select("word", "form", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        ahead = now.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", "form", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on"))
        now = written(moved, "spelling-roots")
        if now.where("on").isEmpty():
            return now.drop("on")
        now = now.drop("on")


def spelling_forms(words: DataFrame, times_more: int = TIMES_MORE) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of a table word, n (one row per word).

    A word's form is its near word of largest n, ties to the smallest, if that n is ``times_more`` times its own.
    """
    best = words.join(near_summary(words), "word", "left")
    form = -F.col("best.less") >= times_more * F.col("n")
    judged = written(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.word")).alias("form"),
                                 F.when(form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return judged.join(roots(judged).select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The forms of the words of whole texts, over their occurrences in all documents."""
    counted = written(word_counts(docs, id_column, text_column).where(F.col("n") >= LEAST_TIMES), "spelling-words")
    return spelling_forms(counted)
