"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to ``budget`` edits. Cut into budget + 1 pieces, at least one piece
of any such occurrence is unchanged: pieces are searched exactly (one automaton per task), and each
hit is verified with Myers' bit-parallel distance around the place the piece points to.

Items and texts are compared in lower case with runs of white space as one blank. Defined results:
null or blank items and texts match nothing; repeated items are found under each of their ids;
overlapping and repeated occurrences give one row per document row and item, the nearest (then
leftmost) one; rows with a null id match like any other; an empty table on either side gives no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One edit is allowed per so many characters of an item.
CHARS_PER_EDIT = 20
#: Characters of items searched in one pass over the documents; a larger benchmark takes more passes.
PASS_CHARS = 16_000_000
MATCH = "doc_id string, item_id string, distance int, start bigint, stop bigint"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return len(item) // CHARS_PER_EDIT


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.edits = budget(item)
        masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            masks[c] |= 1 << i
        self.masks = dict(masks)

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the item to a stretch of the text that may begin anywhere, and its first end."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        least, end, get = self.size, 0, self.masks.get
        for i, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1, down << 1
            plus = (down | ~(diagonal | up)) & full
            minus = up & diagonal & full
            if score < least:
                least, end = score, i
        return least, end


class Searcher:
    """Every piece of every item in one automaton."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        by_text: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            if text:
                by_text[text].append(item_id)
        self.texts = list(by_text)
        self.ids = [by_text[t] for t in self.texts]
        self.patterns = [Pattern(t) for t in self.texts]
        where: dict[str, list] = defaultdict(list)
        for k, text in enumerate(self.texts):
            for at, piece in pieces(text, self.patterns[k].edits):
                where[piece].append((k, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, stop) of the best occurrence of each item within its budget."""
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for last, places in self.automaton.iter(text):
            for k, end in places:
                begins[k].add(last + 1 - end)
        out = []
        for k, starts in begins.items():
            pattern, item = self.patterns[k], self.texts[k]
            exact = text.find(item)
            if exact >= 0:
                out.append((k, 0, exact, exact + pattern.size))
                continue
            best, edits = None, pattern.edits
            if not edits:
                continue
            for low, high in _stretches(sorted(starts), pattern.size, edits, len(text)):
                distance, end = pattern.best(text[low:high])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best is not None:
                stop = best[1]
                low = max(0, stop - pattern.size - edits)
                back, taken = Pattern(item[::-1]).best(text[low:stop][::-1])
                out.append((k, best[0], stop - taken if back == best[0] else low, stop))
        return out


def _stretches(starts: list[int], size: int, edits: int, length: int) -> list[tuple[int, int]]:
    """Where an occurrence can lie, overlapping stretches joined."""
    out: list[list[int]] = []
    for start in starts:
        low, high = max(0, start - edits), min(length, start + size + edits)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


_searchers: dict[str, Searcher] = {}


def _searcher(key: str, items: list) -> Searcher:
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(items)
    return _searchers[key]


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          item_column: str = "item_id", item_text: str = "text", pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, start, stop.

    start and stop are offsets in the document in its compared form. Item texts go to the tasks in
    passes of at most about ``pass_chars`` characters each, whatever the size of the benchmark; a
    single longer item makes a pass of its own.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.length(F.trim(item_text)) > 0).select(
        F.col(item_column).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, int(np.ceil(2 * chars / pass_chars))) if chars > pass_chars else 1
    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text")).where("text is not null")
    found = None
    for n in range(passes):
        some = items if passes == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == n)
        sent = spark.sparkContext.broadcast([(r["item_id"], plain(r["text"])) for r in some.collect()])

        def run(parts: Iterator[pd.DataFrame], sent=sent, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            searcher = _searcher(key, sent.value)
            for part in parts:
                out = []
                for doc_id, text in zip(part.doc_id, part.text, strict=True):
                    for k, distance, start, stop in searcher.find(plain(text)):
                        out += [(doc_id, item_id, distance, start, stop) for item_id in searcher.ids[k]]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "start", "stop"])

        one = rows.mapInPandas(run, MATCH)
        found = one if found is None else found.unionByName(one)
    return found.withColumns({"doc_id": F.col("doc_id").cast(docs.schema[id_column].dataType),
                              "item_id": F.col("item_id").cast(benchmark.schema[item_column].dataType)})
