"""Plain versions of the operators' semantics and small awkward tables, shared by the tests."""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SF_LABELLED = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, fp string, TEXT2 string, label string"


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    base = "The quick brown fox jumps over the lazy dog and runs away from all of us"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "\n"), None, None), (4, None, "en", None),
        (5, "", None, "b"), (6, " \t\n", "fr", "b"), (None, "orphan text without an id", "en", None), (7, "word " * 30_000, "en", "c"),
        (8, base + " again", "en", "c"), (9, "один два три", "ru", "c"), (10, "!!! ... 123", None, "d"), (11, "a", "en", "d"),
        (12, "<|endoftext|> inside", "en", "d"), (13, "\x00 nul \x1c and   odd", "en", "d"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", t, None) for i, t, lang, s in rows], DOC_SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)


def shingle_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_groups(points: list[int], reach: int = 3) -> list[int]:
    """For each point the smallest place its links reach."""
    root = list(range(len(points)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def repeated_bytes(texts: list[bytes], length: int) -> list[set[int]]:
    seen: dict[bytes, int] = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    return [{p for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1 for p in range(i, i + length)} for t in texts]


def substring_distance(item: str, text: str) -> int:
    above = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != x)))
        above = row
    return min(above)


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similar_groups(texts):
    """For each text the smallest place that links of similarity 0.8 reach, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root
