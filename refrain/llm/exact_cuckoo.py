"""Exact deduplication through a sharded cuckoo-filter index.

Texts are equal when identical after deleting ASCII white space. Each shard of the index keeps a
cuckoo filter over the digests that live in it and the digests themselves in content buckets: a
filter miss is new for certain, a hit is verified in its bucket, deletion takes the digest out of
both, and a filter that overflows is rebuilt at twice the size from the stored keys.

Defined results: null text counts as empty; rows that repeat a doc_id with one text share its
fate; a null doc_id loses every tie; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import written

SLOTS = 4
MAX_KICKS = 200
FIRST_BUCKETS = 64
GROUP = "digest binary, keep_id bigint, keep_chars bigint, group_size bigint"
_MIX = 0x9E3779B97F4A7C15
_ALL = 0xFFFFFFFFFFFFFFFF


class CuckooFilter:
    """16-bit tags, four to a bucket; each tag has two buckets, either found from the other."""

    def __init__(self, buckets: int = FIRST_BUCKETS) -> None:
        self.buckets = buckets
        self.tags = [0] * (buckets * SLOTS)
        self.live = 0

    def _places(self, key: int) -> tuple[int, int, int]:
        tag = (key >> 48) or 1
        first = key & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ ((tag * _MIX & _ALL) >> 32)) & (self.buckets - 1)

    def holds(self, key: int) -> bool:
        tag, one, two = self._places(key)
        tags = self.tags
        return tag in tags[one * SLOTS : one * SLOTS + SLOTS] or tag in tags[two * SLOTS : two * SLOTS + SLOTS]

    def add(self, key: int) -> bool:
        """False when no place was found; the filter must then be rebuilt from the stored keys."""
        tag, one, two = self._places(key)
        for bucket in (one, two):
            if self._put(bucket, tag):
                self.live += 1
                return True
        bucket = two
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (tag + kick) % SLOTS
            tag, self.tags[at] = self.tags[at], tag
            bucket = self._other(bucket, tag)
            if self._put(bucket, tag):
                self.live += 1
                return True
        return False

    def _put(self, bucket: int, tag: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.tags[at]:
                self.tags[at] = tag
                return True
        return False

    def remove(self, key: int) -> bool:
        tag, one, two = self._places(key)
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[at] == tag:
                    self.tags[at] = 0
                    self.live -= 1
                    return True
        return False


class CuckooShard:
    """A filter in front of content buckets: digest -> [keep_id, keep_chars, group_size]."""

    def __init__(self) -> None:
        self.filter = CuckooFilter()
        self.content: dict[int, list[list]] = {}
        self.rebuilds = 0
        self.false_hits = 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def find(self, digest: bytes) -> list | None:
        key = self.key(digest)
        if not self.filter.holds(key):
            return None
        for entry in self.content.get(key, ()):
            if entry[0] == digest:
                return entry
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, keep_id: int | None, keep_chars: int, group_size: int) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[3] += group_size
            if _stays(keep_chars, keep_id, entry[2], entry[1]):
                entry[1], entry[2] = keep_id, keep_chars
            return
        key = self.key(digest)
        self.content.setdefault(key, []).append([digest, keep_id, keep_chars, group_size])
        if not self.filter.add(key):
            self._rebuild()

    def delete(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        key = self.key(digest)
        rest = [e for e in self.content[key] if e[0] != digest]
        if rest:
            self.content[key] = rest
        else:
            del self.content[key]
        self.filter.remove(key)
        return True

    def _rebuild(self) -> None:
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            self.rebuilds += 1
            if all(self.filter.add(key) for key, entries in self.content.items() for _ in entries):
                return

    def frame(self) -> pd.DataFrame:
        rows = [entry for entries in self.content.values() for entry in entries]
        out = pd.DataFrame(rows, columns=["digest", "keep_id", "keep_chars", "group_size"])
        return out.astype({"keep_id": "Int64", "keep_chars": "int64", "group_size": "int64"})


def _stays(chars: int, doc_id: int | None, other_chars: int, other_id: int | None) -> bool:
    if chars != other_chars:
        return chars > other_chars
    if doc_id is None or other_id is None:
        return other_id is None and doc_id is not None
    return doc_id < other_id


def _ids(values: pd.Series) -> list:
    """Whole ids without a detour over floats; missing ones as None."""
    return [None if pd.isna(x) else int(x) for x in values]


def _absorb(shard: CuckooShard, part: pd.DataFrame) -> None:
    for row in zip(part.digest, _ids(part.keep_id), part.keep_chars, part.group_size, strict=True):
        shard.insert(bytes(row[0]), row[1], int(row[2]), int(row[3]))


def _merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shard = CuckooShard()
    for part in parts:
        _absorb(shard, part)
    yield shard.frame()


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, n_chars of the original text, digest of the text without white space."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        digest(text).alias("digest"),
    )


def groups(narrow: DataFrame) -> DataFrame:
    """The distinct texts with the row that stays and the number of rows.

    Each input partition first folds its own rows in a shard of its own, so a text that holds a third
    of all rows sends on one row per partition; the folded rows then meet in the shard of their digest.
    """
    own = narrow.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"),
                        F.lit(1).cast("bigint").alias("group_size"))
    return own.mapInPandas(_merge, GROUP).repartition("digest").mapInPandas(_merge, GROUP)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, n_chars, keep_id, group_size, kept."""
    narrow = written(digests(docs, id_column, text_column), "exact-digests")
    return narrow.join(groups(narrow), "digest", "left").select(
        "doc_id", "digest", "n_chars", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
    )


def insert_batch(index: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index (rows of GROUP) after a batch of documents: new digests enter, known ones grow and keep the best row."""
    fresh = digests(docs, id_column, text_column).select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("n_chars").alias("keep_chars"), F.lit(1).cast("bigint").alias("group_size"))
    return index.unionByName(fresh.mapInPandas(_merge, GROUP)).repartition("digest").mapInPandas(_merge, GROUP)


def delete_digests(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the digests of ``gone`` (column digest); unknown ones are ignored."""
    parts = index.select("*", F.lit(False).alias("gone")).unionByName(
        gone.select("digest", F.lit(None).cast("bigint").alias("keep_id"), F.lit(0).cast("bigint").alias("keep_chars"),
                    F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("gone")))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, out = CuckooShard(), []
        for part in batches:
            _absorb(shard, part[~part.gone])
            out += [bytes(x) for x in part.digest[part.gone]]
        for digest in out:
            shard.delete(digest)
        yield shard.frame()

    return parts.repartition("digest").mapInPandas(apply, GROUP)
