"""SimHash near-duplicates, joined exactly through vantage-point trees.

A vantage point splits fingerprints into those nearer than a radius and the rest. Two fingerprints
within ``reach`` bits that fall on different sides must both lie within ``reach`` of the radius, so
only those near the border visit the other side; every other branch is pruned by the triangle bound.
A tree of few points deals fingerprints out to shards, and each shard goes on splitting by itself
until its parts are small enough to compare directly. A shard sends on a star per group it found,
never pairs.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any
other; null ids never name a component (a component of null ids only has a null one); repeated rows
are rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import written
from refrain.llm.links import components

SEED = 42
REACH = 3
#: Fingerprints that one shard holds as its own, about.
SHARD_ROWS = 24_000
#: Fingerprints looked at on the driver to place the vantage points; only their balance depends on it.
PLACING_ROWS = 4_096
LEAF_ROWS = 192
CHUNK_BYTES = 2_000_000
CHUNK_SHINGLES = 150_000

# XXH64's constants (fixed values).
P1, P2, P3 = np.uint64(11400714785074694791), np.uint64(14029467366897019727), np.uint64(1609587929392839161)
P4, P5 = np.uint64(9650029242287828579), np.uint64(2870177450012600261)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of one byte buffer; the buffer must reach 8 bytes beyond the last slice."""
    lanes = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    quads = np.lib.stride_tricks.as_strided(data[:4].view("<u4"), (len(data) - 3,), (1,))
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    at = start.copy()
    left = size.copy()
    while True:
        on = np.flatnonzero((left >= 8) & (size < 32))
        if not len(on):
            break
        lane = _turn(lanes[at[on]] * P2, 31) * P1
        h[on] = _turn(h[on] ^ lane, 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero((left >= 4) & (size < 32))
    h[on] = _turn(h[on] ^ (quads[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero((left >= 1) & (size < 32))
        h[on] = _turn(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = data.tobytes()
        one = xxhash.xxh64_intdigest
        h[long] = [one(raw[s : s + n], seed) for s, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    return h


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    out = np.zeros(len(texts), np.uint64)
    some, sizes, rows, total = [], [], [], 0

    def flush() -> None:
        if some:
            out[rows] = _chunk(some, np.array(sizes), width)
        some.clear(), sizes.clear(), rows.clear()

    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        some.append(joined), sizes.append(len(words)), rows.append(row)
        total += len(joined)
        if total >= CHUNK_BYTES:
            flush()
            total = 0
    flush()
    return out


def _placed(texts: list[bytes], words: np.ndarray, width: int) -> tuple:
    """One buffer of the texts, the shingles of each, and of every shingle the text, where it starts and how long it is."""
    data = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    stops = np.flatnonzero(data == 32)[: int(words.sum())]
    starts = np.concatenate([[0], stops[:-1] + 1])
    shingles = np.maximum(words - width + 1, 1)
    doc = np.repeat(np.arange(len(texts)), shingles)
    first = np.arange(len(doc)) + np.repeat(np.cumsum(words) - words - (np.cumsum(shingles) - shingles), shingles)
    last = first + np.minimum(words, width)[doc] - 1
    return data, shingles, doc, starts[first], stops[last] - starts[first]


def shingle_hashes(texts: list[str | None], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The text's place and the hash of every shingle of every text; a text without words has one, the empty one."""
    words = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    some = [k for k, w in enumerate(words) if w]
    blank = np.array([k for k, w in enumerate(words) if not w], np.int64)
    none = np.full(len(blank), xxhash.xxh64_intdigest(b"", SEED), np.uint64)
    if not some:
        return blank, none
    data, _, doc, start, size = _placed([b" ".join(words[k]) for k in some], np.array([len(words[k]) for k in some]), width)
    return np.concatenate([np.array(some)[doc], blank]), np.concatenate([xxh64_slices(data, start, size), none])


def _chunk(texts: list[bytes], words: np.ndarray, width: int) -> np.ndarray:
    data, shingles, doc, start, size = _placed(texts, words, width)
    ones = np.zeros((len(texts), 64), np.int64)
    for at in range(0, len(doc), CHUNK_SHINGLES):
        f, t, d = start[at : at + CHUNK_SHINGLES], size[at : at + CHUNK_SHINGLES], doc[at : at + CHUNK_SHINGLES]
        _add_bits(ones, d, xxh64_slices(data, f, t))
    return _majority(ones, shingles)


def _add_bits(ones: np.ndarray, doc: np.ndarray, h: np.ndarray) -> None:
    """Counts the bits of the hashes, in order of their texts, to the rows of those."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ones[doc[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)


def _majority(ones: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    set_bits = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def set_fingerprints(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprints of sets of shingles, from their hashes in order of their texts and the number of each text."""
    ones = np.zeros((len(size), 64), np.int64)
    for at in range(0, len(doc), CHUNK_SHINGLES):
        _add_bits(ones, doc[at : at + CHUNK_SHINGLES], h[at : at + CHUNK_SHINGLES])
    return _majority(ones, size)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; a point is one word, or a row of several."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int16) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int16)


def _vantage(points: np.ndarray, reach: int | np.ndarray = REACH) -> tuple[np.ndarray, int] | None:
    """The point, of a few tried, whose distances spread most, and the radius that halves them."""
    best = None
    for point in points[:: max(1, len(points) // 12)][:12]:
        d = distance(points, point)
        radius = int(np.median(d))
        near = int((d < radius).sum())
        if near == 0 or near == len(points):
            continue
        border = int((np.abs(d - radius) <= reach).sum()) + abs(len(points) - 2 * near) // 2
        if best is None or border < best[0]:
            best = (border, point, radius)
    return None if best is None else (best[1], best[2])


def plan_tree(sample: np.ndarray, depth: int) -> list | None:
    """A nested [point, radius, near, far] of at most ``depth`` levels; None is a shard."""
    if depth <= 0 or len(sample) < 8 or (found := _vantage(sample)) is None:
        return None
    point, radius = found
    d = distance(sample, point)
    return [point, radius, plan_tree(sample[d < radius], depth - 1), plan_tree(sample[d >= radius], depth - 1)]


def _sides(points: np.ndarray, guest: np.ndarray, point: np.ndarray, radius: int, reach: int | np.ndarray) -> tuple:
    """Rows for the near and the far side, with who is a guest there.

    Own rows live on one side. Of two own rows parted here the nearer one visits the far side; guests
    visit every side that can hold a partner. Where each row has a reach of its own, two rows are partners
    that lie within the reach of both.
    """
    d = distance(points, point)
    near = (d < radius + reach) & guest | (d < radius) & ~guest
    far = d >= radius - reach
    return (np.flatnonzero(near), guest[near]), (np.flatnonzero(far), guest[far] | (d[far] < radius))


def _of(reach: int | np.ndarray, rows: np.ndarray) -> int | np.ndarray:
    return reach[rows] if isinstance(reach, np.ndarray) else reach


def deal(points: np.ndarray, tree: list | None, reach: int | np.ndarray = REACH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, guests) for every shard that some of the points live in or visit."""
    work = [(tree, 1, np.arange(len(points)), np.zeros(len(points), bool))]
    while work:
        node, shard, rows, guest = work.pop()
        if not len(rows):
            continue
        if node is None:
            yield shard, rows, guest
            continue
        for child, k, (kept, visiting) in zip(node[2:], (0, 1), _sides(points[rows], guest, node[0], node[1], _of(reach, rows)), strict=True):
            work.append((child, 2 * shard + k, rows[kept], visiting))


class Joined:
    """Groups found so far, as the smallest row number of each."""

    def __init__(self, size: int) -> None:
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                flat = self.root[self.root]
                if np.array_equal(flat, self.root):
                    break
                self.root = flat


def shard_links(points: np.ndarray, guest: np.ndarray, reach: int | np.ndarray = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of a shard within reach of each other, each a an own row, some at a time."""
    cells = 4_000_000 // (1 if points.ndim == 1 else points.shape[1])
    work = [(np.arange(len(points)), guest)]
    while work:
        rows, visiting = work.pop()
        own = rows[~visiting]
        if not len(own):
            continue
        found = None if len(own) <= LEAF_ROWS else _vantage(points[own], _of(reach, own))
        if found is None:
            step = max(1, cells // len(rows))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                apart = np.bitwise_count(points[some][:, None] ^ points[rows][None, :])
                if apart.ndim == 3:
                    apart = apart.sum(axis=2, dtype=np.int16)
                within = reach if np.ndim(reach) == 0 else np.minimum(reach[some][:, None], reach[rows][None, :])
                a, b = np.nonzero(apart <= within)
                yield some[a], rows[b]
            continue
        for kept, seen in _sides(points[rows], visiting, *found, _of(reach, rows)):
            work.append((rows[kept], seen))


def shard_groups(points: np.ndarray, guest: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The group (smallest row number) of each point of a shard, over all links with at least one own row."""
    groups = Joined(len(points))
    for a, b in shard_links(points, guest, reach):
        groups.link(a, b)
    return groups.root


def _signed(points: np.ndarray) -> np.ndarray:
    return points.view(np.int64)


def fingerprint_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "fp": _signed(fingerprints(part.text.tolist()))})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, "doc_id string, fp bigint").select(F.col("doc_id").cast("bigint").alias("doc_id"), "fp")


def near_links(distinct: DataFrame, reach: int = REACH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) that join exactly those within reach of each other.

    They span the same groups as all pairs would, with at most one link per fingerprint and shard.
    """
    n = distinct.count()
    depth = int(np.ceil(np.log2(max(1, n / shard_rows))))
    placing = distinct.orderBy(F.xxhash64("fp")).limit(PLACING_ROWS).collect() if depth else []
    tree = plan_tree(np.array(sorted(r["fp"] for r in placing), np.int64).view(np.uint64), depth)

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            points = part.fp.to_numpy().view(np.uint64)
            for shard, rows, guest in deal(points, tree, reach):
                yield pd.DataFrame({"shard": shard, "fp": _signed(points[rows]), "guest": guest})

    def stars(part: pd.DataFrame) -> pd.DataFrame:
        points = part.fp.to_numpy()
        root = shard_groups(points.view(np.uint64), part.guest.to_numpy(), reach)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": points[linked], "v": points[root[linked]]})

    dealt = distinct.select("fp").mapInPandas(visits, "shard bigint, fp bigint, guest boolean")
    return dealt.groupBy("shard").applyInPandas(stars, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id its links reach)."""
    narrow = written(fingerprint_table(docs, id_column, text_column), "fingerprints")
    distinct = written(narrow.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(near_links(distinct, reach)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return narrow.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
