"""Document fingerprints of improbable features: rare byte windows in chained Bloom filters.

A feature is a window of 32 bytes. Its class is its entropy in thousandths, and classes are rare or common
by how many windows of all documents fall into them. In every run of 64 neighbouring windows the one of the
rarest class (the leftmost of several) gets a vote; windows with 16 votes or more are selected, in order, and
set five bits each in a filter of 2,048. A filter takes 160 features, then the next of the chain begins.
Two fingerprints are as alike as the bits that their filters share beyond chance, over the most they could:
each filter of the shorter chain takes its best partner in the other, and the mean is the likeness.

Runs of nearly one byte (entropy below a tenth) are never selected. A text of fewer bytes than a window, or
of such runs only, has itself, whole, as its one feature, so every text but the empty one has features.

Defined results: null text is empty; the empty text has the empty fingerprint, which is like itself (1) and
nothing else (0); documents go by doc_id, null first, equal ids by text hash, then by their place in the
scan; the document after the last is the first, so a single document follows itself; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 32
RUN = 64
VOTES = 16
CLASSES = 1001
#: Windows of a lower class are never selected.
LEAST_CLASS = 100
BITS, BITS_PER_FEATURE, FEATURES = 2048, 5, 160
#: Standard deviations of chance overlap that do not count as likeness.
CHANCE = 3.0
#: Bytes looked at together, and bytes of texts fingerprinted together.
SEGMENT, CHUNK = 1 << 18, 1 << 20
#: Documents that a task goes through in order, about, the most parts (then they are longer, not more), and keys
#: looked at for each border between parts.
PART_ROWS, MOST_PARTS, KEYS_PER_BORDER = 8_000, 40_000, 20

_SCALE = 1 << 20
_COUNTS = np.arange(WINDOW + 2, dtype=np.float64)
_ENTROPY_PART = np.rint(np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0) * _SCALE).astype(np.int32)
_STEP = np.diff(_ENTROPY_PART)
_FULL = int(_ENTROPY_PART[WINDOW])
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def window_classes(data: np.ndarray) -> np.ndarray:
    """The entropy class of the window that starts at each byte, by sliding: one byte goes, one comes."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    total = np.empty(n, np.int32)
    total[0] = int(_ENTROPY_PART[np.bincount(data[:WINDOW], minlength=256)].sum())
    total[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]]
    np.cumsum(total, out=total)
    return ((_FULL - total).astype(np.int64) * (CLASSES - 1) // _FULL).astype(np.int16)


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of the texts with room between them, and where each starts and how long it is."""
    gap = bytes(WINDOW + RUN)
    size = np.array([len(r) for r in raws], np.int64)
    start = len(gap) + np.cumsum(size + len(gap)) - size - len(gap)
    return np.frombuffer(gap + b"".join(x for r in raws for x in (r, gap)), np.uint8), start, size


def _inside(length: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the window from each byte lies in one text."""
    edge = np.zeros(length + 1, np.int8)
    some = size >= WINDOW
    edge[start[some]] = 1
    edge[(start + size - WINDOW + 1)[some]] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(np.bool_)


def class_counts(raws: list[bytes]) -> np.ndarray:
    """Windows of the texts by class."""
    data, start, size = _joined(raws)
    inside, out = _inside(len(data), start, size), np.zeros(CLASSES, np.int64)
    for a in range(0, len(data) - WINDOW + 1, SEGMENT):
        classes = window_classes(data[a : a + SEGMENT + WINDOW - 1])
        out += np.bincount(classes[inside[a : a + len(classes)]], minlength=CLASSES)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of every class, the rarest first (equal counts: the lower class); CLASSES for classes never selected."""
    rank = np.empty(CLASSES, np.int32)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    rank[:LEAST_CLASS] = CLASSES
    return rank


def selected(data: np.ndarray, inside: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the windows with enough votes, over runs that begin up to RUN - 1 bytes before a text."""
    votes = np.zeros(len(data), np.uint8)
    shift = (SEGMENT + RUN).bit_length()
    for a in range(0, len(data) - WINDOW - RUN + 2, SEGMENT):
        classes = window_classes(data[a : a + SEGMENT + WINDOW + RUN - 2])
        worth = np.where(inside[a : a + len(classes)], rank[classes], CLASSES).astype(np.int32)
        best = (worth << np.int32(shift)) | np.arange(len(worth), dtype=np.int32)
        width = 1
        while width < RUN:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[best >> np.int32(shift) < CLASSES] & np.int32((1 << shift) - 1)
        votes[a : a + len(worth)] += np.bincount(best, minlength=len(worth)).astype(np.uint8)
    return np.flatnonzero(votes >= VOTES)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _feature_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lanes = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    h = np.full(len(at), _MIX[0])
    for k in range(0, WINDOW, 8):
        h = _mixed(h * np.uint64(3) + _MIX[0] + lanes[at + k])
    return h


def filters(raws: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, as rows of 32 words; an empty text has no row."""
    data, start, size = _joined(raws)
    at = selected(data, _inside(len(data), start, size), rank)
    text = np.searchsorted(start, at, "right") - 1
    hashes = _feature_hashes(data, at)
    bare = np.flatnonzero((np.bincount(text, minlength=len(raws)) == 0) & (size > 0))
    if len(bare):
        whole = [int.from_bytes(hashlib.blake2b(raws[k], digest_size=8).digest(), "little") for k in bare]
        text, hashes = np.concatenate([text, bare]), np.concatenate([hashes, np.array(whole, np.uint64)])
        order = np.argsort(text, kind="stable")
        text, hashes = text[order], hashes[order]
    held = np.bincount(text, minlength=len(raws))
    chain = -(-held // FEATURES)
    first = np.cumsum(chain) - chain
    row = first[text] + (np.arange(len(text)) - (np.cumsum(held) - held)[text]) // FEATURES
    ones = np.zeros((int(chain.sum()), BITS), np.uint8)
    for k in range(BITS_PER_FEATURE):
        ones[row, ((hashes >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    words = np.packbits(ones, axis=1, bitorder="little").view("<u8")
    return [words[a : a + n] for a, n in zip(first.tolist(), chain.tolist(), strict=True)]


def fingerprint_text(chain: np.ndarray) -> str:
    return ".".join(base64.b64encode(f.tobytes()).decode() for f in chain)


def chain_of(text: str) -> np.ndarray:
    """The filters that a fingerprint text holds."""
    raw = b"".join(base64.b64decode(x) for x in text.split(".")) if text else b""
    return np.frombuffer(raw, "<u8").reshape(-1, BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 (no more bits in common than by chance) to 1 (all of the smaller's) of two chains of filters."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = (np.bitwise_count(x).sum(axis=1).astype(np.float64) for x in (a, b))
    total = 0.0
    step = max(1, 1_000_000 // (len(b) * (BITS // 64)))
    for s in range(0, len(a), step):
        both = np.bitwise_count(a[s : s + step, None] & b[None]).sum(axis=2, dtype=np.int64)
        n, m = na[s : s + step, None], nb[None]
        by_chance = n * m / BITS
        floor = by_chance + CHANCE * np.sqrt(by_chance * (1 - n / BITS) * (1 - m / BITS))
        most = np.minimum(n, m)
        score = np.where(both == most, np.where(both > floor, 1.0, 0.0), (both - floor) / np.maximum(most - floor, 1e-9))
        total += float(np.clip(score, 0, 1).max(axis=1).sum())
    return 1.0 if len(a) == len(b) and np.array_equal(a, b) else total / len(a)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _in_chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for k, raw in enumerate(raws):
        held += len(raw) + WINDOW + RUN
        if held >= CHUNK:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(raws):
        yield begin, len(raws)


def corpus_rarity(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Ranks of the classes by their windows in all documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES, np.int64)
        for part in parts:
            raws = [_raw(t) for t in part["text"]]
            for a, b in _in_chunks(raws):
                total += class_counts(raws[a:b])
        if total.any():
            yield pd.DataFrame({"entropy": np.flatnonzero(total), "n": total[total > 0]})

    counted = docs.select(F.col(text_column).alias("text")).mapInPandas(run, "entropy int, n bigint").groupBy("entropy").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES, np.int64)
    for row in counted.collect():  # at most CLASSES rows
        counts[row["entropy"]] = row["n"]
    return rarity(counts)


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- every document with the one after it ------------------------------------------------------------------------------


def _order_bytes(ids: pd.Series, tie: pd.Series, place: pd.Series) -> np.ndarray:
    """Keys that compare as (id, null first; tie; place) do."""
    out = np.zeros((len(ids), 25), np.uint8)
    out[:, 0] = ids.notna()
    top = np.uint64(1 << 63)
    for k, values in enumerate((ids.fillna(0), tie, place)):
        out[:, 1 + 8 * k : 9 + 8 * k] = (values.to_numpy(np.int64).view(np.uint64) ^ top).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S25").ravel()


def _ordered_parts(rows: DataFrame, part_rows: int) -> tuple[Column, int]:
    """The part of every row: ranges of (id, tie, place), and their number. Only a few keys per border are collected."""
    count = rows.count()
    parts = max(1, min(MOST_PARTS, -(-count // part_rows)))
    share = min(1.0, 1.25 * parts * KEYS_PER_BORDER / max(1, count))
    keys = rows.select("id", "tie", "place").where(F.rand(7) < share).toPandas() if parts > 1 else None
    if keys is None or not len(keys):
        return F.lit(0), 1
    sorted_keys = np.sort(_order_bytes(keys["id"], keys["tie"], keys["place"]))
    borders = np.unique(sorted_keys[np.linspace(0, len(sorted_keys), parts + 1).astype(int)[1:-1]])

    @F.pandas_udf("int")
    def part(ids: pd.Series, tie: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, _order_bytes(ids, tie, place), "right"))

    return part("id", "tie", "place"), len(borders) + 1


def with_following(docs: DataFrame, id_column: str, text_column: str, part_rows: int = PART_ROWS) -> DataFrame:
    """part, id, tie, place, text, guest in parts to be gone through in order.

    Every part ends with the first row of the part after it (the last with the very first) as a guest, so each
    row finds the one after it in its own part, and texts are dealt out once.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    part, number = _ordered_parts(rows, part_rows)
    dealt = rows.withColumn("part", part)
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie", "place")
    heads = sorted((r["part"], *r["head"]) for r in dealt.groupBy("part").agg(F.min(order).alias("head")).collect())  # one row per part
    before = [(heads[k - 1][0], *heads[k][2:]) for k in range(len(heads))]
    guests = spark.createDataFrame(before, "to int, id bigint, tie bigint, place bigint")
    same = F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.tie") == F.col("g.tie")) & (F.col("r.place") == F.col("g.place"))
    # One small row per part, at most MOST_PARTS: sent to the texts, which stay where they are.
    visiting = rows.alias("r").join(F.broadcast(guests).alias("g"), same).select(F.col("to").alias("part"), "r.id", "r.tie", "r.place", "r.text", F.lit(True).alias("guest"))
    own = dealt.select("part", "id", "tie", "place", "text", F.lit(False).alias("guest"))
    return own.unionByName(visiting).repartitionById(number, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("id"), "tie", "place")


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


COLUMNS = [c.split(" ")[0] for c in RESULT.split(", ")]


def fingerprint_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and what its own is like."""
    rank = corpus_rarity(docs, text_column)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last row seen: part, id, text, chain, guest
        for rows in parts:
            texts, out = rows["text"].tolist(), []
            raws = [_raw(t) for t in texts]
            ids = [None if pd.isna(x) else int(x) for x in rows["id"]]
            for a, b in _in_chunks(raws):
                chains = filters(raws[a:b], rank)
                seen = [*([waiting] if waiting else []), *zip(rows["part"].tolist()[a:b], ids[a:b], texts[a:b], chains, rows["guest"].tolist()[a:b], strict=True)]
                waiting = seen[-1]
                met = [(x, y) for x, y in zip(seen, seen[1:], strict=False) if not x[4] and x[0] == y[0]]
                changed = [_raw(edited(x[2], y[2])) for x, y in met]
                for (x, y), raw, chain in zip(met, changed, filters(changed, rank) if changed else [], strict=True):
                    out.append((x[1], len(x[2]), hashlib.sha256(raw).hexdigest(), fingerprint_text(x[3]), fingerprint_text(chain),
                                likeness(x[3], chain), likeness(x[3], y[3])))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})

    return with_following(docs, id_column, text_column, part_rows).mapInPandas(run, RESULT)
