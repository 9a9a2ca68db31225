"""Exact removal of repeated byte strings through a logarithmic family of sparse suffix arrays.

A string of ``length`` bytes is repeated if it starts anywhere else too. Every such string holds an
anchor: the piece of PIECE bytes with the least hash in it, a choice that depends on those bytes alone,
so equal strings agree on it. Only suffixes at anchors are indexed, about one in length / 2 bytes:

1. anchors are found over whole texts and counted by piece and by their full surroundings, with sums
   before the shuffle (a hot piece is a sum, and its join side is left to the skew join). Unique pieces cannot take part in a match. Anchors whose surroundings occur twice
   are settled: all of it is repeated, and one of them speaks for the rest in the index;
2. the remaining suffixes go to the shard of their piece. A shard takes them in batches, each twice the
   last: a batch gets suffix arrays (to the right of the anchor and to the left), is merge-scanned
   against the levels that share pieces with it, and levels of equal size merge;
3. a piece with more than ``hot_rows`` different surroundings is not held by one shard: its strings are
   counted by hash over the cluster instead, to the same result;
4. settled and scanned reaches are united per text and cut out.

Defined results: null and empty texts have no bytes and no spans; bytes are those of UTF-8, and a cut may
fall inside a letter (kept is binary); repeated rows are each other's repeats; null and repeated ids are
rows like any other; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import written

LENGTH = 400
PIECE = 128
SEGMENT = 1_000_000
FIRST_BATCH = 4_096
#: Shards for each shuffle partition of the session: what a shard indexes stays small beside an executor.
SHARDS_EACH = 4
#: Different surroundings of one piece that a shard holds at most.
HOT_ROWS = 60_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        _powers[:] = tables
    return _powers


class Hashed:
    """Hashes of any slice of a byte buffer, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * up[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _slide(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over values[i : i + width] for every i; beyond the end counts as fill."""
    n = len(values)
    blocks = -(-(n + width) // width)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, Hashed]:
    """Positions and piece hashes of all anchors; ends: for every byte, where its text ends in the buffer."""
    hashed = Hashed(data)
    n = len(data)
    at = np.arange(n)
    h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    h[: max(0, n - piece + 1)] = hashed.slices(at[: n - piece + 1], at[: n - piece + 1] + piece) | np.uint64(1)
    width = length - piece + 1
    least = _slide(h, width, np.minimum, np.iinfo(np.uint64).max)
    least[at + length > ends] = 0
    most = _slide(least[::-1], width, np.maximum, 0)[::-1]
    found = np.flatnonzero((most == h) & (most > 0))
    return found, h[found], hashed


def _anchor_rows(rids: list[int], texts: list[bytes], length: int) -> Iterator[pd.DataFrame]:
    """rid, pos, piece, around for every anchor of the texts."""
    reach = length - PIECE
    some: list[tuple[int, bytes, int, int, int]] = []  # rid, bytes, offset of them, first and last own byte

    def flush() -> pd.DataFrame:
        sizes = np.array([len(x[1]) for x in some])
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join([x[1] for x in some]), np.uint8)
        which = np.repeat(np.arange(len(some)), sizes)
        found, piece, hashed = anchors(data, (begins + sizes)[which], length)
        w = which[found]
        own = found - begins[w]
        lows, highs, offsets = (np.array([x[i] for x in some])[w] for i in (3, 4, 2))
        keep = (own >= lows) & (own < highs)
        found, piece, w, own, offsets = found[keep], piece[keep], w[keep], own[keep], offsets[keep]
        before, after = np.minimum(own, reach), np.minimum(sizes[w] - own, length)
        around = hashed.slices(found - before, found + after) + (before * 1_000 + after).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return pd.DataFrame({
            "rid": np.array([x[0] for x in some])[w], "pos": (own + offsets).astype(np.int32),
            "piece": piece.view(np.int64), "around": around.view(np.int64)})

    total = 0
    for rid, text in zip(rids, texts, strict=True):
        if len(text) < length:
            continue
        for at in range(0, len(text), SEGMENT):
            low, high = max(0, at - 2 * length), min(len(text), at + SEGMENT + 2 * length)
            some.append((rid, text[low:high], low, at - low, min(len(text), at + SEGMENT) - low))
            total += high - low
            if total >= SEGMENT:
                yield flush()
                some, total = [], 0
    if some:
        yield flush()


class Level:
    """Suffixes at anchors, sorted to the right of the anchor and, read backwards, to the left of it."""

    def __init__(self, right: np.ndarray, after: np.ndarray, left: np.ndarray, before: np.ndarray, piece: np.ndarray, row: np.ndarray) -> None:
        order = np.argsort(piece, kind="stable")
        self.right, self.after, self.left, self.before = right[order], after[order], left[order], before[order]
        self.piece, self.row = piece[order], row[order]

    def __len__(self) -> int:
        return len(self.row)

    def only(self, rows: np.ndarray) -> Level:
        return Level(self.right[rows], self.after[rows], self.left[rows], self.before[rows], self.piece[rows], self.row[rows])

    def merged(self, other: Level) -> Level:
        both = zip(self._arrays(), other._arrays(), strict=True)
        return Level(*[np.concatenate(pair) for pair in both])

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.right, self.after, self.left, self.before, self.piece, self.row

    def sharing(self, other: Level) -> Level:
        """The suffixes whose piece the other level has too."""
        return self.only(np.flatnonzero(np.isin(self.piece, other.piece)))


def _sorted_prefixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of fixed-width rows of bytes, and how much each shares with the next one."""
    order = np.argsort(np.ascontiguousarray(text).view(f"S{text.shape[1]}").ravel(), kind="stable")
    return order, _shared(text, order)


def _shared(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(max(0, len(order) - 1), np.int64)
    for at in range(0, len(out), 20_000):
        rows = text[order[at : at + 20_001]]
        differ = rows[1:] != rows[:-1]
        out[at : at + 20_000] = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return out


def _nearest(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    best = np.zeros(len(order), np.int64)
    best[order[1:]] = shared
    best[order[:-1]] = np.maximum(best[order[:-1]], shared)
    return best


def scan(level: Level, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix how far repeated strings through its anchor reach, to the left and to the right.

    A string that begins d bytes before the anchor is repeated if another suffix shares d bytes to the left
    and length - d to the right: both then lie in one run of the left array cut at d and in one run of the
    right array cut at length - d. (-1, 0) where there is none.
    """
    m = len(level)
    reach_left, reach_right = np.full(m, -1), np.zeros(m, np.int64)
    if m < 2:
        return reach_left, reach_right
    ro, rs = _sorted_prefixes(level.right)
    lo, ls = _sorted_prefixes(level.left)
    low = np.maximum(0, length - np.minimum(_nearest(ro, rs), level.after))
    high = np.minimum(_nearest(lo, ls), level.before)
    kept = np.flatnonzero(low <= high)
    if len(kept) < 2:
        return reach_left, reach_right
    if len(kept) < m:
        part = level.only(kept)
        back = {int(r): i for i, r in enumerate(level.row)} if len(np.unique(level.row)) == m else None
        l, r = scan(part, length)
        at = np.array([back[int(x)] for x in part.row])
        reach_left[at], reach_right[at] = l, r
        return reach_left, reach_right
    for ds, done, put in ((range(int(high.max()), -1, -1), reach_left, lambda d: d), (range(int(low.min()), length + 1), reach_right, lambda d: length - d)):
        open_rows = np.ones(m, bool)
        for d in ds:
            rows = np.flatnonzero((low <= d) & (d <= high))
            if len(rows) < 2 or not open_rows[rows].any():
                continue
            right_run, left_run = np.zeros(m, np.int64), np.zeros(m, np.int64)
            right_run[ro[1:]] = np.cumsum(rs < length - d)
            left_run[lo[1:]] = np.cumsum(ls < d)
            key = left_run[rows] * m + right_run[rows]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twin = np.zeros(len(rows), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            hit = rows[twin & open_rows[rows]]
            done[hit] = put(d)
            open_rows[hit] = False
            if not open_rows.any():
                break
    return reach_left, reach_right


class Family:
    """Levels of growing size over the batches seen so far, and the reaches found."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: list[Level] = []
        self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, batch: Level) -> None:
        """Rows of a batch are numbered on from those before."""
        size = int(batch.row.max()) + 1 - len(self.left)
        self.left = np.concatenate([self.left, np.full(size, -1)])
        self.right = np.concatenate([self.right, np.zeros(size, np.int64)])
        self._note(batch)
        for level in self.levels:
            near = level.sharing(batch)
            if len(near):
                self._note(batch.sharing(near).merged(near))
        while self.levels and len(self.levels[-1]) <= len(batch):
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)

    def _note(self, level: Level) -> None:
        left, right = scan(level, self.length)
        self.left[level.row] = np.maximum(self.left[level.row], left)
        self.right[level.row] = np.maximum(self.right[level.row], right)


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def _level(part: pd.DataFrame, first_row: int, length: int) -> Level:
    before = part.before.to_numpy(np.int64)
    around = [bytes(x) for x in part.context]
    left = _matrix([x[:b][::-1] for x, b in zip(around, before, strict=True)], length - PIECE)
    right = _matrix([x[b:] for x, b in zip(around, before, strict=True)], length)
    return Level(right, part.after.to_numpy(np.int64), left, before, part.piece.to_numpy(), first_row + np.arange(len(part)))


def _shard(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    family, rows, waiting, seen = Family(length), [], [], 0
    for part in parts:
        waiting.append(part)
        if sum(map(len, waiting)) >= max(FIRST_BATCH, seen):
            seen = _take(family, waiting, rows, seen, length)
            waiting = []
    if waiting:
        _take(family, waiting, rows, seen, length)
    if rows:
        out = pd.concat(rows, ignore_index=True)
        on = family.left >= 0
        yield pd.DataFrame({"rid": out.rid[on], "start": (out.pos[on] - family.left[on]).astype(np.int32), "stop": (out.pos[on] + family.right[on]).astype(np.int32)})


def _take(family: Family, waiting: list[pd.DataFrame], rows: list, seen: int, length: int) -> int:
    batch = pd.concat(waiting, ignore_index=True)
    family.add(_level(batch, seen, length))
    rows.append(batch[["rid", "pos"]])
    return seen + len(batch)


SUFFIX = "rid bigint, pos int, before int, after int, piece bigint, context binary"
SPAN = "rid bigint, start int, stop int"


def _bucketed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rid, id, packed text in a table bucketed by rid, so that neither later join shuffles the texts again."""
    spark = docs.sparkSession
    name = f"substring_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for part in parts:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.text]
            yield pd.DataFrame({"rid": part.rid, "id": part.id, "packed": [press.compress(x) for x in raw]})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    packed = rows.mapInPandas(pack, "rid bigint, id string, packed binary")
    packed.repartition(buckets, "rid").write.bucketBy(buckets, "rid").saveAsTable(name)
    return spark.table(name)


def _unpacked(packed: pd.Series) -> list[bytes]:
    opened = zstandard.ZstdDecompressor()
    return [opened.decompress(bytes(x)) for x in packed]


def _hot_spans(suffixes: DataFrame, length: int) -> DataFrame:
    """The reaches of suffixes of hot pieces: every string through their anchor is counted by its hash."""

    def strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1_000):
                some = part.iloc[at : at + 1_000]
                data = np.frombuffer(b"".join([bytes(x) for x in some.context]), np.uint8)
                sizes = (some.before + some.after).to_numpy(np.int64)
                begin = np.cumsum(sizes) - sizes
                each = np.maximum(sizes - length + 1, 0)
                row = np.repeat(np.arange(len(some)), each)
                start = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                h = Hashed(data).slices(begin[row] + start, begin[row] + start + length)
                first = some.pos.to_numpy(np.int64)[row] - some.before.to_numpy(np.int64)[row] + start
                yield pd.DataFrame({"rid": some.rid.to_numpy()[row], "pos": some.pos.to_numpy()[row], "start": first.astype(np.int32), "h": h.view(np.int64)})

    found = suffixes.mapInPandas(strings, "rid bigint, pos int, start int, h bigint")
    # One string may be reached through two anchors of its text: places are counted, not rows.
    repeated = found.groupBy("h", "rid", "start").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(repeated, "h").groupBy("rid", "pos").agg(F.min("start").alias("start"), (F.max("start") + length).cast("int").alias("stop")).select("rid", "start", "stop")


def repeated_spans(texts: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rid, start, stop: stretches of repeated strings of a table rid, packed; they may overlap, and stop may lie past the end."""
    reach = length - PIECE

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from _anchor_rows(part.rid.tolist(), _unpacked(part.packed), length)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["rid", "pos", "before", "after", "piece", "context"]
        for part in parts:
            out = []
            for rid, raw, places in zip(part.rid, _unpacked(part.packed), part.places, strict=True):
                for place in places:
                    pos = place["pos"]
                    before, after = min(pos, reach), min(len(raw) - pos, length)
                    out.append((rid, pos, before, after, place["piece"], raw[pos - before : pos + after]))
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    all_anchors = written(texts.select("rid", "packed").mapInPandas(find, "rid bigint, pos int, piece bigint, around bigint"), "anchors")
    # Counts are written before they are joined: only then can a hot piece's side of the join be split.
    twice = written(all_anchors.groupBy("piece").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("piece"), "shared-pieces")
    common = written(all_anchors.join(twice, "piece"), "common-anchors").withColumn("me", F.xxhash64("rid", "pos"))
    kinds = common.groupBy("piece", "around").agg(F.count(F.lit(1)).alias("n"), F.min("me").alias("speaker"))
    pieces = written(kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("different")), "pieces")
    shared = written(
        common.join(kinds.join(pieces, "piece"), ["piece", "around"]).select(
            "rid", "pos", "piece", (F.col("n") > 1).alias("settled"),
            ((F.col("different") > 1) & ((F.col("n") == 1) | (F.col("me") == F.col("speaker")))).alias("indexed"),
            (F.col("different") > hot_rows).alias("hot")), "shared-anchors")
    settled = shared.where("settled").select(
        "rid", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + length).alias("stop"))
    places = shared.where("indexed").groupBy("rid").agg(F.collect_list(F.struct("pos", "piece", "hot")).alias("places"))
    with_text = texts.select("rid", "packed").join(places, "rid")

    def suffixes(hot: bool) -> DataFrame:
        wanted = F.filter("places", lambda p: p["hot"] == hot)
        return with_text.select("rid", "packed", wanted.alias("places")).where(F.size("places") > 0).mapInPandas(cut, SUFFIX)

    shards = SHARDS_EACH * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = suffixes(False).repartition(shards, "piece").mapInPandas(lambda parts: _shard(parts, length), SPAN)
    found = settled.unionByName(scanned)
    if shared.where("indexed AND hot").limit(1).count():
        found = found.unionByName(_hot_spans(suffixes(True), length))
    return found


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document row: id, n_bytes, spans (maximal removed runs), kept (the remaining bytes)."""
    texts = _bucketed(docs, id_column, text_column)
    spans = repeated_spans(texts, length, hot_rows).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(spans, "rid", "left").select("id", "packed", "spans")
    out = joined.mapInPandas(_cut_out, "id string, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_column].dataType))


def _cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sizes, merged, kept = [], [], []
        for raw, spans in zip(_unpacked(part.packed), part.spans, strict=True):
            runs: list[list[int]] = []
            for start, stop in sorted((s["start"], min(s["stop"], len(raw))) for s in spans) if spans is not None else ():
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], stop)
                else:
                    runs.append([start, stop])
            at, rest = 0, []
            for start, stop in runs:
                rest.append(raw[at:start])
                at = stop
            rest.append(raw[at:])
            sizes.append(len(raw))
            merged.append([{"start": a, "stop": b} for a, b in runs])
            kept.append(b"".join(rest))
        yield pd.DataFrame({"id": part.id, "n_bytes": sizes, "spans": merged, "kept": kept})
