"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Conversations become sequences of turn keys; equal sequences are one row with a count. The rows are
sorted in shards and a shard is written as balanced parentheses, one pair per node. Blocks with the
least excess of each, under a tree of minima, answer where a node closes; between a node's two signs
lies its subtree, so the rank of leaf pairs "()" counts its leaves, and cumulative arrays in the order
of opening give its members and savings.

Only nodes on the paths of a shard's first and last sequence can go on in another shard. These spines
are merged by node: counts add up, and what hangs off a spine is carried to the nodes above by doubling
the distance, in as many rounds as the depth has binary digits.

Defined results: null role or text is empty; turns go by turn, null first, ties by the digest of role
and text; rows without conv_id belong to no conversation; an empty table has no root and gives no rows.
A task holds the turn keys (20 bytes a turn) of one conversation at a time, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import written

KEY_BYTES = 16
#: Turns that a shard holds, about.
SHARD_TURNS = 200_000
#: The ids that share a first part, and the most turns shared and one more.
GROUP, HEADS = 100, 6
#: Members whose ids are joined before they are hashed in order.
PIECE = 4_096
BLOCK = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "node binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, length bigint, ends string, spine boolean"


class Parentheses:
    """A balanced sequence of signs (1 opens, 0 closes) with a tree of least excesses over its blocks."""

    def __init__(self, signs: np.ndarray) -> None:
        self.excess = np.cumsum(signs.astype(np.int64) * 2 - 1)
        self.leaves = 1 << (max(1, -(-len(signs) // BLOCK)) - 1).bit_length()
        self.padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        self.padded[: len(signs)] = self.excess
        levels = [self.padded.reshape(self.leaves, BLOCK).min(axis=1)]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).min(axis=1))
        #: The minimum over node k's blocks; 1 is the top, 2k and 2k + 1 lie below k.
        self.least = np.concatenate([[0], *levels])

    def _scan(self, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from at to the end of its block whose excess is goal, else -1."""
        found = np.full(len(at), -1)
        rows = np.flatnonzero(at % BLOCK >= 0)
        at = at.copy()
        while len(rows):
            hit = self.padded[at[rows]] == goal[rows]
            found[rows[hit]] = at[rows[hit]]
            at[rows] += 1
            rows = rows[~hit & (at[rows] % BLOCK != 0)]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """Where the pairs that open at these places close."""
        goal = self.excess[opens] - 1
        start = opens + 1
        close = np.where(start % BLOCK != 0, self._scan(np.minimum(start, len(self.padded) - 1), goal), -1)
        rows = np.flatnonzero(close < 0)
        # Up until a right neighbour reaches the goal, down to its first block that does.
        node, wanted = self.leaves + opens[rows] // BLOCK, goal[rows]
        climbing = np.ones(len(rows), bool)
        while climbing.any():
            right = (node & 1) == 0
            reached = climbing & right & (self.least[np.minimum(node + 1, len(self.least) - 1)] <= wanted)
            node = np.where(reached, node + 1, np.where(climbing, node >> 1, node))
            climbing &= ~reached
        while (above := node < self.leaves).any():
            left = self.least[np.where(above, 2 * node, 0)] <= wanted
            node = np.where(above, 2 * node + ~left, node)
        close[rows] = self._scan((node - self.leaves) * BLOCK, wanted)
        return close


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for many ranges, by tables of doubling width."""
    size = stop - start
    level = np.frexp(size.astype(np.float64))[1] - 1
    out, table = np.empty(len(start), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        rows = level == k
        out[rows] = np.minimum(table[start[rows]], table[stop[rows] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _path_keys(keys: list[bytes], most: int | None = None) -> list[bytes]:
    """The key of every prefix of a sequence, from the empty one."""
    state, out = hashlib.sha256(), []
    for key in keys[:most]:
        out.append(state.copy().digest()[:KEY_BYTES])
        state.update(key)
    return [*out, state.digest()[:KEY_BYTES]]


def shard_nodes(part: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard: sorted distinct sequences with keys, lens, n, least and ends.

    Of a spine node n_children, n_leaves and saved_tokens only count what hangs off it, without nodes of spines.
    """
    sequences = [list(k) for k in part["keys"]]
    sizes = np.array([len(k) for k in sequences])
    shared = np.zeros(len(sequences), np.int64)
    for s in range(1, len(sequences)):
        a, b, d = sequences[s - 1], sequences[s], 0
        most = min(len(a), len(b))
        while d < most and a[d] == b[d]:
            d += 1
        shared[s] = d
    opened = sizes - shared
    opened[0] += 1  # the root
    closed = np.concatenate([sizes[:-1] - shared[1:], [sizes[-1] + 1]])
    signs = np.repeat(np.tile([1, 0], len(sequences)), np.column_stack([opened, closed]).ravel()).astype(np.int8)
    opens = np.flatnonzero(signs)
    tree = Parentheses(signs)
    close = tree.find_close(opens)
    count = len(opens)
    place = np.arange(count)
    stop = place + (close - opens + 1) // 2
    depth = tree.excess[opens] - 1
    leaf = (signs[opens + 1] == 0).astype(np.int64)

    # A sequence ends at the last node it opens; only the first of a shard can be the empty one, at the root.
    ends_at = np.cumsum(opened) - 1
    members, first = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
    members[ends_at], first[ends_at] = part["n"].to_numpy(np.int64), part["least"].to_numpy(np.int64)
    length = np.zeros(count, np.int64)
    owner = np.repeat(np.arange(len(sequences)), opened)
    flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in part["lens"]]])
    begin = np.cumsum(sizes) - sizes
    deep = depth > 0
    length[deep] = flat[begin[owner[deep]] + depth[deep] - 1]

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[stop] - total[place]

    n, least = below(members), _range_min(first, place, stop)
    order = np.lexsort((place, depth))
    by_depth = (depth * (count + 1) + place)[order]
    parent = order[np.searchsorted(by_depth, np.where(deep, (depth - 1) * (count + 1) + place, 0), "right") - 1]
    parent[0] = -1

    spine = np.zeros(count, bool)
    keys: dict[int, bytes] = {}
    for s in (0, len(sequences) - 1):
        at, path = int(ends_at[s]), _path_keys(sequences[s])
        for key in reversed(path):
            spine[at], keys[at] = True, key
            at = int(parent[at])
    off = ~spine
    children = np.bincount(parent[off & deep], minlength=count)
    hung = {"n_leaves": below(leaf * off), "saved_tokens": below(np.where(off, (n - 1) * length, 0))}
    lower = np.flatnonzero(spine & deep)
    for name, total in hung.items():
        hung[name] = total.copy()
        np.subtract.at(hung[name], parent[lower], total[lower])
    ends = np.full(count, None, object)
    ends[ends_at] = part["ends"].to_numpy()
    above = np.where(deep, parent, 0)
    return pd.DataFrame({
        "node": [keys.get(k) for k in range(count)], "parent": [keys.get(k) for k in parent.tolist()], "depth": depth, "conv_id": least,
        "parent_conv_id": pd.Series(least[np.maximum(parent, 0)], dtype="Int64").where(deep), "n_convs": n, "n_children": children,
        **hung, "length": length, "ends": ends, "spine": spine})


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, key, length: the turns by the digest of role and text, without their texts."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    key = F.substring(F.unhex(F.sha2(both, 256)), 1, KEY_BYTES)
    return turns.where("conv_id is not null").select("conv_id", "turn", key.alias("key"), F.char_length(text).alias("length"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, keys, lens: one row per conversation, its turns in order."""
    held = turn_rows(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "length"))).alias("held"))
    return held.select("conv_id", F.col("held.key").alias("keys"), F.col("held.length").alias("lens"))


def rebuilt(found: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first turns from the first conversation of its group of ids."""
    own = found.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    head = found.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("keys", "lens")])

    def joined(c: str) -> Column:
        first = F.when(F.col(f"head_{c}").isNotNull() & (F.col("h") > 0), F.slice(f"head_{c}", F.lit(1), F.col("h"))).otherwise(F.slice(c, 1, 0))
        return F.concat(first, F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)

    return own.join(head, "base", "left").select("conv_id", joined("keys"), joined("lens"))


def id_digests(members: DataFrame) -> DataFrame:
    """sequence, ends: SHA-256 of the members' decimal ids in ascending order, comma-joined.

    Ranges of (sequence, id) join ids to pieces wherever they lie; only pieces meet to be hashed in order.
    """

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part.empty:
                continue
            ids, seq = part["conv_id"].to_numpy(), part["sequence"].to_numpy(object)
            cut = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            starts = sorted({*cut.tolist(), *range(0, len(ids), PIECE)})
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pd.DataFrame({"sequence": seq[starts], "first": ids[starts], "piece": text})

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for sequence, piece in zip(part["sequence"], part["piece"], strict=True):
                if sequence != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = sequence, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pd.DataFrame(out, columns=["sequence", "ends"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["sequence", "ends"])

    ranged = members.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    joined = ranged.mapInPandas(pieces, "sequence binary, first bigint, piece string")
    return joined.repartition("sequence").sortWithinPartitions("sequence", "first").mapInPandas(hashed, "sequence binary, ends string")


def sequences(convs: DataFrame) -> DataFrame:
    """keys, lens, n, least, ends of every distinct sequence."""
    empty = F.unhex(F.lit("00"))
    named = convs.withColumn("sequence", F.unhex(F.sha2(F.concat(empty, F.array_join(F.transform("keys", F.hex), "").cast("binary")), 256)))
    named = written(named, "conversations")
    distinct = named.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    shape = named.select("conv_id", "keys", "lens")
    told = distinct.join(id_digests(named.select("sequence", "conv_id")), "sequence")
    return told.join(shape, told["least"] == shape["conv_id"]).select("keys", "lens", "n", "least", "ends")


def _raised(spines: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens: what hangs off a merged spine node and all spine nodes below it."""
    now = written(spines.select("node", F.col("parent").alias("above"), "n_leaves", "saved_tokens"), "spine-sums")
    while not now.where("above is not null").isEmpty():
        up = now.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("more_saved"))
        further = now.where("above is not null").select(F.col("node").alias("above"), F.col("above").alias("next"))
        sums = now.join(up, "node", "left").join(further, "above", "left")
        now = written(sums.select("node", F.col("next").alias("above"), (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"),
                                  (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens")), "spine-sums")
    return now.select("node", "n_leaves", "saved_tokens")


def merged_spines(parts: DataFrame) -> DataFrame:
    """One row per spine node of all shards, with whole counts, under the columns of a node."""
    spines = written(parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("length").alias("length"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends")), "spines")
    below = spines.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    counted = spines.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = counted.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    own = written(own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("length")), "spines-counted")
    return own.drop("n_leaves", "saved_tokens", "more").join(_raised(own), "node")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, keys, lens), in the columns of the contract."""

    def shards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, turns = [], 0
        for part in parts:
            size = part["keys"].map(len).cumsum().to_numpy() + turns
            begin = 0
            for cut in np.flatnonzero(np.diff(size // SHARD_TURNS, prepend=turns // SHARD_TURNS)).tolist():
                held.append(part.iloc[begin : cut + 1])
                yield shard_nodes(pd.concat(held, ignore_index=True))
                held, begin = [], cut + 1
            if begin < len(part):
                held.append(part.iloc[begin:])
            turns = int(size[-1]) % SHARD_TURNS if len(size) else turns
        if held:
            yield shard_nodes(pd.concat(held, ignore_index=True))

    ranged = sequences(convs).repartitionByRange("keys").sortWithinPartitions("keys")
    nodes = written(ranged.mapInPandas(shards, NODE), "trie-nodes")
    spines = written(merged_spines(nodes.where("spine")), "trie-spines")
    above = spines.select(F.col("node").alias("parent"), F.col("conv_id").alias("spine_conv_id"))
    out = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = nodes.where("not spine and parent is null").select(*out)
    edge = nodes.where("not spine and parent is not null").select("parent", *out).unionByName(spines.withColumn("parent_conv_id", F.lit(None).cast("bigint")).select("parent", *out))
    edge = edge.join(above, "parent", "left").withColumn("parent_conv_id", F.col("spine_conv_id")).select(*out)
    named = inner.unionByName(edge).withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS)))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table conv_id, turn, role, text."""
    return prefix_trie(rebuilt(conversations(turns)))
