"""Favourite toggles as a stream: what each user holds, kept in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HELD = "user_id long, ids array<long>"


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Toggle a batch's rows in order of (ts, event_id) on what the user held before."""
    held = set(state.get[0]) if state.exists else set()
    toggles = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for ids in toggles.ids:
        row = {int(i) for i in ids}
        held = held - row if held & row else held | row
    kept = sorted(held)
    state.update((kept,))
    yield pd.DataFrame({"user_id": [key[0]], "ids": [kept]})


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _fold_settled(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hold toggles back until the watermark has passed them, then fold those in order of (ts, event_id)."""
    held, waiting = (set(state.get[0]), json.loads(state.get[1])) if state.exists else (set(), [])
    for part in () if state.hasTimedOut else parts:
        for at, event_id, ids in zip(_micros(part.ts), part.event_id.tolist(), part.ids, strict=True):
            waiting.append([at, event_id, sorted({int(i) for i in ids})])
    settled = state.getCurrentWatermarkMs() * 1_000
    waiting.sort()
    ready = [w for w in waiting if w[0] <= settled]
    for _, _, ids in ready:
        row = set(ids)
        held = held - row if held & row else held | row
    rest = waiting[len(ready) :]
    kept = sorted(held)
    state.update((kept, json.dumps(rest)))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1_000 + 1, state.getCurrentWatermarkMs() + 1))
    if ready:
        yield pd.DataFrame({"user_id": [key[0]], "ids": [kept]})


def held_favourites(events: DataFrame, delay: str | None = None) -> DataFrame:
    """(user_id, ids) after each batch, for users with toggles in it.

    ``events`` has user_id, ts, event_id and ids; rows may overlap in any way. Without a ``delay`` state is the numbers
    a user holds, and order counts within a batch by (ts, event_id), across batches by arrival. With one, order counts
    by event time over all batches: toggles wait until the watermark, ``delay`` behind the latest ts, has passed
    them; what comes later than that is left out, so a state holds at most one delay of a user's toggles.
    """
    if delay is not None:
        timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("ids").cast("array<bigint>").alias("ids"))
        return timed.filter(F.size("ids") > 0).withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(
            _fold_settled, HELD, "ids array<long>, waiting string", "update", GroupStateTimeout.EventTimeTimeout)
    return events.select("user_id", "ts", "event_id", F.col("ids").cast("array<bigint>").alias("ids")).filter(
        F.size("ids") > 0
    ).groupBy("user_id").applyInPandasWithState(_fold, HELD, "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def start_favourites(events: DataFrame, path: str, checkpoint: str, delay: str | None = None) -> StreamingQuery:
    """Write what changed keyed by batch; a replayed batch overwrites itself."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        held_favourites(events, delay).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_favourites(changes: DataFrame) -> DataFrame:
    """(user_id, id) from the written change log: the latest batch per user decides."""
    latest = changes.groupBy("user_id").agg(F.max_by("ids", "batch").alias("ids"))
    return latest.select("user_id", F.explode("ids").alias("id"))


def compact(changes: DataFrame, path: str) -> None:
    """The change log as one row per user, readable in its place; older batches may go then."""
    changes.groupBy("user_id").agg(F.max_by("ids", "batch").alias("ids"), F.max("batch").alias("batch")).write.parquet(path)
