"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, of word heads (their first bytes), of neighbouring pairs and of
pairs with one word between, hashed into one table. Every coordinate has its own rate, and L1 keeps
all but a few weights at exactly zero, so the model is a short sorted list that is sent to every task;
its size is bounded by the table.

Defined results: null and empty texts have no features and score the model's bias; repeated rows
score alike; without any labelled row every score is 0; several labels of one id count as toxic if
any is. Labels of ids outside the learning split, and every column but the text, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.words import Words, chunks

SLOTS = 1 << 22
HEADS = (5, 7)
#: Labelled rows that the model is fitted on at most, chosen by the hash of their id.
LEARN_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
BIAS = 0


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) ^ (h >> np.uint64(17))) & np.uint64(SLOTS - 1)


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature that occurs, each once; of the wanted slots only, if given (a mask)."""
    words = Words(texts)
    doc, h = words.doc, words.hashes()
    parts = [(doc, _mixed(h, 1))] + [(doc, _mixed(words.hashes(n), 1 + n)) for n in HEADS]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[gap:] >> np.uint64(1))
            parts.append((doc[gap:][same], _mixed(pair[same], 20 + gap)))
    keys = []
    for rows, slots in parts:
        slots = slots.astype(np.int64)
        if wanted is not None:
            on = wanted[slots]
            rows, slots = rows[on], slots[on]
        keys.append(rows * SLOTS + slots)
    found = np.unique(np.concatenate(keys))
    return found // SLOTS, found % SLOTS


class Ftrl:
    """Per-coordinate FTRL-proximal."""

    def __init__(self, slots: int = SLOTS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(slots), np.zeros(slots)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z = self.z[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: int) -> float:
        w = self.weights(slots)
        p = _sigmoid(w.sum())
        g = p - label
        n = self.n[slots]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] = n + g * g
        return p

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(np.abs(self.z) > self.l1)
        return some, self.weights(some)


def _sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_rows(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights learnt from the rows, in their order, epoch by epoch."""
    model = Ftrl()
    rows: list[np.ndarray] = []
    for a, b in chunks(texts):
        row, slot = features(texts[a:b])
        rows += [np.append(s, BIAS) for s in np.split(slot, np.searchsorted(row, np.arange(1, b - a)))]
    for _ in range(epochs):
        for slots, label in zip(rows, labels, strict=True):
            model.learn(np.unique(slots), label)
    return model.sparse()


def fit(docs: DataFrame, labels: DataFrame, learning: Column, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", rows: int = LEARN_ROWS) -> pd.DataFrame:
    """The model (slot, weight), fitted in one task on at most ``rows`` labelled learning rows."""
    chosen = (
        labels.where(learning & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
        .agg(F.max(F.col(label_column).cast("int")).alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows))
    sample = (
        docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(chosen, "id")
        .groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
        .repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("text", "label"))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, marks = [], []
        for part in parts:
            texts += part.text.tolist()
            marks += part.label.tolist()
        slots, weights = fit_rows(texts, marks)
        yield pd.DataFrame({"slot": slots, "weight": weights})

    return sample.mapInPandas(learn, "slot bigint, weight double").toPandas()


def score_rows(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    out, wanted = np.full(len(texts), table[BIAS]), table != 0
    for a, b in chunks(texts):
        row, slot = features(texts[a:b], wanted)
        on = slot != BIAS
        out[a:b] += np.bincount(row[on], table[slot[on]], b - a)
    return _sigmoid(out)


def score(docs: DataFrame, model: pd.DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.slot.to_numpy(np.int64), model.weight.to_numpy(float)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, weights = sent.value
        table = np.zeros(SLOTS)
        table[slots] = weights
        for part in parts:
            scores = score_rows(part.text.tolist(), table) if len(slots) else np.zeros(len(part))
            yield pd.DataFrame({"doc_id": part.doc_id, "score": scores})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_column].dataType))
