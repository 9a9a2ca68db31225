"""Quality from positive and unlabelled texts: a small network fitted by non-negative unbiased risk.

Trusted positives are rows labelled good, the unlabelled side is web text as it comes. With the class
prior p the risk is p * E+[loss(g)] + max(0, Eu[loss(-g)] - p * E+[loss(-g)]): when the second part would
fall below zero the network has begun to learn single rows, and a smaller step goes against it instead. The
prior is estimated as the share of trusted positives among the labelled learning rows; where only
positives are labelled, pass one.

Features are shares and rates of the whole text (letters, marks, words, lines, repetition), so no
column but the text is read. Defined results: null and empty texts have the features of an empty text;
several labels of one id count as good only if all are; repeated rows score alike; without a trusted
positive every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.words import Words, chunks

#: Rows fitted on at most, chosen by the hash of their id: trusted positives, and unlabelled ones.
POSITIVE_ROWS = 8_000
UNLABELLED_ROWS = 16_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1_500, 512, 0.01, 1e-4
#: How much of a step is taken against a negative part below zero.
CORRECTION = 0.2
MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
N_FEATURES = len(MARKS) + 17


def features(texts: list[str | None]) -> np.ndarray:
    """One row of bounded numbers per text."""
    out = np.zeros((len(texts), N_FEATURES))
    for a, b in chunks(texts):
        out[a:b] = _features(texts[a:b])
    return out


def _repeats(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: how many keys, how many different ones, how often the commonest occurs."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(d)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], runs)
    return np.bincount(doc, minlength=n), np.bincount(d[at], minlength=n), most


def _features(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    bytes_of = np.zeros((n, 256))
    upper, size = np.zeros(n), np.ones(n)
    line_doc, line_key = [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        bytes_of[i] = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        size[i] = max(1, bytes_of[i].sum())
        upper[i] = size[i] and bytes_of[i, 65:91].sum()
        lines = [hash(x) for x in text.split("\n") if x.strip()]
        line_doc.append(np.full(len(lines), i))
        line_key.append(np.array(lines, np.int64))
    words = Words(texts, marks=True)
    h = words.hashes()
    all_words, different, most = _repeats(words.doc, h, n)
    same = words.doc[2:] == words.doc[:-2]
    runs = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:]
    triples, new_triples, _ = _repeats(words.doc[2:][same], runs[same], n)
    ld = np.concatenate(line_doc) if line_doc else np.zeros(0, np.int64)
    lk = np.concatenate(line_key) if line_key else np.zeros(0, np.int64)
    lines, new_lines, most_lines = _repeats(ld, lk, n)
    letters = bytes_of[:, 65:91].sum(1) + bytes_of[:, 97:123].sum(1) + (bytes_of[:, 192:].sum(1))
    nw, nl = np.maximum(all_words, 1), np.maximum(lines, 1)
    ends = words.data[words.stop - 1] if len(words.doc) else np.zeros(0, np.uint8)
    marked = np.bincount(words.doc, np.isin(ends, [m for m in MARKS if m not in (44, 46)]), n) / nw
    alone = np.bincount(words.doc, (words.stop - words.start) == 1, n) / nw
    shares = np.sqrt(bytes_of[:, MARKS] / size[:, None])
    rest = np.stack([
        upper / np.maximum(letters, 1), bytes_of[:, 48:58].sum(1) / size, letters / size, bytes_of[:, 10] / size,
        bytes_of[:, 128:].sum(1) / size, np.log1p(all_words) / 10, np.log1p(size / nw) / 3, different / nw,
        np.log1p(different) / np.log1p(nw + 1), most / nw, new_triples / np.maximum(triples, 1), new_lines / nl,
        most_lines / nl, np.log1p(nw / nl) / 6, marked, alone, (all_words == 0).astype(float),
    ], 1)
    return np.concatenate([shares, rest], 1)


class Network:
    """One hidden layer; scores are class probabilities."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return x, np.maximum(x @ self.weights[0] + self.weights[1], 0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x)[1] @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise the non-negative risk with logistic loss by Adam over mini-batches of both sides."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    w = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    net = Network(mean, scale, w)
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, STEPS + 1):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        x, hidden = net._hidden(np.concatenate([p, u]))
        g = hidden @ w[2] + w[3]
        s = _sigmoid(g)
        loss_down = np.logaddexp(0, g)
        negative = loss_down[BATCH:].mean() - prior * loss_down[:BATCH].mean()
        grad = np.zeros(2 * BATCH)
        if negative >= 0:
            grad[:BATCH] = prior * ((s[:BATCH] - 1) - s[:BATCH]) / BATCH
            grad[BATCH:] = s[BATCH:] / BATCH
        else:
            grad[:BATCH] = CORRECTION * prior * s[:BATCH] / BATCH
            grad[BATCH:] = -CORRECTION * s[BATCH:] / BATCH
        back = np.outer(grad, w[2]) * (hidden > 0)
        grads = [x.T @ back + DECAY * w[0], back.sum(0), hidden.T @ grad + DECAY * w[2], grad.sum()]
        rate = RATE * (1 if step < STEPS * 0.6 else 0.2)
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"trusted": part.trusted, "x": list(features(part.text.tolist()))})

    return rows.select("trusted", "text").mapInPandas(run, "trusted boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learning: Column, prior: float | None = None, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "quality", positive_rows: int = POSITIVE_ROWS,
        unlabelled_rows: int = UNLABELLED_ROWS) -> Network | None:
    """A network of the trusted positives and the unlabelled rows; None without a trusted positive."""
    order = [F.xxhash64("id"), F.col("id")]
    known = (
        labels.where(learning & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
        .agg((F.min(F.col(label_column).cast("int")) == 1).alias("good")))
    if prior is None:
        prior = known.agg(F.avg(F.col("good").cast("int"))).first()[0]
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    ids = (
        known.where("good").orderBy(*order).limit(positive_rows).select("id", F.lit(True).alias("trusted"))
        .unionByName(texts.select("id").distinct().orderBy(*order).limit(unlabelled_rows).select("id", F.lit(False).alias("trusted"))))
    # At most positive_rows + unlabelled_rows ids go to the texts, which stay where they are; an id counts with one text.
    chosen = texts.join(F.broadcast(ids), "id").groupBy("id", "trusted").agg(F.min("text").alias("text"))
    found = _feature_rows(chosen).toPandas()
    if not found.trusted.any():
        return None
    x, trusted = np.array(found.x.tolist()), found.trusted.to_numpy(bool)
    order = np.lexsort(x.T[::-1])  # the rows come in no fixed order
    x, trusted = x[order], trusted[order]
    unlabelled = x[~trusted] if (~trusted).any() else x
    return fit_network(x[trusted], unlabelled, min(max(prior, 0.01), 0.99))


def score_rows(texts: list[str | None], model: Network | None) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(features(texts))


def score_column(text: Column, model: Network | None) -> Column:
    """The score as a column, for filters that keep all other columns."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_rows(texts.tolist(), model))

    return run(text)


def score(docs: DataFrame, model: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id, "score": score_rows(part.text.tolist(), model)})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_column].dataType))
