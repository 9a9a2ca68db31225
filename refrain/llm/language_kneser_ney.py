"""Language identification by interpolated Kneser-Ney models over letters, one per language.

Letters fold to 64 classes (a to z for themselves in either case, other letters by a hash, everything
else a blank; runs of blanks are one), so a run of four letters is a 24-bit key. A model is a few sorted
key arrays with the log probability of each seen run and the weight each context gives to shorter ones;
64 ** 4 keys bound it whatever the corpus. All learning rows are counted, over their whole texts.

A text gets the language of lowest cross-entropy per letter. Its score is a softmax over the languages
whose sharpness is fitted on all learning rows; ``accepted`` says whether the cross-entropy is one that
nearly all learning rows of that language stay under.

Defined results: null texts and texts without a letter are ``und`` with score 0, not accepted; equal
entropies go to the first language by name; rows without a language teach nothing; without any
learning row every text is ``und``; repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.words import chunks

ORDER = 4
BITS = 6
CLASSES = 1 << BITS
UNKNOWN = "und"
#: Sharpness values that are tried, and the width (nats) of the steps in which entropies are counted for acceptance.
SHARPNESS = 2.0 ** np.arange(-6, 7)
ENTROPY_STEP = 1e-3
#: Share of a language's learning rows that acceptance keeps.
ACCEPTED_SHARE = 0.999
_EDGE = 0x10FFFF
_PAD = chr(_EDGE) * (ORDER - 1)
_table: np.ndarray | None = None


def _classes() -> np.ndarray:
    """The class of every code point; 0 is a blank."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            if chr(point).isalpha():
                low = ord(chr(point).lower()[0])
                table[point] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 37
        _table = table
    return _table


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, run of letter classes ending here) for every letter and single blank of every text."""
    points = np.frombuffer("".join([_PAD + (t or "") for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    edge = points == _EDGE
    sizes = np.array([len(t or "") + ORDER - 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    kinds = _classes()[points]
    blank = kinds == 0
    keep = ~blank | edge
    keep[1:] |= blank[1:] & ~blank[:-1]
    kinds, row, edge = kinds[keep].astype(np.int32), row[keep], edge[keep]
    run = np.zeros(len(kinds), np.int32)
    for back in range(ORDER):
        run[back:] |= kinds[: len(kinds) - back] << (BITS * back)
    return row[~edge], run[~edge]


def counted(docs: DataFrame, learning: Column, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """lang, run, n: how often each run occurs over all learning rows; tasks send on sums, not letters."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            for lang, own in part.groupby("lang").text:
                texts = own.tolist()
                for a, b in chunks(texts):
                    keys, n = np.unique(grams(texts[a:b])[1], return_counts=True)
                    if lang in sums:
                        keys, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
                    sums[lang] = keys, n
        for lang, (keys, n) in sums.items():
            yield pd.DataFrame({"lang": lang, "run": keys, "n": n})

    rows = docs.where(learning & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    some = rows.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    return some.mapInPandas(count, "lang string, run int, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def _discount(n: np.ndarray) -> float:
    ones, twos = int((n == 1).sum()), int((n == 2).sum())
    return ones / (ones + 2 * twos) if ones else 0.5


def smooth(run: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per order, from one: sorted runs, their log probability, sorted contexts, log weight of the shorter order."""
    order = np.argsort(run)
    tables = [(run[order].astype(np.int64), n[order].astype(np.int64))]
    for k in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(tables[0][0] & ((1 << BITS * k) - 1), return_counts=True)
        tables.insert(0, (keys, counts))
    out: list[tuple[np.ndarray, ...]] = []
    for k, (keys, counts) in enumerate(tables, 1):
        d = _discount(counts)
        contexts, at, followers = np.unique(keys >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(at, counts)
        weight = d * followers / total
        if k == 1:
            lower = np.full(len(keys), 1 / CLASSES)
        else:
            below = out[-1]
            lower = np.exp(below[1][np.searchsorted(below[0], keys & ((1 << BITS * (k - 1)) - 1))])
        p = np.maximum(counts - d, 0) / total[at] + weight[at] * lower
        out.append((keys, np.log(p), contexts, np.log(weight)))
    return out


def _looked(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def log_probabilities(model: list[tuple[np.ndarray, ...]], run: np.ndarray) -> np.ndarray:
    """Log probability of each run's last letter after the ones before it."""
    run = run.astype(np.int64)
    p = np.full(len(run), -np.log(CLASSES))
    for k, (keys, logs, contexts, weights) in enumerate(model, 1):
        part = run & ((1 << BITS * k) - 1)
        seen, known = _looked(keys, logs, part)
        met, weight = _looked(contexts, weights, part >> BITS)
        p = np.where(seen, known, np.where(met, weight + p, p))
    return p


class Models:
    """The models of all languages with their calibration."""

    def __init__(self, langs: list[str], models: list[list[tuple[np.ndarray, ...]]]) -> None:
        self.langs, self.models = langs, models
        self.sharpness, self.limits = 1.0, np.full(len(langs), np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of each text under each language, and its number of letters."""
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for a, b in chunks(texts):
            row, run = grams(texts[a:b])
            keys, at = np.unique(run, return_inverse=True)
            n = np.bincount(row, minlength=b - a)
            letters[a:b] = np.bincount(row, (run & (CLASSES - 1)) != 0, b - a)
            for k, model in enumerate(self.models):
                out[a:b, k] = -np.bincount(row, log_probabilities(model, keys)[at], b - a) / np.maximum(n, 1)
        return out, letters

    def fitted(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss of each sharpness summed over the texts, and language and entropy step of each text with a letter."""
        entropy, letters = self.entropies(texts)
        truth = np.array([self.langs.index(x) for x in langs], np.int64)
        some = letters > 0
        entropy, truth, letters = entropy[some], truth[some], letters[some]
        own = np.arange(len(truth)), truth
        if not len(truth):
            return np.zeros(len(SHARPNESS)), truth, truth
        loss = [-np.log(np.maximum(self._softmax(entropy, letters, g)[own], 1e-12)).sum() for g in SHARPNESS]
        return np.array(loss), truth, np.ceil(entropy[own] / ENTROPY_STEP).astype(np.int64)

    def calibrate(self, losses: np.ndarray, counts: pd.DataFrame) -> None:
        """Sharpness by the likelihood of the true languages; limits by the languages' own entropies (lang, step, n)."""
        if not len(counts):
            return
        self.sharpness = float(SHARPNESS[int(np.argmin(losses))])
        for k, own in counts.sort_values("step").groupby("lang"):
            reached = own.n.cumsum().to_numpy()
            at = int(np.searchsorted(reached, np.ceil(ACCEPTED_SHARE * reached[-1])))
            self.limits[int(k)] = own.step.to_numpy()[at] * ENTROPY_STEP * 1.05

    def _softmax(self, entropy: np.ndarray, letters: np.ndarray, sharpness: float) -> np.ndarray:
        z = -entropy * sharpness * np.sqrt(letters + 1)[:, None]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        if not self.langs:
            nothing = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), nothing, nothing, nothing.astype(bool)
        entropy, letters = self.entropies(texts)
        best = entropy.argmin(1)
        at = np.arange(len(texts))
        score = np.where(letters > 0, self._softmax(entropy, letters, self.sharpness)[at, best], 0.0)
        own = entropy[at, best]
        names = [self.langs[k] if n else UNKNOWN for k, n in zip(best, letters, strict=True)]
        return names, score, own, (letters > 0) & (own <= self.limits[best])


_PACKED = "lang string, place int, runs binary, logs binary, contexts binary, weights binary"


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    lang = part.lang.iloc[0]
    rows = [(lang, k, *[x.tobytes() for x in level]) for k, level in enumerate(smooth(part.run.to_numpy(), part.n.to_numpy()))]
    return pd.DataFrame(rows, columns=["lang", "place", "runs", "logs", "contexts", "weights"])


def calibration(rows: DataFrame, models: Models) -> tuple[np.ndarray, pd.DataFrame]:
    """What calibrate needs, over all rows (text, lang): tasks send on sums and counts per entropy step, not texts."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        losses, counts = np.zeros(len(SHARPNESS)), Counter()
        for part in parts:
            loss, lang, step = sent.value.fitted(part.text.tolist(), part.lang.tolist())
            losses += loss
            counts.update(zip(lang.tolist(), step.tolist(), strict=True))
        rows = [(-1, k, 0, float(x)) for k, x in enumerate(losses)] + [(*at, n, 0.0) for at, n in counts.items()]
        yield pd.DataFrame(rows, columns=["lang", "step", "n", "loss"])

    sums = rows.mapInPandas(run, "lang int, step bigint, n bigint, loss double").groupBy("lang", "step")
    found = sums.agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).toPandas()
    losses = found[found.lang < 0].sort_values("step").loss.to_numpy()
    return losses, found[found.lang >= 0]


def fit(docs: DataFrame, learning: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Models:
    """Count all learning rows, smooth each language in a task of its own, calibrate on all learning rows."""
    packed = counted(docs, learning, id_column, text_column, lang_column).groupBy("lang").applyInPandas(_pack, _PACKED).collect()
    by_lang: dict[str, dict[int, tuple]] = {}
    for r in packed:
        by_lang.setdefault(r["lang"], {})[r["place"]] = (
            np.frombuffer(r["runs"], np.int64), np.frombuffer(r["logs"]), np.frombuffer(r["contexts"], np.int64), np.frombuffer(r["weights"]))
    langs = sorted(by_lang)
    models = Models(langs, [[by_lang[x][k] for k in range(ORDER)] for x in langs])
    if langs:
        some = docs.where(learning & F.col(lang_column).isin(langs) & F.col(text_column).isNotNull())
        models.calibrate(*calibration(some.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang")), models))
    return models


def identify(docs: DataFrame, models: Models, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, entropy, accepted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lang, score, entropy, accepted = sent.value.predict(part.text.tolist())
            yield pd.DataFrame({"doc_id": part.doc_id, "lang_pred": lang, "score": score, "entropy": entropy, "accepted": accepted})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, lang_pred string, score double, entropy double, accepted boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_column].dataType))
