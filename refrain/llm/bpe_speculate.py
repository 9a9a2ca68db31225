"""BPE encoding and decoding by speculation: propose the greedy longest match, then verify it pair by pair.

A sequence of tokens is what merging gives exactly when every token is what merging makes of its own
letters and no merge would have crossed the border of two neighbours first. The border test undoes
the merges of both neighbours from the last to the first, over all new pairs of a batch at once.
Words that fail are merged step by step. Words are remembered while a task runs.

Defined results: null text is empty; an empty text has no tokens and decodes to an empty string;
special tokens written in a text become their ids, as the tokenizer file declares them; a letter
without a token (none exist in a byte-level vocabulary) is dropped. Texts are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Runs and words that a worker remembers before it starts over; they bound its memory, not the result.
REMEMBERED_RUNS, REMEMBERED_WORDS = 400_000, 100_000
#: Characters that str.split() takes for white space and the tokenizer's pattern language does not.
NOT_WHITE = "[\x1c-\x1f]"
_BASE, _NEVER = -1, np.iinfo(np.int64).max
_NO_MERGE = (_NEVER, -1)


class Speculator:
    """One tokenizer file: its vocabulary, merges, pattern and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        size = max(self.vocab.values()) + 1
        self.rank = np.full(size, _BASE, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (one, two) in enumerate(model["merges"]):
            a, b = self.vocab[one], self.vocab[two]
            whole = self.vocab[one.removesuffix(self.end) + two if self.end else one + two]
            self.merges.setdefault((a, b), (rank, whole))
            if self.rank[whole] == _BASE:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([rank for rank, _ in self.merges.values()], np.int64)[order]
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            head, size = token[:3], len(token.removesuffix(self.end)) if self.end else len(token)
            self.reach[head] = max(size, 2, self.reach.get(head, 0))
        self.letters = _byte_letters()
        self.own: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.library_split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.white, self.odd = regex.compile(r"\p{White_Space}+"), regex.compile(NOT_WHITE)
        self.failed = self.proposed = 0

    def runs(self, text: str) -> list[str]:
        """The normalised text cut at white space, which no word crosses."""
        if text.isascii():
            text = text.lower()
        elif self.newer(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.odd.search(text) is None:
            return text.split()
        return [run for run in self.white.split(text) if run]

    def newer(self, text: str) -> bool:
        """Whether a letter of the text is too new for this Python's tables; the library's own tables are asked then."""
        return any(unicodedata.category(c) == "Cn" for c in set(text))

    def cut_words(self, run: str) -> list[str]:
        if run.isascii() or not self.newer(run):
            return self.split.findall(run)
        return [word for word, _ in self.library_split.pre_tokenize_str(run)]

    def pieces(self, text: str) -> list[str]:
        """Runs in order; a special token stands as its own string, marked by a leading blank."""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self.runs(text)
        out, at = [], 0
        for m in found:
            out += self.runs(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.runs(text[at:])

    def symbols(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")])

    def propose(self, letters: str) -> list[int]:
        out, at, get, end, n = [], 0, self.vocab.get, self.end, len(letters)
        while at < n:
            reach = self.reach.get(letters[at : at + 3], 2)
            stop = at + reach
            if stop >= n:
                token = get(letters[at:] + end)
                if token is not None:
                    out.append(token)
                    break
                stop = n - 1 if end else n
            while stop > at:
                token = get(letters[at:stop])
                if token is not None:
                    break
                stop -= 1
            else:
                return []
            out.append(token)
            at = stop
        return out

    def merge(self, letters: str) -> list[int]:
        """The exact way: the lowest rank first, of equal ones the leftmost."""
        parts = list(letters)
        if parts:
            parts[-1] += self.end
        return self._merged([self.vocab[p] for p in parts if p in self.vocab])

    def _merged(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        found = [get(pair, _NO_MERGE) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is _NO_MERGE:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], best[1]), _NO_MERGE)
            if at < len(found):
                found[at] = get((best[1], ids[at + 1]), _NO_MERGE)
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: no merge crosses their border before both are made."""
        good = np.ones(len(a), bool)
        row = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NEVER)
        while len(row):
            keys = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            cross = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)
            bad = cross < limit
            good[row[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra != _BASE) | (rb != _BASE))
            row, a, b, ra, rb = row[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return good

    def _owns(self, token: int) -> bool:
        """Whether merging makes this token of its own letters."""
        known = self.own.get(token)
        if known is None:
            text = self.text_of[token]
            ends = bool(self.end) and text.endswith(self.end)
            letters = [*text.removesuffix(self.end)]
            ids = [self.vocab[c] for c in letters]
            if ends:
                ids[-1] = self.vocab[letters[-1] + self.end]
            known = self.own[token] = self._merged(ids) == [token]
        return known

    def learn(self, words: list[str]) -> None:
        letters = [self.symbols(w) for w in words]
        proposals = [self.propose(x) for x in letters]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(words)), sizes)
        fails = sizes == 0
        own = {int(t): self._owns(int(t)) for t in np.unique(flat)}
        lone = np.fromiter((own[int(t)] for t in flat), bool, len(flat))
        fails[word_of[~lone]] = True
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        fails[word_of[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        self.proposed += len(words)
        self.failed += int(fails.sum())
        for i, word in enumerate(words):
            ids = self.merge(letters[i]) if fails[i] else proposals[i]
            self.words[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids (little-endian, four bytes each) and what they decode to, per text."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED_RUNS:
            self.known.clear()
        fresh = {run: None for runs in split for run in runs if run not in self.known}
        cut = {run: self.cut_words(run) for run in fresh if run[0] != " "}
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        if new := list({w: None for words in cut.values() for w in words if w not in self.words}):
            self.learn(new)
        for run in fresh:
            if run[0] == " ":
                self.known[run] = np.array([self.specials[run[1:]]], "<u4").tobytes()
            else:
                self.known[run] = b"".join([self.words[w] for w in cut[run]])
        known = self.known
        packed = [b"".join([known[run] for run in runs]) for runs in split]
        text_of = self.text_of.__getitem__
        return packed, [" ".join(map(text_of, np.frombuffer(ids, "<u4").tolist())) for ids in packed]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable ones for themselves, the rest from 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(spare))
        spare += byte not in plain
    return out


_loaded: dict[str, Speculator] = {}


def speculator(path: str) -> Speculator:
    if path not in _loaded:
        _loaded[path] = Speculator(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = 256) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers), decoded, for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = speculator(path)
        for part in parts:
            for at in range(0, len(part), chunk):
                some = part.iloc[at : at + chunk]
                packed, decoded = model.encode(some.text.tolist())
                yield pd.DataFrame({"doc_id": some.doc_id, "ids": packed, "decoded": decoded})

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "doc_id string, ids binary, decoded string")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_column].dataType))
