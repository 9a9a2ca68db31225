"""Words of many texts at once: one byte buffer, their places in it, and hashes without a loop per word."""

from __future__ import annotations

import numpy as np

from refrain.llm.simhash_vantage import xxh64_slices

_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_BLANKED = bytes.maketrans(_MARKS, b" " * len(_MARKS))


class Words:
    """The words of ``texts`` (lower case; ASCII marks blank out unless kept) in order."""

    def __init__(self, texts: list[str | None], marks: bool = False) -> None:
        joined, counts = [], []
        for text in texts:
            raw = (text or "").lower().encode("utf-8", "surrogatepass")
            words = (raw if marks else raw.translate(_BLANKED)).split()
            counts.append(len(words))
            if words:
                joined.append(b" ".join(words))
        self.counts = np.array(counts, np.int64)
        self.data = np.frombuffer(b" ".join(joined) + b" " * 9, np.uint8)
        total = int(self.counts.sum())
        self.stop = np.flatnonzero(self.data == 32)[:total]
        self.start = np.concatenate([np.zeros(min(total, 1), np.int64), self.stop[:-1] + 1])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, first_bytes: int | None = None, seed: int = 42) -> np.ndarray:
        size = self.stop - self.start
        return xxh64_slices(self.data, self.start, size if first_bytes is None else np.minimum(size, first_bytes), seed)


def chunks(texts: list, most: int = 2_000_000) -> list[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    out, begin, total = [], 0, 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= most:
            out.append((begin, i + 1))
            begin, total = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
