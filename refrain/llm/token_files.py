"""Token counts of flat token files by a separator scan.

A token file is nothing but token ids, document after document, each ended by the end-of-document id;
there is no index. Blocks of a file are searched for that id with one vectorised comparison each. What a
block cannot know, where the document that it begins in began and how many ended before, comes from a
prefix scan over block summaries: first within runs of blocks, then over the runs, so that no task holds
the blocks of a large file.

Files are read as blocks either from flat binary files (`read_files`) or from the block table that
`write_blocks` makes of documents. Defined results: null and empty texts are documents of no tokens; ids
after the last separator are an unfinished document (``ended`` false); an empty file has no documents;
end-of-document strings inside a text are ordinary text; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.common import written

BLOCK_TOKENS = 65_536
#: Blocks of one file that a scan of the first level goes over.
RUN_BLOCKS = 1_024

#: White-space runs that are merged by themselves.
LONG_BLANK = regex.compile(r"\p{White_Space}{2000,}+")

_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """Byte-level BPE of a rank file; ``pattern`` cuts a text into pieces."""
    if path not in _encoders:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode(model: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text as ordinary text, whatever its length.

    The library's pattern overflows on white-space runs of very great length. Such a run is one piece but
    for its last character, which belongs to what follows, so it is merged by itself.
    """
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        out += model.encode_ordinary(text[at : run.start()])
        at = run.end() - (run.end() < len(text))
        out += model._encode_single_piece(text[run.start() : at])
    return out + model.encode_ordinary(text[at:])


def end_id(path: str) -> int:
    """The end-of-document id: the first one that the rank file leaves free."""
    with open(path, "rb") as file:
        return sum(1 for _ in file)


def write_blocks(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                 block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, order): each partition of the documents as one flat file of 32-bit ids, cut every ``block_tokens``
    whatever stands there, and beside it which document is the how-manieth of its file."""
    end = end_id(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, file = encoder(path, pattern), TaskContext.get().partitionId()
        open_ids, block, place = np.zeros(0, "<u4"), 0, 0
        for part in parts:
            for at in range(0, len(part), 128):
                some = part.iloc[at : at + 128]
                flat = [np.array([*encode(model, text), end], "<u4") for text in some.text]
                yield pd.DataFrame({"file": file, "block": None, "ids": None, "place": np.arange(place, place + len(some)), "doc_id": some.doc_id})
                place += len(some)
                open_ids = np.concatenate([open_ids, *flat])
                full = len(open_ids) // block_tokens
                if full:
                    yield _block_rows(file, block, [open_ids[i * block_tokens : (i + 1) * block_tokens] for i in range(full)])
                    block += full
                    open_ids = open_ids[full * block_tokens :]
        if len(open_ids):
            yield _block_rows(file, block, [open_ids])

    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    both = written(rows.mapInPandas(run, "file bigint, block bigint, ids binary, place bigint, doc_id string"), "token-files")
    order = both.where("block IS NULL").select("file", "place", F.col("doc_id").cast(docs.schema[id_column].dataType).alias("doc_id"))
    return both.where("block IS NOT NULL").select("file", "block", "ids"), order


def _block_rows(file: int, first: int, ids: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"file": file, "block": np.arange(first, first + len(ids)), "ids": [x.tobytes() for x in ids], "place": None, "doc_id": None})


def read_files(spark: SparkSession, path: str, width: int = 4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, ids of flat binary files of little-endian ids of ``width`` bytes (each file below 2 GB)."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content, strict=True):
                ids = np.frombuffer(content, f"<u{width}", len(content) // width).astype("<u4")
                for block in range(-(-len(ids) // block_tokens)):
                    yield pd.DataFrame({"file": [name], "block": [block], "ids": [ids[block * block_tokens : (block + 1) * block_tokens].tobytes()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block bigint, ids binary")


def document_counts(blocks: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """file, place, start, n_tokens, ended: every document of every file, the separator not counted.

    All blocks of a file but its last hold ``block_tokens`` ids.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            places = [np.flatnonzero(np.frombuffer(x, "<u4") == end) for x in part.ids]
            first = part.block.to_numpy(np.int64) * block_tokens
            yield pd.DataFrame({
                "file": part.file, "block": part.block, "found": [p + f for p, f in zip(places, first, strict=True)],
                "n_found": [len(p) for p in places], "last_found": [p[-1] + f if len(p) else -1 for p, f in zip(places, first, strict=True)],
                "stop": first + part.ids.map(len).to_numpy(np.int64) // 4})

    kind = blocks.schema["file"].dataType.simpleString()
    found = written(blocks.mapInPandas(scan, f"file {kind}, block bigint, found array<bigint>, n_found bigint, last_found bigint, stop bigint"), "separators")
    found = found.withColumn("run", F.floor(F.col("block") / run_blocks))
    runs = found.groupBy("file", "run").agg(F.sum("n_found").alias("n"), F.max("last_found").alias("last"), F.max("stop").alias("stop"))
    above = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.max("last").over(above), F.lit(-1)).alias("last_above"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.join(runs, ["file", "run"]).select(
        "file", "found", (F.col("n_above") + F.coalesce(F.sum("n_found").over(before), F.lit(0))).alias("first_place"),
        F.greatest("last_above", F.coalesce(F.max("last_found").over(before), F.lit(-1))).alias("previous"))
    each = stitched.select("file", "first_place", "previous", "found", F.posexplode("found").alias("i", "at")).select(
        "file", (F.col("first_place") + F.col("i")).alias("place"),
        (F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get("found", F.col("i") - 1)) + 1).alias("start"), "at")
    whole = each.select("file", "place", "start", (F.col("at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = found.groupBy("file").agg(F.sum("n_found").alias("place"), (F.max("last_found") + 1).alias("start"), F.max("stop").alias("stop"))
    rest = tails.where("stop > start").select("file", "place", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every document, read off the token files that its texts are written to."""
    blocks, order = write_blocks(docs, path, pattern, id_column, text_column, block_tokens)
    counts = document_counts(blocks, end_id(path), block_tokens)
    return order.join(counts, ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
