"""Shared pieces of the text operators: stage tables, word hashing, Arrow helpers.

A word is a maximal run of bytes other than the six ASCII white-space bytes (space, \\t, \\n, \\v, \\f, \\r), the
pattern ``[^\\x20\\x09-\\x0D]+``.  A word is known by the XXH3 digest of its bytes, 128 bits.  All hashing is a pure
function of the bytes, so every executor and every rerun of a lost task gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.stages import shared_dir, stage_table

__all__ = ["GROUP", "Words", "batches", "fresh", "id_column", "keyed_texts", "mix", "raw_texts", "read_table", "restore_id", "runs_of", "shared_dir", "signed", "slices", "split_words", "stage_table", "words_in", "words_of"]

#: A null doc_id is ordered before every other id; it is turned back into null in results.
NULL_ID = -(2**63)
_M64 = (1 << 64) - 1
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes of text that are hashed at once; longer texts are cut at white space.
BLOCK = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_column(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def restore_id(name: str) -> Column:
    """The id as the user wrote it: the stand-in for null becomes null again."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(_id, text): only what an operator needs, so extra columns of any name can't clash; a null text counts as empty."""
    return docs.select(id_column().alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def raw_texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (self.base, self.inverse))
        return self.up, self.down


#: Bytes of texts whose words are held at once, about.
GROUP = 1 << 23


def slices(column: pa.Array, size: int = GROUP) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): slices of consecutive texts that have about `size` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, column.slice(at, to - at)
        at = to


class Words(NamedTuple):
    """The words of several texts in a row: both halves of their digests, and bounds[k] to bounds[k + 1] for text k."""

    lo: np.ndarray
    hi: np.ndarray
    bounds: np.ndarray


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words, bounds) of a string array without nulls."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    inside = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves an empty string
    before = np.concatenate([[0], np.cumsum(inside.to_numpy(zero_copy_only=False))])
    return flat.filter(inside).dictionary_encode(), before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def words_in(coded: pa.DictionaryArray, bounds: np.ndarray) -> Words:
    digests = b"".join([xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()])
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    own = coded.indices.to_numpy()
    return Words(halves[:, 0][own], halves[:, 1][own], bounds)


def words_of(texts: pa.Array) -> Words:
    return words_in(*split_words(texts))


def runs_of(x: np.ndarray, size: int) -> np.ndarray:
    """A key of every run of `size` values: keys of 1, 2, 4 ... values are mixed in pairs, so no sum or product shows in them."""
    level, width, out, covered = x, 1, None, 0
    while True:
        if size & width:
            out = level if out is None else mix(out[: len(x) - covered - width + 1] * np.uint64(_P2) + level[covered:]) if len(x) >= covered + width else x[:0]
            covered += width
        if 2 * width > size:
            return out
        level = mix(level[:-width] * np.uint64(_P1) + level[width:]) if len(level) > width else x[:0]
        width *= 2


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def batches(frame_batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for b in frame_batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
