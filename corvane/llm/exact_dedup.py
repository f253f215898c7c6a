"""Exact dedup by content-defined chunk recipes.

Every text is cut into chunks where a rolling hash of its last 16 bytes meets a mask, so equal texts get equal cuts.
Chunk bytes move once: they are grouped by (hash, length, bytes), which is both the chunk store and the check that a
(hash, length) pair names one byte string.  After that only recipes move: the ordered lists of chunk identifiers,
twelve bytes for about two kilobytes of text.  Texts are equal when their recipes are; a text that holds a chunk whose
(hash, length) turned out to name two byte strings also compares its SHA-256, so a collision can't join two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BLOCK, Powers, keyed_texts, mix, raw_texts, read_table, restore_id, stage_table

MIN_CHUNK, MAX_CHUNK, MASK_BITS, WINDOW = 1024, 16384, 12, 16
_ROLL = Powers(0x9FB21C651E98DF25)


def cut_points(data: bytes, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, mask_bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks of data: content-defined, at least min_chunk (but the last) and at most max_chunk long."""
    n = len(data)
    if n <= min_chunk:
        return [n] if n else []
    marks: list[np.ndarray] = []
    for at in range(0, n, BLOCK):  # windows that end in this block
        lo = max(0, at - WINDOW + 1)
        buf = np.frombuffer(data, np.uint8, min(n, at + BLOCK) - lo, lo).astype(np.uint64)
        if len(buf) < WINDOW:
            continue
        up, down = _ROLL.to(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf + np.uint64(1)) * up[: len(buf)], out=total[1:])
        rolled = mix((total[WINDOW:] - total[:-WINDOW]) * down[: len(buf) - WINDOW + 1])
        marks.append(np.flatnonzero(rolled >> np.uint64(64 - mask_bits) == 0) + lo + WINDOW)
    out, last = [], 0
    for mark in np.concatenate(marks).tolist() + [n]:
        while mark - last > max_chunk:
            last += max_chunk
            out.append(last)
        if mark - last >= min_chunk or mark == n and mark > last:
            out.append(mark)
            last = mark
    return out


def _chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cut_points(data):
        out.append(data[at:end])
        at = end
    return out


def _signed64(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows; a chunk that this batch has already sent is not sent again."""
    for b in rows:
        chunks = list(dict.fromkeys(c for data in raw_texts(b.column("text")) for c in _chunks(data)))
        for at in range(0, len(chunks), 1000):
            part = chunks[at : at + 1000]
            yield pa.record_batch({"h": pa.array([_signed64(xxhash.xxh3_64_intdigest(c)) for c in part], pa.int64()), "n": pa.array([len(c) for c in part], pa.int32()), "chunk": pa.array(part, pa.binary())})


_ID = pa.struct([("h", pa.int64()), ("n", pa.int32())])


def _recipes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        sha, recipe = [], []
        for data in raw_texts(b.column("text")):
            sha.append(hashlib.sha256(data).hexdigest())
            recipe.append([{"h": _signed64(xxhash.xxh3_64_intdigest(c)), "n": len(c)} for c in _chunks(data)])
        yield pa.record_batch({"_id": b.column("_id"), "sha": pa.array(sha, pa.string()), "recipe": pa.array(recipe, pa.list_(_ID))})


def chunk_store(docs: DataFrame) -> DataFrame:
    """Distinct chunks (h, n, chunk): grouping by the bytes themselves verifies every identifier."""
    return keyed_texts(docs).mapInArrow(_store, "h long, n int, chunk binary").groupBy("h", "n", "chunk").agg(F.count(F.lit(1)).alias("sent"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Equal texts are byte-identical; a null text counts as empty, and empty texts are equal to each other.  The largest
    doc_id of a group stays.  A null doc_id counts as smallest; where all ids of a group are null, keep_id is null
    and its rows are kept.  Rows that repeat both id and text count in group_size and share the decision.  Extra
    columns are ignored; an empty table gives an empty result.  Memory: one Arrow batch and one text a task.
    """
    recipes = stage_table(keyed_texts(docs).mapInArrow(_recipes, "_id long, sha string, recipe array<struct<h:long,n:int>>"), "recipes")
    clashes = chunk_store(docs).groupBy("h", "n").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "n")
    clashing = recipes.select("_id", "sha", F.explode("recipe").alias("r")).select("_id", "sha", "r.h", "r.n").join(clashes, ["h", "n"], "left_semi").select("_id", "sha").distinct().withColumn("clash", F.col("sha"))
    clashing = stage_table(clashing, "clashing")
    keyed = recipes.join(clashing, ["_id", "sha"], "left").select("_id", "sha", "recipe", F.coalesce("clash", F.lit("")).alias("clash"))
    # texts without a copy need no row; the groups go through a table, so that Spark can split the join of a large group
    groups = stage_table(keyed.groupBy("recipe", "clash").agg(F.max("_id").alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    found = keyed.join(groups, ["recipe", "clash"], "left").withColumns({"keep": F.coalesce("keep", "_id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return found.select(
        restore_id("_id").alias("doc_id"), restore_id("keep").alias("keep_id"), "group_size", (F.col("_id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document, as exact_dedup gives them: null counts as empty, the largest doc_id of equal texts stays."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
}
