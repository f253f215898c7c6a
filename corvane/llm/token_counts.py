"""Token counts by section: whole documents are encoded once, token spans are joined to section spans.

The token ids of a byte-level vocabulary give every token's length in bytes, so one running sum maps all tokens of a
document to spans of characters.  Sections are intervals of characters that cover the document, and a sorted lookup of
each token's place among the section starts is the interval join; both sides belong to one row, so nothing is shuffled.

A token that crosses a boundary is allocated by RULE:
  "start": to the section of its first character;  "end": to that of its last character;
  "share": one part of the token to each section it touches, by its characters there (fractions add up to 1).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import keyed_texts, read_table, restore_id, stage_table

RULE = "start"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def load(path: str) -> tuple:
    """(encoding, bytes of each token)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def section_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which sections (lines with their line ends) start; a document has at least one."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[starts < len(data)] if len(data) else starts


def allocate(lengths: np.ndarray, starts: np.ndarray, chars: np.ndarray, rule: str = RULE) -> np.ndarray:
    """Tokens of each section.  lengths: bytes of each token; starts: bytes; chars: characters before each byte, and in all."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    if rule == "start":
        return np.bincount(np.searchsorted(starts, begins, "right") - 1, minlength=len(starts)).astype(float)
    last = np.searchsorted(starts, ends - 1, "right") - 1
    if rule == "end":
        return np.bincount(last, minlength=len(starts)).astype(float)
    first = np.searchsorted(starts, begins, "right") - 1
    whole = first == last
    out = np.bincount(first[whole], minlength=len(starts)).astype(float)
    for b, e, i, j in zip(begins[~whole], ends[~whole], first[~whole], last[~whole], strict=True):
        cuts = np.concatenate([[b], starts[i + 1 : j + 1], [e]])
        parts = np.maximum(np.diff(chars[cuts]), 0).astype(float)
        out[i : j + 1] += parts / parts.sum() if parts.sum() else 1 / len(parts)
    return out


def _counts(path: str, rule: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = load(path)
        for b in rows:
            ids, texts = b.column("_id").to_pylist(), b.column("text").to_pylist()
            own: list[tuple] = []
            held = 0
            for i, text in zip(ids, texts, strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                tokens = np.array(encoding.encode_ordinary(text), np.int64)
                starts = section_starts(data)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                n = allocate(size[tokens], starts, chars, rule) if len(tokens) else np.zeros(len(starts))
                at = chars[starts]
                own.append((np.full(len(starts), i), np.arange(len(starts)), at, np.diff(np.concatenate([at, [chars[-1]]])), n))
                held += len(starts)
                if held >= 50_000:
                    yield _batch(own)
                    own, held = [], 0
            if own:
                yield _batch(own)

    return run


def _batch(own: list[tuple]) -> pa.RecordBatch:
    i, section, at, chars, n = (np.concatenate(x) for x in zip(*own, strict=True))
    return pa.record_batch({"_id": pa.array(i, pa.int64()), "section": pa.array(section, pa.int32()), "start_char": pa.array(at, pa.int64()), "n_chars": pa.array(chars, pa.int64()), "tokens": pa.array(n, pa.float64())})


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = RULE) -> DataFrame:
    """(doc_id, section, start_char, n_chars, tokens): a row for each line of each document, in characters of the text.

    `tokens` of a document add up to the tokens of its whole text under every rule.  A null or empty text has one
    empty section with no tokens; a null doc_id stays null; repeated rows repeat; extra columns are ignored; an empty
    table gives no rows.
    """
    if rule not in ("start", "end", "share"):
        raise ValueError(f"no such rule: {rule}")
    out = keyed_texts(docs).mapInArrow(_counts(path or default_path(), rule), "_id long, section int, start_char long, n_chars long, tokens double")
    return out.select(restore_id("_id").alias("doc_id"), "section", "start_char", "n_chars", "tokens")


def field_tokens(df: DataFrame, fields: list[str], key: str, path: str | None = None, rule: str = RULE) -> DataFrame:
    """(key, field, tokens) of every row and field: the fields of a row, joined by line ends, are encoded as one document; tokens by field.

    A null field counts as empty.  Line ends inside a field are sections of that field, so a field's tokens are the sum
    over its sections.  Rows have numbers of their own: rows that repeat a key have rows of their own in the result, a null
    key stays null, and the key keeps its type.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    ends = [F.size(F.split(F.coalesce(F.col(f).cast("string"), F.lit("")), "\n", -1)) for f in fields]
    joined = stage_table(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), text.alias("text"), F.array(*ends).alias("lines")), "fields")
    lines = F.transform(F.sequence(F.lit(0), F.lit(len(fields) - 1)), lambda i: F.aggregate(F.slice("lines", 1, i + 1), F.lit(0), lambda a, x: a + x))
    spans = joined.select("row", "key", F.posexplode(lines).alias("f", "until"), F.col("lines").alias("l")).select("row", "key", "f", "until", (F.col("until") - F.element_at("l", F.col("f") + 1)).alias("since"))
    counts = section_tokens(joined.select(F.col("row").alias("doc_id"), "text"), path, rule)
    on = (spans.row == counts.doc_id) & (counts.section >= spans.since) & (counts.section < spans.until)
    found = spans.join(counts, on, "left").groupBy("row", "f").agg(F.first("key").alias("key"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"))
    return found.select(F.col("key").alias(key), F.element_at(F.array(*map(F.lit, fields)), F.col("f") + 1).alias("field"), "tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, section, n_chars, n_tokens) for every line of every document, crossing tokens to the line of their first character.

    As section_tokens gives them: a null or empty text has one empty line, repeated rows repeat, an empty table gives no rows.
    """
    return section_tokens(read_table(spark, sf_dir, "documents")).select("doc_id", "section", "n_chars", F.col("tokens").cast("long").alias("n_tokens"))


SQL: dict[str, str] = {}
