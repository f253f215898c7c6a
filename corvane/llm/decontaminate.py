"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e is cut into e + 1 pieces.  A passage within edit distance e of the item leaves
at least one piece untouched, so exact hits of pieces find every candidate; Myers' bit-parallel distance verifies the
item around each hit.  The same argument holds for every run of pieces: of two halves of a run within its budget
(one less than its pieces), one is within its own.  So a hit is verified from its piece upwards through a binary
tree of runs, and nearly all chance hits end at a run of two pieces.  Texts and items are compared in lower case with runs of white space as one space.

The items are the query set: they are taken in blocks of bounded size, and each block goes over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import id_column, keyed_texts, read_table, restore_id, stage_table

#: Edits per character of an item that still count as the item.
ERROR_RATE = 0.1
#: Characters of items in a block, about; a block is sent to every executor.
BLOCK_CHARS = 2_000_000
#: Characters of a text that are searched at once; parts overlap by more than any match is long.
PART = 1 << 20


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return min(int(len(item) * rate), max(len(item) - 1, 0))


def tree_path(n: int, leaf: int) -> list[tuple[int, int]]:
    """Runs [i, j) of 2 pieces and more, but for the whole, over one of n pieces: from the smallest up, by halving."""
    out, i, j = [], 0, n
    while j - i > 1:
        middle = (i + j) // 2
        i, j = (i, middle) if leaf < middle else (middle, j)
        out.append((i, j))
    return [(i, j) for i, j in reversed(out) if j - i > 1]


class Myers:
    """Least edit distance between a pattern and any substring of a text (Myers 1999, one machine word of any length)."""

    def __init__(self, pattern: str):
        self.m, self.peq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> int:
        m, get = self.m, self.peq.get
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, least = full, 0, m, m
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least = score
                    if not least:
                        return 0
            ph = ph << 1 & full
            pv = (mh << 1 & full) | ~(xv | ph) & full
            mv = ph & xv
        return least


class PieceIndex:
    """Exact hits of all pieces of a block of items in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        self.longest = max((len(t) + e for _, t, e in self.items), default=0)
        self.myers = [Myers(t) for _, t, _ in self.items]
        self.runs: dict[tuple[int, int, int], Myers] = {}  # by item and characters, filled as needed
        found: dict[bytes, list[tuple[int, int]]] = {}
        self.above: list[dict[int, list[tuple[int, int, int]]]] = []  # of each item, by offset of a piece: (start, end, budget) of the runs over it, below the whole
        for k, (_, t, e) in enumerate(self.items):
            cut = pieces(t, e)
            ends = [at for at, _ in cut[1:]] + [len(t)]
            self.above.append({at: [(cut[i][0], ends[j - 1], j - i - 1) for i, j in tree_path(len(cut), n)] for n, (at, _) in enumerate(cut)})
            for at, p in cut:
                found.setdefault(p.encode(), []).append((k, at))
        self.tables = []  # by probe length: pieces of at least 8 bytes are probed by their first 8
        for width in range(1, 9):
            own = sorted((int.from_bytes(p[:width], "little"), p) for p in found if min(len(p), 8) == width)
            if own:
                heads = np.array([h for h, _ in own], np.uint64)
                tails = np.array([int.from_bytes(p[-width:], "little") for _, p in own], np.uint64)
                sizes = np.array([len(p) for _, p in own], np.int64)
                bits = np.zeros(1 << 20, bool)
                bits[self._slot(heads)] = True
                self.tables.append((width, heads, tails, sizes, [p for _, p in own], [found[p] for _, p in own], bits))

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def hits(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item number, byte where the piece was found, characters of the item before the piece)."""
        n = len(data)
        buf = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
        two = buf[:-1] | buf[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = (four[:-4] | four[4:] << np.uint64(32))[:n]
        for width, heads, tails, sizes, texts, owners, bits in self.tables:
            values = eight if width == 8 else eight & np.uint64((1 << 8 * width) - 1)
            at = np.flatnonzero(bits[self._slot(values)])
            own = values[at]
            lo, hi = np.searchsorted(heads, own, "left"), np.searchsorted(heads, own, "right")
            while True:
                live = lo < hi
                at, lo, hi = at[live], lo[live], hi[live]
                if not len(at):
                    break
                tail = at + sizes[lo] - width
                fits = tail < n
                good = np.zeros(len(at), bool)
                good[fits] = values[tail[fits]] == tails[lo[fits]]
                for pos, k in zip(at[good].tolist(), lo[good].tolist(), strict=True):
                    p = texts[k]
                    if len(p) <= 16 or data.startswith(p, pos):
                        for item, offset in owners[k]:
                            yield item, pos, offset
                lo = lo + 1

    def _grows(self, item: int, t: str, chunk: str, pos: int, offset: int) -> bool:
        """Whether every run over a piece that was hit at pos is within its budget there."""
        for start, end, errors in self.above[item][offset]:
            own = self.runs.get((item, start, end))
            if own is None:
                own = self.runs[item, start, end] = Myers(t[start:end])
            at = pos - offset + start
            if own.best(chunk[max(at - errors, 0) : at + end - start + errors]) > errors:
                return False
        return True

    def search(self, text: str) -> dict[int, int]:
        """Least distance of every item that is in the text within its budget, by item number."""
        best: dict[int, int] = {}
        step = PART
        for part in range(0, max(len(text) - self.longest, 1), step):
            chunk = text[part : part + step + 2 * self.longest]
            data = chunk.encode()
            plain = len(data) == len(chunk)
            before = None
            tried: dict[int, list[tuple[int, int]]] = {}
            for item, pos, offset in self.hits(data):
                _, t, e = self.items[item]
                if best.get(item) == 0:
                    continue
                if not plain:
                    if before is None:
                        before = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                    pos = int(before[pos]) - 1
                if not self._grows(item, t, chunk, pos, offset):
                    continue
                lo, hi = max(pos - offset - e, 0), min(pos - offset + len(t) + e, len(chunk))
                if any(a <= lo and hi <= b for a, b in tried.get(item, ())):
                    continue
                lo, hi = max(lo - e, 0), min(hi + e, len(chunk))  # wider, so that hits a few characters off are covered too
                tried.setdefault(item, []).append((lo, hi))
                d = self.myers[item].best(chunk[lo:hi])
                if d <= e and d < best.get(item, e + 1):
                    best[item] = d
        return best


def _match(index):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in rows:
            ids, items, dist, most = [], [], [], []
            for i, text in zip(b.column("_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for k, d in own.search(normalise(text)).items():
                    ids.append(i)
                    items.append(own.items[k][0])
                    dist.append(d)
                    most.append(own.items[k][2])
            yield pa.record_batch({"_id": pa.array(ids, pa.int64()), "item_id": pa.array(items, pa.int64()), "distance": pa.array(dist, pa.int32()), "max_errors": pa.array(most, pa.int32())})

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    own, total = [], 0
    for r in benchmark.select(id_column("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.length(F.trim("text")) > 0).toLocalIterator():
        own.append((r["item_id"], normalise(r["text"])))
        total += len(own[-1][1])
        if total >= size:
            yield own
            own, total = [], 0
    if own:
        yield own


_MATCH = "_id long, item_id long, distance int, max_errors int"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, max_errors): every item that a document holds within max_errors = floor(rate * length) edits.

    Null and empty texts and items match nothing; a null doc_id or item_id stays null; repeated documents repeat
    their rows, items with equal texts all match; extra columns are ignored; an empty table on either side gives
    no rows.  Texts are searched whole, in overlapping parts.  The items go over the documents block by block: the driver
    and each executor hold one block at a time, and the rows of a block are written before the next begins.
    """
    spark, texts = docs.sparkSession, keyed_texts(docs)
    out, blocks = spark.createDataFrame([], _MATCH), _blocks(benchmark, block_chars)
    block = next(blocks, None)
    while block is not None:
        held, block = spark.sparkContext.broadcast(PieceIndex(block, rate)), next(blocks, None)
        found = texts.mapInArrow(_match(held), _MATCH)
        if block is not None:
            found = stage_table(found, "leaks")
            held.destroy()
        out = out.unionByName(found)
    return out.select(restore_id("_id").alias("doc_id"), restore_id("item_id").alias("item_id"), "distance", "max_errors")


def _holds(held):
    def run(rows: Iterator) -> Iterator:
        for s in rows:
            yield s.map(lambda x: bool(held.value.search(normalise(x)))).astype(bool)

    import pandas as pd

    run.__annotations__ = {"rows": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "boolean")(F.coalesce(F.col("text").cast("string"), F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows that hold an item; all columns stay.

    A row is judged by its own text, whatever its id; null and empty texts hold nothing and stay, repeated rows share the
    decision, and an empty benchmark takes nothing away.  Blocks of items go one after another, as in leaks: what one
    leaves is written and is the next one's input.
    """
    blocks = _blocks(benchmark, block_chars)
    block = next(blocks, None)
    while block is not None:
        held, block = docs.sparkSession.sparkContext.broadcast(PieceIndex(block, rate)), next(blocks, None)
        docs = docs.filter(~_holds(held))
        if block is not None:
            docs = stage_table(docs, "clean")
            held.destroy()
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, max_errors) of every document that holds an item, as leaks gives them: null and empty texts hold nothing."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
