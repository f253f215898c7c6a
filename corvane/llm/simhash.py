"""SimHash near-dedup over a grid of bit counts.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 values of the text's shingles.  Equal
fingerprints are one class, so only distinct ones go on.  The 64 bits are cut into segments of two, and a fingerprint is
mapped to the vector of its segments' bit counts.  Changing one bit changes one count by one, so the Manhattan
distance of two vectors is at most the Hamming distance of their fingerprints.

Fingerprints at BITS or fewer differing bits have, in one half of the segments, vectors at a Manhattan distance of at
most BITS // 2.  The cells of the grid are the possible vectors of a half; every fingerprint reaches the cells within half of
that distance, so two such vectors meet in a cell between them: a range join of the grid with itself by equal keys.
What meets in a cell is compared by the whole vectors first, as the lower bound, and then by the fingerprints
themselves.  A cell gives a spanning forest of its links, not its pairs; a crowded cell is dealt into salted
blocks, and every two blocks are compared.

A vector of counts is held as a word in which each segment's set bits are moved to its low end (00, 01, 11): the Manhattan
distance of two vectors is then the number of bits in which their words differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import keyed_texts, raw_texts, read_table, restore_id, signed, slices, stage_table
from corvane.llm.near_dedup import components

SHINGLE, HASH_SEED = 4, 42
#: Differing bits of a link, at most.
BITS = 4
#: Fingerprints of a block of a crowded cell, about.
BLOCK = 2048
#: Members of a cell up to which its pairs are compared side by side with those of other cells.
SMALL = 6
#: Bytes of text that are hashed at once.
GROUP = 1 << 20
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle of a lower-cased text, repeats included: `size` words joined by one space; of fewer words, of all of them."""
    words = text.split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins, k = np.concatenate([[0], ends[:-1] + 1]), min(size, len(words))
    return [xxhash.xxh64_intdigest(line[a:z], HASH_SEED) for a, z in zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    for at, part in slices(texts, GROUP):
        hashes = [shingle_hashes(t, size) for t in raw_texts(pc.ascii_lower(part))]
        sizes = np.array([len(h) for h in hashes])
        found = np.flatnonzero(sizes)
        if not len(found):
            continue
        flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(sizes.sum()))
        begins = np.concatenate([[0], np.cumsum(sizes[found])[:-1]])
        ones = np.zeros((len(found), 64), np.int64)
        for lo in range(0, len(flat), 1 << 16):  # counted in blocks, so that a long text needs no more memory than a short one
            bits = np.unpackbits(flat[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first, last = np.searchsorted(begins, [lo, lo + len(bits) - 1], "right") - 1
            cuts = np.maximum(begins[first : last + 1] - lo, 0)
            ones[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        out[at + found] = np.packbits(2 * ones > sizes[found, None], axis=1).view(">u8").ravel()
    return out


def _marked(size: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield pa.record_batch({"_id": b.column("_id"), "fp": signed(fingerprints(b.column("text"), size))})

    return run


def counts(fp: np.ndarray) -> np.ndarray:
    """The words of the vectors of counts: every two bits with their ones at the low end."""
    high = fp >> _ONE
    return (fp | high) & _LOW | (fp & high & _LOW) << _ONE


def cells(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): for each half of the vectors, the cells that each row reaches; a cell's key is the half's word, with the half on top."""
    reach, word = -(-(bits // 2) // 2), counts(fp)
    rows, keys = [], []
    for half in (0, 1):
        own = word >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        row, key = np.arange(len(fp)), own
        for _ in range(reach):
            more_row, more_key = [row], [key]
            for k in range(16):
                low, high = np.uint64(1 << 2 * k), np.uint64(2 << 2 * k)
                one_up = np.where(key & low == 0, key | low, key | high)  # 00 to 01, 01 to 11, 11 stays
                one_down = np.where(key & high != 0, key & ~high, key & ~low)
                for moved in (one_up, one_down):
                    real = moved != key
                    more_row.append(row[real])
                    more_key.append(moved[real])
            row, key = np.concatenate(more_row), np.concatenate(more_key)
            if reach > 1:  # steps that lead back
                both = np.unique(np.stack([row.astype(np.uint64), key]), axis=1)
                row, key = both[0].astype(np.int64), both[1]
        rows.append(row)
        keys.append(key | np.uint64(half << 32))
    return np.concatenate(rows), np.concatenate(keys)


def _reached(bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                row, cell = cells(part, bits)
                yield pa.record_batch({"cell": signed(cell), "fp": signed(part[row])})

    return run


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Whether fingerprints differ in `bits` bits or fewer: by their counts as a lower bound first, then exactly."""
    ok = np.bitwise_count(counts(x) ^ counts(y)) <= bits
    ok[ok] = np.bitwise_count((x ^ y)[ok]) <= bits
    return ok


def forest(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fp: every fingerprint is compared with those that nothing has reached yet."""
    left, stack, out = fp, [], []
    while len(left):
        if not stack:
            stack, left = [left[0]], left[1:]
        one = stack.pop()
        found = near(left, np.broadcast_to(one, left.shape), bits)
        if found.any():
            out.append((np.full(int(found.sum()), one), left[found]))
            stack += list(left[found])
            left = left[~found]
    return tuple(np.concatenate([x[k] for x in out]) if out else fp[:0] for k in (0, 1))


def links_of_runs(fp: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs bounds[k] to bounds[k + 1]: all of those of small runs, a spanning forest of those of others."""
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small, out = (sizes <= SMALL)[run], []
    for lag in range(1, SMALL):
        i = np.flatnonzero(small[:-lag] & (run[:-lag] == run[lag:]))
        i = i[near(fp[i], fp[i + lag], bits)]
        out.append((fp[i], fp[i + lag]))
    out += [forest(fp[bounds[k] : bounds[k + 1]], bits) for k in np.flatnonzero(sizes > SMALL)]
    return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def _met(bits: int):
    """Over rows sorted by (cell, a, b): the links of each run of equal keys; a run that a batch cuts is carried to the next."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            x, y = links_of_runs(part[-1].view(np.uint64), bounds, bits)
            return pa.record_batch({"x": signed(x), "y": signed(y)})

        held = np.zeros((4, 0), np.int64)
        for b in rows:
            held = np.concatenate([held, np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("cell", "a", "b", "fp")])], axis=1)
            begins = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            if len(begins):
                yield found(held[:, : begins[-1]], np.concatenate([[0], begins]))
                held = held[:, begins[-1] :]
        if held.shape[1]:
            yield found(held, np.array([0, held.shape[1]]))

    return run


def grid_links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(x, y): links of distinct fingerprints (fp) that connect whatever is connected by links of `bits` bits or fewer."""
    if not 0 <= bits < 16:
        raise ValueError("a link differs in 0 to 15 bits")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes about fifty: dealt to all tasks first
    reached = fps.select("fp").repartition(tasks, "fp").mapInArrow(_reached(bits), "cell long, fp long")
    crowded = stage_table(reached.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 2 * block).select(F.col("cell").alias("k"), F.ceil(F.col("c") / block).cast("int").alias("blocks")), "crowded")
    dealt = reached.join(crowded, F.col("cell") == F.col("k"), "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("cell", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"), "fp")
    return dealt.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "fp").mapInArrow(_met(bits), "x long, y long").distinct()


def simhash_dedup(docs: DataFrame, bits: int = BITS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Words are runs of bytes that aren't ASCII white space, A-Z in lower case; a text of fewer words than a shingle has one
    shingle.  A null or empty text, or one of white space, has the fingerprint 0 and is linked like any other: texts with equal
    fingerprints are always linked.  component_id is the least doc_id that links reach; a null doc_id counts as the
    least and stays null.  Rows that repeat a doc_id are linked by their own texts.  Extra columns are ignored; an
    empty table gives no rows.
    """
    marked = stage_table(keyed_texts(docs).mapInArrow(_marked(size), "_id long, fp long"), "fingerprints")
    classes = stage_table(marked.groupBy("fp").agg(F.min("_id").alias("least")), "classes")
    roots = components(grid_links(classes, bits))
    # the component's least id, from the least ids of its fingerprints; tables, so that Spark can split the joins of large groups
    linked = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = stage_table(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = stage_table(linked.join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select(restore_id("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), restore_id("component").alias("component_id"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document at 4 differing bits, as simhash_dedup gives them: null and empty texts have fingerprint 0 and are linked with each other."""
    return simhash_dedup(read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
