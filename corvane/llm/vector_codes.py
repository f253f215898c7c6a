"""Vector code compression: product codebooks learned by k-means with adaptive lower bounds.

Components become integers, vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES
entries.  Assigning a part anew in every round needs few distances: with every part its entry, its next `b`
closest entries with lower bounds of their distances, in order, and one outer bound for all other entries are kept in a table
from round to round.  After a move of the entries each bound shrinks by its entry's move, the outer one by the largest.
The distance to the part's own entry is computed exactly; a bound above it settles the part.  Uncertain parts are
verified by integer distances: within the list if the outer bound allows, else over the whole codebook.  `b` follows the number
of bounds that the round before has needed.

Codebooks are small (ENTRIES x dimensions integers) and travel with the tasks; sums of a round are added up in each
task and then by Spark.  Vectors are read and written in one pass a round and never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import batches, read_table, shared_dir, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Listed entries of a part: in the first round, and at least.
LISTED, LEAST_LISTED = 16, 2
#: Share of the parts that settle within their list for which the next list is long enough.
WITHIN = 0.95
#: Rows of a batch.
ROWS = 2000
#: Bounds are rounded down by this share, which is more than the error of all float operations on them.
_DOWN = 1 - 1e-6
_TOP = np.float16(65504)


class Step(NamedTuple):
    """What a pass over the vectors needs: the codebooks, how far entries have moved at most, and list lengths before and after."""

    books: np.ndarray  # (parts, entries, width) integers
    moves: np.ndarray | None  # (parts, entries), rounded up; None in the first pass
    held: int
    listed: int


def half_down(x: np.ndarray) -> np.ndarray:
    """Non-negative bounds as 16-bit floats that aren't above them."""
    down = np.maximum(x * _DOWN, 0)
    out = np.minimum(down, float(_TOP)).astype(np.float16)
    return np.where(out > down, np.nextafter(out, np.float16(0)), out)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integers: in doubles where every sum fits them, else in 64-bit integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, c = x.astype(kind), book.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def whole_search(x: np.ndarray, book: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """(entry, squared distance, listed entries, their distances, distance of the nearest other one) over the whole codebook."""
    d = squared(x, book)
    rows, k = np.arange(len(x)), len(book)
    own = d.argmin(axis=1)  # the first of equal ones
    best = d[rows, own]
    if k == 1:
        return own, best, np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0)), np.full(len(x), np.inf)
    d[rows, own] = -1
    order = np.argpartition(d, [listed, listed + 1], axis=1)
    near = order[:, : listed + 1]
    near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(axis=1), 1)[:, 1:]
    return own, best, near, np.sqrt(np.take_along_axis(d, near, 1)), np.sqrt(d[rows, order[:, listed + 1]])


def settle(x: np.ndarray, book: np.ndarray, moves: np.ndarray, own: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """(entry, squared distance, listed entries, bounds, outer bound, bounds needed) of one part position after a move of its entries.

    near, lower and outer are those of the round before.  `needed` counts the bounds that don't exceed the exact distance;
    where the outer bound doesn't either, it is one more than the list is long.
    """
    lower, outer = lower.astype(np.float64) - moves[near], outer.astype(np.float64) - moves.max()
    order = lower.argsort(axis=1, kind="stable")
    near, lower = np.take_along_axis(near, order, 1), np.take_along_axis(lower, order, 1)
    own, best = own.copy(), ((x - book[own]) ** 2).sum(axis=1)
    upper = np.sqrt(best) * (2 - _DOWN)
    needed = (lower <= upper[:, None]).sum(axis=1)
    whole, inside = np.flatnonzero(outer <= upper), np.flatnonzero((outer > upper) & (needed > 0))
    needed[whole] = near.shape[1] + 1
    if len(inside):
        found = np.sort(np.concatenate([own[inside, None], near[inside]], axis=1), axis=1)
        d = ((x[inside, None, :] - book[found]) ** 2).sum(axis=2)
        order = d.argsort(axis=1, kind="stable")  # of equal ones the lower index first
        found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
        own[inside], best[inside], near[inside], lower[inside] = found[:, 0], d[:, 0], found[:, 1:], np.sqrt(d[:, 1:])
    if listed < near.shape[1]:
        outer = np.minimum(outer, lower[:, listed:].min(axis=1))
        near, lower = near[:, :listed].copy(), lower[:, :listed].copy()
    if len(whole):
        own[whole], best[whole], near[whole], lower[whole], outer[whole] = whole_search(x[whole], book, near.shape[1])
    return own, best, near, lower, outer, needed


def _vectors(b: pa.RecordBatch, parts: int) -> np.ndarray:
    """(parts, rows, width) of the column x, whose lists are equally long."""
    flat = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, -1)
    return np.ascontiguousarray(flat.transpose(1, 0, 2))


def _bytes(b: pa.RecordBatch, name: str, kind: type, parts: int) -> np.ndarray:
    """(parts, rows, ...) of a binary column that holds as many values for each row."""
    return np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(b.num_rows, parts, -1).transpose(1, 0, 2)


def _packed(values: list[np.ndarray], kind: type) -> pa.Array:
    """A binary column of (parts, rows, ...)."""
    rows = np.ascontiguousarray(np.stack(values).transpose(1, 0, 2)).astype(kind)
    return pa.array([r.tobytes() for r in rows], pa.binary())


_STATE = "vec_id long, label long, x array<long>, code binary, near binary, lower binary, needed binary, error long"


def _assign(step: Step):
    """Vectors, with what the round before has left unless there was none, to vectors with their entries and bounds."""
    parts = len(step.books)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, ROWS):
            if not b.num_rows:
                continue
            x, out = _vectors(b, parts), []
            if step.moves is None:
                out = [(*whole_search(x[p], step.books[p], step.listed), np.zeros(b.num_rows, np.int64)) for p in range(parts)]
            else:
                own = _bytes(b, "code", np.uint8, parts)[:, :, 0].astype(np.int64)
                near = _bytes(b, "near", np.uint8, parts).astype(np.int64) if step.held else np.zeros((parts, b.num_rows, 0), np.int64)
                lower = _bytes(b, "lower", np.float16, parts)
                out = [settle(x[p], step.books[p], step.moves[p], own[p], near[p], lower[p][:, :-1], lower[p][:, -1], step.listed) for p in range(parts)]
            own, best, near, lower, outer, needed = (list(v) for v in zip(*out))
            lower = [half_down(np.concatenate([lo, np.minimum(hi, float(_TOP))[:, None]], axis=1)) for lo, hi in zip(lower, outer)]
            yield pa.record_batch(
                {
                    **{c: b.column(c) for c in ("vec_id", "label", "x")},
                    "code": _packed([v[:, None] for v in own], np.uint8),
                    "near": _packed(near, np.uint8),
                    "lower": _packed(lower, np.float16),
                    "needed": _packed([v[:, None] for v in needed], np.uint8),
                    "error": pa.array(np.sum(best, axis=0)),
                }
            )

    return run


def _sums(parts: int, entries: int, width: int):
    """Sums over a task: for each part position (part, entry, -1, count) and (part, entry, component, sum), and (part, -1, needed, count)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, needed = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), np.zeros((parts, 256), np.int64)
        for b in batches(rows, ROWS):
            if not b.num_rows:
                continue
            x, own, asked = _vectors(b, parts), _bytes(b, "code", np.uint8, parts)[:, :, 0], _bytes(b, "needed", np.uint8, parts)[:, :, 0]
            for p in range(parts):
                order = own[p].argsort(kind="stable")
                found, begins = np.unique(own[p][order], return_index=True)
                total[p, found] += np.add.reduceat(x[p][order], begins, axis=0)
                count[p] += np.bincount(own[p], minlength=entries)
                needed[p] += np.bincount(asked[p], minlength=256)
        for p in range(parts):
            used, asked = np.flatnonzero(count[p]), np.flatnonzero(needed[p])
            values = np.concatenate([count[p][used, None], total[p][used]], axis=1)
            at = np.tile(np.arange(-1, width), len(used))
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(len(at) + len(asked), p, np.int32)),
                    "entry": pa.array(np.concatenate([np.repeat(used, width + 1), np.full(len(asked), -1)]).astype(np.int32)),
                    "at": pa.array(np.concatenate([at, asked]).astype(np.int32)),
                    "value": pa.array(np.concatenate([values.ravel(), needed[p][asked]])),
                }
            )

    return run


def moved(books: np.ndarray, state: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codebooks, moves, counts of bounds needed) after one replacement; entries of no part stay.  The rows collected are those of the codebooks."""
    parts, entries, width = books.shape
    rows = state.select("x", "code", "needed").mapInArrow(_sums(parts, entries, width), "part int, entry int, at int, value long").groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect()
    count, total, needed = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64), np.zeros(256, np.int64)
    for part, entry, at, value in rows:
        if entry < 0:
            needed[at] += value
        elif at < 0:
            count[part, entry] = value
        else:
            total[part, entry, at] = value
    new = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
    return new, np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (2 - _DOWN), needed


def next_list(needed: np.ndarray, held: int) -> int:
    """The shortest list, of LEAST_LISTED or more, that would have settled WITHIN of the parts that their lists have settled; it never grows."""
    inside = needed[: held + 1].cumsum()
    return min(held, max(LEAST_LISTED, int(np.searchsorted(inside, WITHIN * inside[-1]))))


def _component(c: Column, scale: int) -> Column:
    return F.floor(c.cast("double") * scale).cast("long")


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def integer_vectors(embeddings: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """((vec_id, label, x), length of x): vectors without null or non-finite components as integers, filled with zeros to one length that `parts` divides."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("e")).filter(finite("e"))
    most, least, n = kept.agg(F.max(F.size("e")), F.min(F.size("e")), F.count(F.lit(1))).first()
    if not n:
        return kept.select("vec_id", "label", F.lit(None).cast("array<long>").alias("x")), 0
    length = parts * max(1, -(-most // parts))
    top = int(((1 << 62) // length) ** 0.5) // 2  # squared distances stay within 64 bits
    x = F.transform("e", lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), _component(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c.cast("double"))), scale))))
    if least < length:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("e")))
    return kept.select("vec_id", "label", x.alias("x")), length


def vector_codes(embeddings: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE, listed: int = LISTED) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    The first codebooks are the parts of the `entries` first vectors by vec_id (null ids last, equal ids by components).  Ties of
    distances go to the lower entry.  Rows that repeat a vec_id, or all of a row, are vectors of their own.  With fewer
    vectors than entries the codebooks are as long as there are vectors.  Vectors shorter than the longest, or of a length
    that `parts` doesn't divide, are filled with zeros; integers so large that squared distances would leave 64 bits
    count as the largest ones that don't.  label_error adds up the errors of equal labels, nulls together; a sum beyond 64
    bits is null.  Extra columns are ignored; a table without such vectors gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    spark = embeddings.sparkSession
    vectors, length = integer_vectors(embeddings, parts, scale)
    if not length:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    listed = max(0, min(listed, len(first) - 2))
    folder, step, state = f"{shared_dir(spark)}/stage-codes-{uuid.uuid4().hex}", Step(books, None, 0, listed), vectors
    for k in range(rounds + 1):
        # two folders in turn: what the round before has written is read while the older one is replaced
        path = f"{folder}-{k % 2}"
        state.mapInArrow(_assign(step), _STATE).write.mode("overwrite").parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if k < rounds:
            new, moves, needed = moved(step.books, state)
            step = Step(new, moves, step.listed, step.listed if k == 0 else next_list(needed, step.listed))
    text = ",".join(map(str, step.books.ravel().tolist()))
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    total = F.sum(F.col("error").cast("decimal(20,0)"))
    labels = stage_table(coded.groupBy(F.col("label").alias("_label")).agg(total.try_cast("long").alias("label_error")), "labels")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every embedding, as vector_codes gives them: vectors with null or non-finite components are left out."""
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def _sql(entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
            SELECT r, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
                SELECT s.r, s.p, c.e, CAST(list_inner_product(s.v, s.v) - 2 * list_inner_product(s.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS d FROM slices s JOIN c{k} c USING (p))
            GROUP BY r, p)"""
        )
        if k < rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (
            SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
                SELECT p, e, list(floor(total / n) ORDER BY i) AS v FROM (
                    SELECT a.p, a.e, i, sum(s.v[i]) AS total, count(*) AS n FROM a{k} a JOIN slices s USING (r, p), unnest(range(1, len(s.v) + 1)) u(i) GROUP BY ALL)
                GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)"""
            )
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
        slices AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS v FROM kept, range({parts}) t(p)),
        c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM slices WHERE r <= {entries}),
        {", ".join(steps)},
        books AS (SELECT sha256(string_agg(CAST(x::BIGINT AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, i, v[i] AS x FROM c{rounds}, unnest(range(1, len(v) + 1)) u(i))),
        coded AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM kept JOIN coded USING (r), books"""


SQL = {"op11_vector_codes": _sql()}
