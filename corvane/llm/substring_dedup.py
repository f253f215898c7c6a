"""Substring dedup over a compacted De Bruijn graph of word windows.

An edge of the graph is a window of K consecutive words (a k-mer of word tokens), its nodes are its first and last K - 1
words.  The graph is built from the edges that occur at two places or more and is compacted in three rounds of joins:

1. windows of one document that have the same least run of M words at the same place follow each other without a
   branch, so they travel as one row, a local path.  Local paths meet by that run (their anchor): equal paths are
   repeats of the first of them, with its place as source; where an anchor has several different paths the graph
   branches near it, and only those paths are opened into single windows, which meet by a 128-bit key;
2. an edge is named by the place where it occurs first, so an occurrence of two consecutive edges is a pair of places.
   A pair that jumps (its second place isn't the one after the first) leaves a node that has another way out or enters
   one that has another way in.  The jumps are joined to all other pairs: what is left are nonbranching paths, and each
   becomes one span (document, start, windows, source document, source start);
3. the spans are verified by source coordinates: the words at both places are digested and the digests joined; a span
   whose words differ removes nothing.

Every decision looks at places (doc_id, word number), never at what is left of a text, so the order of removal does not
matter.  A word goes if a repeated window covers it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Words, keyed_texts, mix, raw_texts, read_table, restore_id, runs_of, signed, slices, words_of

#: Words of a window, and of the runs of which the one with the least key is its anchor.
K, M = 20, 8
#: Different paths of one anchor that travel from a batch under the anchor's key.  If it has more, the anchor is known to
#: branch, and its further paths travel by keys of their own.
CROWD = 8
#: Windows of a source after which a path is cut in any case, and parts into which its copies are dealt.
STRETCH, SALTS = 512, 4


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every window of `width` values."""
    at, span = np.arange(len(x)), 1
    low = x
    while span < width:
        step = min(span, width - span)
        left, right = low[: len(low) - step], low[step:]
        take = right < left
        low = np.where(take, right, left)
        at = np.where(take, at[step:], at[: len(at) - step])
        span += step
    return at


def local_paths(words: Words, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(anchor, key, text, first window, windows) of the local paths of several texts; windows are numbered in their text."""
    n = len(words.lo) - k + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = text[:n] == text[k - 1 :]
    grams = runs_of(words.lo, m)
    least = _sliding_least(grams, k - m + 1)
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([np.cumsum(inside)[start] - 1, [inside.sum()]]))
    window = runs_of(words.hi, k)
    # the first and the last window of a local path overlap, so they hold all of its words
    key = mix(window[start] * np.uint64(0x9E3779B97F4A7C15) + window[start + size - 1] + size.astype(np.uint64))
    return grams[least[start]], key, text[start], start - words.bounds[text[start]], size


_ROWS = "open boolean, a long, b long, _id long, start int, n int, src_id long, src_start int"


def _emit(a: np.ndarray, b: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray, crowd: int) -> pa.RecordBatch:
    """Rows of a batch; of rows with equal keys only the first place still has to meet the rest of the corpus.

    The others know their source already.  They, and the paths beyond `crowd` of an anchor, travel under routes of their
    own, so that the rows of a very frequent anchor do not end up in one task.
    """
    order = np.lexsort((start, ids, b, a))
    a, b, ids, start, n = (x[order] for x in (a, b, ids, start, n))
    at = np.arange(len(a))
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    first = new_a.copy()
    first[1:] |= b[1:] != b[:-1]
    source = np.maximum.accumulate(np.where(first, at, 0))
    same = (ids == ids[source]) & (start == start[source])  # rows that repeat a document
    known = ~first & ~same
    nth = np.cumsum(first) - 1
    nth -= nth[np.maximum.accumulate(np.where(new_a, at, 0))]
    beyond = ~known & (nth >= crowd)
    a, b = np.where(known, np.uint64(0), a), np.where(known, np.uint64(0), b)
    return pa.record_batch({
        "open": pa.array(beyond), "a": signed(a), "b": signed(b), "_id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()),
        "src_id": pa.array(ids[source], pa.int64(), mask=~known), "src_start": pa.array(start[source], pa.int32(), mask=~known),
    })


def _paths(k: int, m: int, crowd: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column("_id").to_numpy()
            for at, texts in slices(b.column("text")):
                a, key, text, start, n = local_paths(words_of(texts), k, m)
                if len(a):
                    yield _emit(a, key, ids[at + text], start, n, crowd)

    return run


_FOUND = "_id long, start int, n int, src_id long, src_start int"


def _later(branches: bool) -> Callable:
    """Over rows in the order of (a, b, place): rows whose key came before, with the first place as source.

    With branches, also the first place of each key (src null) where one `a` has several keys, and rows marked open.
    State: one key and place.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key of the last row
        first = (0, 0, 0)  # id, start, n of that key's first place
        waiting = several = False  # whether `first` is the only key of its `a` so far; whether there were more
        for batch in rows:
            if not batch.num_rows:
                continue
            col = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("a", "b", "_id", "start", "n", "open")}
            known = batch.column("src_id").is_valid().to_numpy(zero_copy_only=False)
            out = [tuple(batch.column(c).filter(pa.array(known)).to_numpy(zero_copy_only=False) for c in ("_id", "start", "n", "src_id", "src_start"))]
            opened: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [tuple(col[x][col["open"]] for x in ("_id", "start", "n"))]
            a, b, ids, start, n = (col[x][~known & ~col["open"]] for x in ("a", "b", "_id", "start", "n"))
            if len(a):
                new_a, new_key = np.ones(len(a), bool), np.ones(len(a), bool)
                new_a[1:] = a[1:] != a[:-1]
                new_key[1:] = new_a[1:] | (b[1:] != b[:-1])
                new_a[0] = last is None or a[0] != last[0]
                new_key[0] = new_a[0] or b[0] != last[1]
                at = np.maximum.accumulate(np.where(new_key, np.arange(len(a)), -1))
                s_id = np.where(at < 0, first[0], ids[at])
                s_start = np.where(at < 0, first[1], start[at])
                repeat = ~new_key & ((ids != s_id) | (start != s_start))
                out.append((ids[repeat], start[repeat], n[repeat], s_id[repeat], s_start[repeat]))
                if branches:
                    group = np.cumsum(new_a)  # 0: the group that the last batch left open
                    keys = np.bincount(group[new_key], minlength=group[-1] + 1)
                    if keys[0] and last is not None:
                        if waiting:
                            opened.append(tuple(np.array([x]) for x in first))
                        several, waiting = True, False
                    many = keys > 1
                    many[0] = several and not new_a[0]
                    take = new_key & many[group]
                    opened.append((ids[take], start[take], n[take]))
                    if group[-1]:
                        several, waiting = bool(many[group[-1]]), not many[group[-1]]
                if at[-1] >= 0:
                    first = (int(ids[at[-1]]), int(start[at[-1]]), int(n[at[-1]]))
                last = (a[-1], b[-1])
            i, s, m, si, ss = (np.concatenate(x) for x in zip(*out, strict=True))
            o_i, o_s, o_n = (np.concatenate(x) for x in zip(*opened, strict=True))
            mask = np.concatenate([np.zeros(len(i), bool), np.ones(len(o_i), bool)])
            yield pa.record_batch({
                "_id": pa.array(np.concatenate([i, o_i]).astype(np.int64)), "start": pa.array(np.concatenate([s, o_s]).astype(np.int32)), "n": pa.array(np.concatenate([m, o_n]).astype(np.int32)),
                "src_id": pa.array(np.concatenate([si, o_i]).astype(np.int64), mask=mask), "src_start": pa.array(np.concatenate([ss, o_s]).astype(np.int32), mask=mask),
            })

    return run


def _meet(rows: DataFrame, branches: bool) -> DataFrame:
    route = F.when(F.col("src_id").isNotNull(), F.xxhash64("_id", "start")).when(F.col("open"), F.xxhash64("a", "b")).otherwise(F.col("a"))
    return rows.repartition(route).sortWithinPartitions("a", "b", "_id", "start").mapInArrow(_later(branches), _FOUND)


def _lists(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """(row, *fields) of a list of structs, one entry for each struct; a null list has none."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return row, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _each(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, value) for starts[e], starts[e] + 1, ... sizes[e] of them."""
    entry = np.repeat(np.arange(len(sizes)), sizes)
    return entry, starts[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(k: int):
    """Opened paths of a document as single windows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column("_id").to_numpy()
            for first, texts in slices(b.column("text")):
                words = words_of(texts)
                row, start, n = _lists(b.column("opened").slice(first, len(texts)), "start", "n")
                entry, window = _each(start.astype(np.int64), n.astype(np.int64))
                at = np.unique(window + words.bounds[row[entry]])
                text = np.searchsorted(words.bounds, at, "right") - 1
                fits = at + k <= words.bounds[text + 1]  # rows of a repeated id may be shorter than the one that asked
                at, text = at[fits], text[fits]
                if len(at):
                    yield _emit(runs_of(words.lo, k)[at], runs_of(words.hi, k)[at], ids[first + text], at - words.bounds[text], np.ones(len(at), np.int64), len(at))

    return run


def repeated_windows(docs: DataFrame, k: int = K, m: int = M, crowd: int = CROWD) -> DataFrame:
    """(_id, start, n, src_id, src_start): runs of n windows from word `start`, which also start earlier, at the source."""
    texts = keyed_texts(docs)
    met = _meet(texts.mapInArrow(_paths(k, m, crowd), _ROWS), branches=True)
    opened = met.filter("src_id IS NULL").groupBy("_id").agg(F.collect_list(F.struct("start", "n")).alias("opened"))
    windows = texts.join(opened.hint("shuffle_hash"), "_id").mapInArrow(_windows(k), _ROWS)
    return met.filter("src_id IS NOT NULL").unionByName(_meet(windows, branches=False))


_LINES = "src_id long, stretch int, salt int, cut boolean, a int, z int, _id long, shift int"


def _follow(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs in the order of (_id, start): lines of runs that follow each other here and at their source, and cuts.

    A line is the part a to z of its source, found at `shift` places further on in _id; lines are dealt by stretches of the
    source.  Where a run ends and the next one has another source, the graph branches: one way more leaves the place
    where the first goes on, and one more enters the place of the second.  Both are cuts.  State: the last line.
    """
    kept = [np.zeros(0, np.int64)] * 5

    def rows_of(lines: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        ids, start, n, sid, sst = lines
        first = sst // STRETCH
        entry, stretch = _each(first, (sst + n - 1) // STRETCH - first + 1)
        a, z = np.maximum(sst[entry], stretch * STRETCH), np.minimum((sst + n)[entry], (stretch + 1) * STRETCH)
        salt = (mix(ids[entry].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int64)
        cuts = np.unique(cuts, axis=0)
        c_id, c_at = (np.repeat(x, SALTS) for x in (cuts[:, 0], cuts[:, 1]))
        c_salt, none = np.tile(np.arange(SALTS), len(cuts)), np.zeros(len(cuts) * SALTS, np.int64)
        both = [np.concatenate(x) for x in ((sid[entry], c_id), (stretch, c_at // STRETCH), (salt, c_salt), (np.zeros(len(entry), bool), none == 0), (a, c_at), (z, none), (ids[entry], none), ((start - sst)[entry], none))]
        return pa.record_batch({c.split()[0]: pa.array(x.astype({"long": np.int64, "int": np.int32, "boolean": bool}[c.split()[1]])) for c, x in zip(_LINES.split(", "), both, strict=True)})

    for batch in rows:
        ids, start, n, sid, sst = (np.concatenate([k, batch.column(c).to_numpy().astype(np.int64)]) for k, c in zip(kept, ("_id", "start", "n", "src_id", "src_start"), strict=True))
        if not len(ids):
            continue
        level = (ids[1:] == ids[:-1]) & (sid[1:] == sid[:-1]) & ((start - sst)[1:] == (start - sst)[:-1])
        new = np.ones(len(ids), bool)
        new[1:] = ~(level & ((start + n)[1:] <= (start + n)[:-1]))  # a run again, of rows that repeat a document
        ids, start, n, sid, sst = (x[new] for x in (ids, start, n, sid, sst))
        joins = (ids[1:] == ids[:-1]) & (start[1:] == (start + n)[:-1])
        straight = joins & (sid[1:] == sid[:-1]) & (sst[1:] == (sst + n)[:-1])
        jump = np.flatnonzero(joins & ~straight)
        cuts = np.concatenate([np.stack([sid[jump], (sst + n)[jump]], axis=1), np.stack([sid[jump + 1], sst[jump + 1]], axis=1)])
        first = np.flatnonzero(np.concatenate([[True], ~straight]))
        lines = [ids[first], start[first], np.add.reduceat(n, first), sid[first], sst[first]]
        kept = [x[-1:] for x in lines]
        yield rows_of([x[:-1] for x in lines], cuts)
    yield rows_of(kept, np.zeros((0, 2), np.int64))


_SPANS = "_id long, start int, n int, src_id long, src_start int"


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over lines and cuts in the order of (src_id, stretch, salt), cuts first: the lines cut into nonbranching paths.

    Each path goes out as a span of its document and, with a null source, once a batch as a span of the source.  State: the
    cuts of the last stretch.
    """
    held, last = np.zeros(0, np.int64), None
    for batch in rows:
        if not batch.num_rows:
            continue
        sid, stretch, salt, cut, a, z, ids, shift = (batch.column(c.split()[0]).to_numpy(zero_copy_only=False) for c in _LINES.split(", "))
        a, z = a.astype(np.int64), z.astype(np.int64)
        new = np.ones(len(sid), bool)
        new[1:] = (sid[1:] != sid[:-1]) | (stretch[1:] != stretch[:-1]) | (salt[1:] != salt[:-1])
        new[0] = last != (sid[0], stretch[0], salt[0])
        group = np.cumsum(new)  # 0: the stretch that the last batch left open
        places = np.concatenate([held, group[cut] << 32 | a[cut]])
        last, held = (sid[-1], stretch[-1], salt[-1]), places[places >> 32 == group[-1]] & 0xFFFFFFFF
        a, z, group, sid, ids, shift = (x[~cut] for x in (a, z, group, sid, ids, shift))
        places = np.unique(places)
        lo, hi = np.searchsorted(places, group << 32 | a, "right"), np.searchsorted(places, group << 32 | z, "left")
        entry, nth = _each(np.zeros(len(a), np.int64), hi - lo + 1)
        begins = np.where(nth == 0, a[entry], places[np.minimum(lo[entry] + nth - 1, max(len(places) - 1, 0))] & 0xFFFFFFFF if len(places) else a[entry])
        ends = np.append(begins[1:], 0)
        closing = nth == (hi - lo)[entry]
        ends[closing] = z[entry[closing]]
        own = [ids[entry], begins + shift[entry], ends - begins, sid[entry], begins]
        there = np.unique(np.stack([sid[entry], begins, ends - begins], axis=1), axis=0)
        none = np.concatenate([np.zeros(len(entry), bool), np.ones(len(there), bool)])
        both = [np.concatenate(x) for x in ((own[0], there[:, 0]), (own[1], there[:, 1]), (own[2], there[:, 2]), (own[3], there[:, 0]), (own[4], there[:, 1]))]
        yield pa.record_batch({c.split()[0]: pa.array(x.astype(np.int64 if "long" in c else np.int32), mask=none if k > 2 else None) for k, (c, x) in enumerate(zip(_SPANS.split(", "), both, strict=True))})


def compacted(runs: DataFrame) -> DataFrame:
    """(_id, start, n, src_id, src_start): nonbranching paths of repeated windows as spans; with a null source, the spans of the sources.

    Two joins by sorted shuffles: of the runs of each document with each other, and of the lines with the cuts on their
    source.  Lines of one stretch of a very frequent source are spread by salts, its cuts go to all of them.
    """
    lines = runs.repartition("_id").sortWithinPartitions("_id", "start", "src_id", "src_start", "n").mapInArrow(_follow, _LINES)
    return lines.repartition("src_id", "stretch", "salt").sortWithinPartitions("src_id", "stretch", "salt", F.col("cut").desc()).mapInArrow(_cut, _SPANS)


_DIGESTS = "_id long, start int, n int, src_id long, src_start int, digest binary"


def _digest(k: int):
    """The asked spans of a text with a digest of their words; a span that isn't wholly in the text gets none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts, asked = raw_texts(b.column("text")), b.column("asked")
            row, start, n, src_id, src_start = _lists(asked, "start", "n", "src_id", "src_start")
            ids, out, split, held = b.column("_id").to_numpy(), [], -1, []
            for r, s, m in zip(row.tolist(), start.tolist(), n.tolist(), strict=True):
                if r != split:
                    split, held = r, texts[r].split()
                own = held[s : s + m + k - 1]
                out.append(hashlib.blake2b(b" ".join(own), digest_size=16).digest() if len(own) == m + k - 1 else None)
            flat = asked.flatten()
            yield pa.record_batch({"_id": pa.array(ids[row], pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()), "src_id": flat.field("src_id"), "src_start": flat.field("src_start"), "digest": pa.array(out, pa.binary())})

    return run


def verified(spans: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """The spans whose words are those at their source; `spans` also holds the spans of the sources, with a null source."""
    asked = spans.groupBy("_id").agg(F.collect_set(F.struct("start", "n", "src_id", "src_start")).alias("asked"))
    found = keyed_texts(docs).join(asked.hint("shuffle_hash"), "_id").mapInArrow(_digest(k), _DIGESTS).filter("digest IS NOT NULL")
    # rebalanced, so that the join deals both sides itself and Spark can split the copies of a very frequent span
    there = found.filter("src_id IS NULL").select(F.col("_id").alias("src_id"), F.col("start").alias("src_start"), "n", "digest").distinct().hint("rebalance")
    return found.filter("src_id IS NOT NULL").join(there, ["src_id", "src_start", "n", "digest"], "left_semi").select("_id", "start", "n", "src_id", "src_start")


_KEPT = "_id long, n_words long, n_removed long, n_spans long, longest_span long, kept string"


def _keep(k: int, digest: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: dict[str, list] = {c.split()[0]: [] for c in _KEPT.split(", ")}
            for i, text, spans in zip(b.column("_id").to_pylist(), raw_texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or []:
                    if s["start"] < len(words):
                        gone[s["start"]] += 1
                        gone[min(s["start"] + s["n"] + k - 1, len(words))] -= 1
                here = np.cumsum(gone[:-1]) > 0
                left = np.flatnonzero(~here).tolist() if spans else None
                edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]])))
                lengths = edges[1::2] - edges[::2]
                kept = b" ".join(words if left is None else map(words.__getitem__, left))
                for name, v in zip(out, (i, len(words), 0 if left is None else len(words) - len(left), len(lengths), int(lengths.max(initial=0)), hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    out[name].append(v)
            yield pa.record_batch({"_id": b.column("_id")} | {c: pa.array(v, pa.string() if c == "kept" else pa.int64()) for c, v in out.items() if c != "_id"})

    return run


def substring_dedup(docs: DataFrame, k: int = K, m: int = M, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, longest_span, kept): kept words of each document, joined by one space.

    `kept` is their SHA-256 with digest.  Null and empty texts have no words; texts of fewer than k words lose none.  Of
    equal windows the one at the smallest (doc_id, word) stays, in full; windows of one document may overlap.  A null
    doc_id comes first and stays null.  doc_id names a document: rows that repeat an id with the same text are at the
    same place and do not delete each other; where texts differ under one id, repeats found at a place of that id
    are taken from every row of it.  n_spans and longest_span are the runs of removed words.  Extra columns are ignored;
    an empty table gives no rows.
    """
    own = verified(compacted(repeated_windows(docs, k, m)), docs, k).groupBy("_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    out = keyed_texts(docs).join(own.hint("shuffle_hash"), "_id", "left").mapInArrow(_keep(k, digest), _KEPT)
    return out.select(restore_id("_id").alias("doc_id"), "n_words", "n_removed", "n_spans", "longest_span", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_spans, longest_span) of every document, as substring_dedup gives them: nulls and empty texts have no words, repeated ids are one document."""
    out = substring_dedup(read_table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"), "n_spans", "longest_span")


SQL: dict[str, str] = {}
