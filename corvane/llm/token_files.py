"""Token-id files: canonical length-limited Huffman coding with independently decodable blocks.

File format.  A token store is a folder with two Parquet tables; Spark's writers commit them, so a lost executor leaves
no half file.

``code``  (id, length): the canonical code.  Codes are given out by (length, id) in ascending order, so lengths suffice.
``data``  (segment_key, first_id, n_docs, doc_ids, doc_tokens, n_tokens, n_bits, checkpoints, bits): a row is a segment of
          consecutive documents in ascending doc_id order; part files follow that order too.  `bits` holds the codes
          of all ids of the segment, most significant bit first.  `checkpoints` holds, as little-endian
          unsigned 32-bit integers, the bit offset at which every block of BLOCK ids starts, so any block decodes alone.

Codes are at most LIMIT bits long (package-merge), so one table of 2**LIMIT entries maps the next bits to an id and a
length; all blocks of a segment step through the table side by side.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import SPACE, byte_symbols
from corvane.llm.common import keyed_texts, read_table, restore_id, shared_dir, stage_table

LIMIT, BLOCK, END_ID = 16, 128, 1
#: Ids of a segment, about, and documents at most.
SEGMENT_IDS, SEGMENT_DOCS = 400_000, 4000
#: Pieces whose ids a worker remembers, ids of them and bytes; the memory is emptied when it is full.
REMEMBERED, REMEMBERED_IDS, REMEMBERED_BYTES = 1_000_000, 8_000_000, 1 << 26
#: Bytes of texts that are encoded together, about.
GROUP = 1 << 25


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- encoding


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat((starts - (ends - sizes)).astype(np.int32), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


class WordEncoder:
    """Ids by the tokenizers library, looked up by word.

    This vocabulary's normalizer maps white space to a space and its pre-tokenizer drops it, so no piece crosses ASCII
    white space and a text's ids are its words' ids in order.  The different words of a group of texts are cut together:
    words of letters and closing marks by Arrow functions, others by the library's normalizer and the pre-tokenizer's
    pattern.  Each new piece goes through the library's model; words that may hold an added token go through the
    library as they are.
    """

    # Fixed value: the pre-tokenizer's pattern.
    PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
    #: The same, with a space between words as a piece of its own, which has no ids.
    SPACED = regex.compile(PIECES + "| ")
    #: Words with other white space, or with characters on which Unicode versions differ, are cut by the library itself.
    APART = regex.compile(f"[{SPACE}]|[^\\x00-\\u0557]")
    #: Letters whose composed form is their own and whose lower case is one letter of the same range, and marks that form one piece after them.
    LETTERS, MARKS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u02af]*", ",.;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.normalize, self.cut, self.tokenize = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.symbols = byte_symbols()
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.ids, self.begin = pa.array([], pa.string()), array("I"), array("I", [0])

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece; new ones go through the library's model.  `begin` and `ids` hold their ids."""
        if len(self.pieces) > REMEMBERED or len(self.ids) > REMEMBERED_IDS or self.pieces.nbytes > REMEMBERED_BYTES:
            self._forget()
        found = pc.index_in(pieces, value_set=self.pieces)
        new = pc.unique(pieces.filter(found.is_null()))
        if not len(new):
            return found.to_numpy()
        ids, begin = self.ids, self.begin
        for p in new.to_pylist():
            if p and p != " ":
                ids.extend([t.id for t in self.tokenize(p if p.isascii() and p.isprintable() else "".join(map(self.symbols.__getitem__, p.encode())))])
            begin.append(len(ids))
        self.pieces = pa.concat_arrays([self.pieces, new])
        return pc.index_in(pieces, value_set=self.pieces).to_numpy()

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, ids): the ids of word k are sizes[k] from starts[k] on."""
        whole = np.zeros(len(words), bool)
        for x in self.added:
            whole |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        simple = pc.match_substring_regex(words, f"^{self.LETTERS}[{self.MARKS}]*$").to_numpy(zero_copy_only=False) & ~whole
        lower = pc.utf8_lower(words.filter(pa.array(simple)))
        stems = pc.utf8_rtrim(lower, characters=self.MARKS)
        marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(lower))
        stems, tails = stems.dictionary_encode(), pc.replace_substring_regex(lower.filter(marked), f"^{self.LETTERS}", "").dictionary_encode()
        rest = np.flatnonzero(~simple & ~whole)
        texts = words.take(pa.array(rest)).to_pylist()
        apart = np.array([bool(self.APART.search(x)) for x in texts], bool)
        joined = " ".join(x for x, own in zip(texts, apart, strict=True) if not own)
        found = pa.array(self.SPACED.findall(self.normalize(joined)) if joined else [], pa.string()).dictionary_encode()
        number = self._numbers(pa.concat_arrays([stems.dictionary, tails.dictionary, found.dictionary]))
        begin, known = np.array(self.begin, np.int64), np.array(self.ids, np.uint32)
        a, b = len(stems.dictionary), len(stems.dictionary) + len(tails.dictionary)

        starts, sizes, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        # a simple word is its stem and, if marked, its tail; the others are the pieces between two gaps
        pairs = np.empty((len(lower), 2), np.int64)
        pairs[:, 0] = number[stems.indices.to_numpy()]
        pairs[:, 1] = -1
        pairs[marked.to_numpy(zero_copy_only=False), 1] = number[a + tails.indices.to_numpy()]
        pieces = number[b + found.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
        gap = pc.index_in(pa.scalar(" "), value_set=self.pieces).as_py()
        gaps = np.flatnonzero(pieces == (-1 if gap is None else gap))
        for own, line in ((np.flatnonzero(simple), pairs.reshape(-1)), (rest[~apart], pieces)):
            if not len(own):
                continue
            n = np.where(line < 0, 0, begin[line + 1] - begin[line])
            ends = np.concatenate([[0], np.cumsum(n)])
            bounds = ends[::2] if line is not pieces else ends[np.concatenate([[0], gaps, [len(line)]])]
            sizes[own], starts[own] = np.diff(bounds), at + bounds[:-1]
            parts.append(known[ragged(begin[line], n)])
            at += len(parts[-1])
        alone = [(k, [t.id for p, _ in self.cut(self.normalize(x)) for t in self.tokenize(p)]) for k, x in zip(rest[apart].tolist(), (x for x, own in zip(texts, apart, strict=True) if own), strict=True)]
        alone += [(int(k), self.tokenizer.encode(words[k].as_py(), add_special_tokens=False).ids) for k in np.flatnonzero(whole)]
        for k, ids in alone:
            starts[k], sizes[k] = at, len(ids)
            parts.append(np.array(ids, np.uint32))
            at += len(ids)
        return starts, sizes, np.concatenate([*parts, np.zeros(0, np.uint32)])

    def encode(self, texts: pa.Array, step: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        starts, sizes, ids = self._words(coded.dictionary)
        own = coded.indices.to_numpy()
        n = sizes[own]
        ends = np.concatenate([[0], np.cumsum(n)])[bounds[1:]]
        parts = [ids[ragged(starts[own[at : at + step]], n[at : at + step])] for at in range(0, len(own), step)]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), ends


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _groups(column: pa.Array, size: int = GROUP) -> Iterator[pa.Array]:
    """Slices of consecutive texts that have about `size` bytes together."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, to - at)
        at = to


def _encode_ids(path: str, end_id: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.dtype("<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4")
        for b in rows:
            at = 0
            for texts in _groups(b.column("text")):
                ids, ends = enc.encode(texts)
                last = ends + np.arange(len(ends))  # places of the end ids
                out = np.empty(len(ids) + len(ends), kind)
                inside = np.ones(len(out), bool)
                inside[last] = False
                out[inside], out[last] = ids, end_id
                offsets = np.concatenate([[0], (last + 1) * kind.itemsize]).astype(np.int32)
                own = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
                part = b.slice(at, len(ends))
                at += len(ends)
                yield pa.record_batch({"_id": part.column("_id"), "_tx": part.column("_tx"), "width": pa.array([kind.itemsize] * len(ends), pa.int32()), "ids": own})

    return run


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in rows:
        for width in set(b.column("width").to_pylist()):
            own = [x for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True) if w == width]
            counts = np.bincount(np.frombuffer(b"".join(own), f"<u{width}"))
            total = np.concatenate([total, np.zeros(max(0, len(counts) - len(total)), np.int64)])
            total[: len(counts)] += counts
    used = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})


def encoded(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(_id, _tx, width, ids): ids of every text and its end id, as packed integers of `width` bytes; a stage table."""
    keyed = keyed_texts(docs).withColumn("_tx", F.xxhash64("text"))
    return stage_table(keyed.mapInArrow(_encode_ids(path or default_path(), end_id), "_id long, _tx long, width int, ids binary"), "ids", compression="zstd")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents."""
    return ids.select("width", "ids").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the code


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); a lone id gets one bit."""
    if len(counts) > 1 << limit:
        raise ValueError("too many ids for the limit")
    order = sorted(counts, key=lambda i: (counts[i], i))
    if len(order) < 2:
        return dict.fromkeys(order, 1)
    weight = np.array([counts[i] for i in order], np.float64)
    n, used = len(order), []
    packages = weight
    for _ in range(limit - 1):
        # used[k]: of the merged list of a level, which entries are single ids
        paired = packages[: len(packages) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, paired])
        rank = np.argsort(merged, kind="stable")
        used.append(rank < n)
        packages = merged[rank]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(used):
        singles = int(level[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    lengths[:take] += 1
    return {i: int(x) for i, x in zip(order, lengths, strict=True)}


class Code:
    """Canonical codes from lengths: the table of codes to write and the table of next bits to read."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT):
        self.limit = limit
        order = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        sizes = np.array([lengths[i] for i in order.tolist()], np.int64)
        n = int(order.max()) + 1 if len(order) else 1
        self.size, self.bits = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.to_id, self.to_size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
        spans = 1 << (limit - sizes)
        starts = np.cumsum(spans) - spans
        self.size[order] = sizes
        self.bits[order] = starts >> (limit - sizes)
        filled = int(spans.sum())
        self.to_id[:filled] = np.repeat(order, spans)
        self.to_size[:filled] = np.repeat(sizes, spans)

    def encode(self, ids: np.ndarray) -> tuple[int, bytes, bytes]:
        """(bits, checkpoints, bytes)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        begins = ends - size
        total = int(ends[-1]) if len(ends) else 0
        words = np.zeros(total // 32 + 3, np.uint64)
        if len(ids):
            # each code lies within 64 bits from the start of a 32-bit word; codes of a word are joined by one sum
            at, shift = begins >> np.uint64(5), np.uint64(64) - (begins & np.uint64(31)) - size
            placed = self.bits[ids] << shift
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            joined = np.bitwise_or.reduceat(placed, first)
            where = at[first].astype(np.int64)
            words[where] |= joined >> np.uint64(32)
            words[where + 1] |= joined & np.uint64(0xFFFFFFFF)
        data = words.astype(">u4").tobytes()[: (total + 7) // 8]
        return total, begins[::BLOCK].astype("<u4").tobytes(), data

    def decode(self, data: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """The n ids of a segment: step t reads id t of every block."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.uint32)
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
        mask, full = np.uint32((1 << self.limit) - 1), np.uint32(24 - self.limit)
        rows = len(at)
        for t in range(BLOCK):
            if t == n - (len(at) - 1) * BLOCK:
                rows = len(at) - 1  # the last block ends here
            at = at[:rows]
            peek = three[at >> 3] >> (full - (at & 7).astype(np.uint32)) & mask
            out[:rows, t] = self.to_id[peek]
            at = at + self.to_size[peek]
        return out.reshape(-1)[:n]


# ---------------------------------------------------------------- files

_DATA = "segment_key int, first_id long, n_docs int, doc_ids binary, doc_tokens binary, n_tokens long, n_bits long, checkpoints binary, bits binary"


def _write_segments(code):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_code = code.value
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        held = key = 0

        def flush() -> pa.RecordBatch:
            n_bits, marks, bits = own_code.encode(np.concatenate(ids).astype(np.int64))
            return pa.record_batch({
                "segment_key": pa.array([key], pa.int32()), "first_id": pa.array(doc_ids[:1], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int32()), "doc_ids": pa.array([np.array(doc_ids, "<i8").tobytes()]),
                "doc_tokens": pa.array([np.array([*map(len, ids)], "<i8").tobytes()]), "n_tokens": pa.array([held], pa.int64()), "n_bits": pa.array([n_bits], pa.int64()), "checkpoints": pa.array([marks]), "bits": pa.array([bits]),
            })

        for b in rows:
            for name, width, data in zip(b.column("_id").to_pylist(), b.column("width").to_pylist(), b.column("ids").to_pylist(), strict=True):
                doc_ids.append(name)
                ids.append(np.frombuffer(data, f"<u{width}"))
                held += len(ids[-1])
                if held >= SEGMENT_IDS or len(doc_ids) >= SEGMENT_DOCS:
                    yield flush()
                    doc_ids, ids, held, key = [], [], 0, key + 1
        if doc_ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every text (null: empty), append end_id, and write the token store; documents in ascending doc_id order.

    Texts are encoded once, into a stage table that then serves the counts and the files.  The counts have a row for each
    id of the vocabulary at most, so the code is built on the driver and sent to the executors whole.
    """
    spark = docs.sparkSession
    ids = encoded(docs, path, end_id)
    counts = {r["id"]: r["n"] for r in id_counts(ids).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame([*lengths.items()] or [(end_id, 1)], "id int, length int").coalesce(1).write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast(Code(lengths))
    ids.repartitionByRange("_id", "_tx").sortWithinPartitions("_id", "_tx").mapInArrow(_write_segments(code), _DATA).write.parquet(f"{folder}/data")


def _read_segments(code):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = code.value
        for b in rows:
            for r in b.to_pylist():
                ids = own.decode(r["bits"], r["checkpoints"], r["n_tokens"])
                sizes = np.frombuffer(r["doc_tokens"], "<i8")
                ends = np.cumsum(sizes)
                yield pa.record_batch({
                    "_id": pa.array(np.frombuffer(r["doc_ids"], "<i8")), "start": pa.array(r["base"] + ends - sizes), "n_tokens": pa.array(sizes),
                    "ids": pa.array([ids[a:z].astype("<u4").tobytes() for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary()),
                })

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start counted over the whole store."""
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(f"{folder}/code").collect()}
    code = spark.sparkContext.broadcast(Code(lengths))
    data = spark.read.schema(_DATA).parquet(f"{folder}/data").withColumn("part", F.element_at(F.split(F.col("_metadata.file_name"), "-"), 2).cast("int"))
    # part files are few: one row for each gives the ids before it, then segments count within their file
    parts = data.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment_key")) - F.col("n_tokens")
    sizes = data.select("part", "segment_key", inside.alias("inside"), F.col("n_tokens").alias("t")).join(before, "part").select("part", "segment_key", (F.col("before") + F.col("inside")).alias("base"))
    based = data.join(sizes, ["part", "segment_key"]).select("doc_ids", "doc_tokens", "n_tokens", "checkpoints", "bits", "base")
    out = based.mapInArrow(_read_segments(code), "_id long, start long, n_tokens long, ids binary")
    return out.select(restore_id("_id").alias("doc_id"), "start", "n_tokens", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    A null text counts as empty and has its end id alone; a null doc_id comes first and stays null; rows that repeat a
    doc_id follow each other by a hash of their texts; an empty table gives empty files and no rows.
    """
    import uuid

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SQL: dict[str, str] = {}
