"""Byte-level BPE with a segment tree over adjacent pair ranks.

The leaves of the tree are the symbols of one piece of text, each with the key (rank of its pair with the next symbol,
position); every inner node holds the least key below it.  So the root names the leftmost pair of lowest rank.  A merge
changes three leaves, which costs three paths to the root; merging ends when the root holds no pair.

Pieces of up to 32 bytes, nearly all, go through one array of trees per width, many pieces at a time; longer pieces
go through :class:`RankTree`, one at a time.  Both run the same steps.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corvane.llm.common import batches, keyed_texts, read_table, restore_id

NONE = 1 << 62
#: Pieces whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 250_000
#: Characters of a text that are cut into pieces at once.
SEGMENT = 1 << 19

# Unicode white space, and the pattern that cuts text before byte-level merges.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_BLANK = regex.compile(f"[{SPACE}]")
#: Below U+0558 all Unicode versions agree on what is a letter or a digit.
LATE = regex.compile("[^\x00-\u0557]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """A character of the right class for every character that the tokenizers library classes otherwise than `regex` does.

    The two libraries follow different versions of Unicode, so the installed ones are compared, once in a process.
    """
    from tokenizers import Regex, pre_tokenizers

    kinds = [("a", "L"), ("1", "N")]
    cutters = [pre_tokenizers.Split(Regex(rf"\p{{{k}}}"), "isolated") for _, k in kinds]
    tests = [regex.compile(rf"\p{{{k}}}") for _, k in kinds]
    out: dict[int, str] = {}
    for lo in range(0x500, 0x110000, 0x400):
        chars = [chr(c) for c in range(lo, min(lo + 0x400, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join("\x01" + c for c in chars)  # every second character; a match stands alone
        alone = [{span[0] for part, span in cut.pre_tokenize_str(text) if len(part) == 1 and part != "\x01"} for cut in cutters]
        for i, c in enumerate(chars):
            theirs = [2 * i + 1 in a for a in alone]
            if theirs != [bool(t.match(c)) for t in tests]:
                out[ord(c)] = "a" if theirs[0] else "1" if theirs[1] else "!"
    return out


def cut_pieces(text: str) -> list[str]:
    """The pieces of a text between which no merge happens, as the tokenizers library cuts them."""
    if text.isascii() or not LATE.search(text):
        return _PIECES.findall(text)
    return [text[m.start() : m.end()] for m in _PIECES.finditer(text.translate(stand_ins()))]


class RankTree:
    """Segment tree over the pairs of one piece, for pieces of any length."""

    def __init__(self, symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.symbols, self.merges, n = symbols, merges, len(symbols)
        self.width = 1 << max(1, (n - 1).bit_length())
        self.after, self.before = [*range(1, n + 1)], [*range(-1, n - 1)]
        self.tree: list[tuple[int, int]] = [(NONE, 0)] * (2 * self.width)
        for i in range(n - 1):
            self.tree[self.width + i] = self._key(i)
        for k in range(self.width - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _key(self, i: int) -> tuple[int, int]:
        j = self.after[i]
        found = self.merges.get((self.symbols[i], self.symbols[j])) if j < len(self.symbols) else None
        return (found[0], i) if found else (NONE, 0)

    def _set(self, i: int, key: tuple[int, int]) -> None:
        k = self.width + i
        self.tree[k] = key
        while k > 1:
            k >>= 1
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def merge(self) -> list[int]:
        while self.tree[1][0] != NONE:
            i = self.tree[1][1]
            j = self.after[i]
            self.symbols[i] = self.merges[self.symbols[i], self.symbols[j]][1]
            self.after[i] = k = self.after[j]
            if k < len(self.symbols):
                self.before[k] = i
            self._set(j, (NONE, 0))
            self._set(i, self._key(i))
            if self.before[i] >= 0:
                self._set(self.before[i], self._key(self.before[i]))
        out, i = [], 0
        while i < len(self.symbols):
            out.append(self.symbols[i])
            i = self.after[i]
        return out


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file in the JSON format of the tokenizers library."""

    def __init__(self, path: str, match_added: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = byte_symbols()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        ordered = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(x, np.int64) for x in zip(*ordered, strict=True))
        self.merged_id = np.zeros(len(ordered), np.int64)
        self.merged_id[self.pair_ranks] = self.pair_ids
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.decimals = [str(i) for i in range(size)]
        self.added = added if match_added else {}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    # ------------------------------------------------ merging

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE >> 8 where it doesn't merge."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE >> 8)

    def merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of 1 to `width` bytes (a power of two, at most 128), by one tree for each, all in step."""
        n, top = len(pieces), NONE >> 8 << 8
        size = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        cols = np.arange(width)
        real = cols < size[:, None]
        sym = np.where(real, self.byte_ids[flat], -1)
        after = np.where(cols + 1 < size[:, None], cols + 1, width) * np.ones((n, 1), np.int64)
        before = np.tile(cols - 1, (n, 1))
        tree = np.full((n, 2 * width), top, np.int64)
        pair = cols[:-1] + 1 < size[:, None]
        r, i = np.nonzero(pair)
        tree[r, width + i] = self._ranks(sym[r, i], sym[r, i + 1]) << 8 | i
        for level in range(width.bit_length() - 2, -1, -1):
            k = np.arange(1 << level, 2 << level)
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        r = np.flatnonzero(tree[:, 1] < top)
        while len(r):
            root = tree[r, 1]
            i = root & 255
            j = after[r, i]
            sym[r, i] = self.merged_id[root >> 8]
            sym[r, j] = -1
            k = after[r, j]
            after[r, i] = k
            right, left = k < width, before[r, i]
            before[r[right], k[right]] = i[right]
            tree[r, width + j] = top
            tree[r, width + i] = top
            rr, ii = r[right], i[right]
            tree[rr, width + ii] = np.minimum(self._ranks(sym[rr, ii], sym[rr, k[right]]) << 8 | ii, top)
            has = left >= 0
            rl, ll = r[has], left[has]
            tree[rl, width + ll] = np.minimum(self._ranks(sym[rl, ll], sym[rl, i[has]]) << 8 | ll, top)
            paths = [(r, width + i), (r, width + j), (rl, width + ll)]
            for _ in range(width.bit_length() - 1):
                paths = [(rows, node >> 1) for rows, node in paths]
                for rows, node in paths:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            r = r[tree[r, 1] < top]
        alive = sym >= 0
        ids, ends = sym[alive], np.cumsum(alive.sum(axis=1))
        return np.split(ids, ends[:-1])

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its ids as little-endian 32-bit integers."""
        by_width: dict[int, list[tuple[str, bytes]]] = {8: [], 16: [], 32: []}
        for p in pieces:
            data = p.encode()
            width = 8 if len(data) <= 8 else 16 if len(data) <= 16 else 32
            if len(data) > 32:
                yield p, np.array(RankTree(self.byte_ids[np.frombuffer(data, np.uint8)].tolist(), self.merges).merge(), np.uint32).tobytes()
            else:
                by_width[width].append((p, data))
        for width, own in by_width.items():
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192]
                for (p, _), ids in zip(part, self.merge_many([d for _, d in part], width), strict=True):
                    yield p, ids.astype(np.uint32).tobytes()

    # ------------------------------------------------ texts

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        found = [cut_pieces(t) for t in texts]
        new = set().union(*found).difference(self.known) if found else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*found)
        own = dict(self.encode_pieces(list(new)))
        self.known.update((p, ids) for p, ids in own.items() if len(p) <= 64)
        look = self.known if all(len(p) <= 64 for p in own) else self.known | own
        return [np.frombuffer(b"".join(map(look.__getitem__, pieces)), np.uint32) for pieces in found]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of short texts, together."""
        if self.splitter is None or not any(t in x for t in self.added for x in texts):
            return self._ordinary(texts)
        return [np.concatenate([*self._parts(x), np.zeros(0, np.uint32)]) for x in texts]

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        for k, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if k % 2:
                yield np.array([self.added[part]], np.uint32)
            elif part:
                for segment in segments(part):
                    yield from self._ordinary([segment])

    def encode_parts(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text of any length, in bounded parts."""
        yield from self._parts(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """text cut before single spaces between words, where no piece can cross, into parts of about `size` characters."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end + 1 < len(text) and not (text[end] == " " and not _BLANK.match(text[end - 1]) and not _BLANK.match(text[end + 1])):
            end += 1
        if end + 1 >= len(text):
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=4)
def load(path: str, match_added: bool = True) -> ByteBPE:
    return ByteBPE(path, match_added)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def groups(texts: list[str], size: int = 1 << 20) -> Iterator[list[int]]:
    """Row numbers of consecutive texts that have about `size` characters together; a longer text is alone."""
    own, total = [], 0
    for k, t in enumerate(texts):
        if own and total + len(t) > size:
            yield own
            own, total = [], 0
        own.append(k)
        total += len(t)
    if own:
        yield own


def _digests(path: str, match_added: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, match_added)
        for b in rows:
            texts = b.column("text").to_pylist()
            n, ids_sha, text_sha = [], [], []
            for own in groups(texts):
                parts = [[x] for x in bpe.encode_batch([texts[k] for k in own])] if len(own) > 1 or len(texts[own[0]]) <= SEGMENT else [bpe.encode_parts(texts[own[0]])]
                for arrays in parts:
                    count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                    for ids in arrays:
                        listed = ids.tolist()
                        if listed:
                            of_ids.update((("," if count else "") + ",".join(map(bpe.decimals.__getitem__, listed))).encode())
                            of_text.update(bpe.decode(listed))
                            count += len(listed)
                    n.append(count)
                    ids_sha.append(of_ids.hexdigest())
                    text_sha.append(of_text.hexdigest())
            yield pa.record_batch({"_id": b.column("_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return run


def bpe_encode(docs: DataFrame, path: str | None = None, match_added: bool = True, name: str = "_ids") -> DataFrame:
    """docs with `name`, the token ids of the whole text (null counts as empty); every row and column stays.

    Rows leave in batches of 256, with their ids in one flat array, so a task holds the ids of few texts at a time.
    """
    where, columns = path or default_path(), docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(where, match_added)
        for b in batches(rows, 256):
            texts = [x or "" for x in b.column(columns.index("text")).to_pylist()]
            ids = [x for own in groups(texts) for x in (bpe.encode_batch([texts[k] for k in own]) if len(own) > 1 or len(texts[own[0]]) <= SEGMENT else [np.concatenate([*bpe.encode_parts(texts[own[0]]), np.zeros(0, np.uint32)])])]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, listed], [*columns, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(IntegerType()))]))


def bpe_decode(encoded: DataFrame, path: str | None = None, ids: str = "_ids") -> DataFrame:
    """encoded with _decoded, the text of the ids."""
    where = path or default_path()

    def run(rows: Iterator) -> Iterator:
        bpe = load(where)
        for s in rows:
            yield s.map(lambda x: bpe.decode([] if x is None else list(x)).decode("utf-8", "replace"))

    import pandas as pd

    run.__annotations__ = {"rows": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn("_decoded", F.pandas_udf(run, "string")(F.col(ids)))


def bpe_digests(docs: DataFrame, path: str | None = None, match_added: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    The ids are those of the tokenizers library with the same file and add_special_tokens=False; strings of added
    tokens in a text match as such unless match_added is false.  A null text counts as empty (no tokens, digests of
    the empty string), a null doc_id stays null, repeated rows repeat, extra columns are ignored, an empty table gives no
    rows.  Texts of any length go through in parts of SEGMENT characters, so memory is bounded but for one piece
    without white space.
    """
    out = keyed_texts(docs).mapInArrow(_digests(path or default_path(), match_added), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(restore_id("_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, as bpe_digests gives them: a null text counts as empty."""
    return bpe_digests(read_table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
