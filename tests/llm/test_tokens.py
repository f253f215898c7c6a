import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import SF, crc_ids, sha
from corvane.llm import bpe, token_counts, token_files
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "\n\n  x", "a" * 300, "don't WE'LL it's", "naïve café 漢字 😀👍🏽", "x<|endoftext|>y", "\x1c\x1f a b　 c\x85", "1234567 ½ ²", "é́ ́", "tab\tline\r\n  end  ", "ÀÉ İ ẞ ς Σ", "a" * 40 + " " + "ab" * 50, "'s'S's", "​‍﻿᠎"]


def own_ids(text):
    return np.concatenate([*bpe.load(bpe.default_path()).encode_parts(text), np.zeros(0, np.uint32)]).tolist()


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_the_library(text):
    expected = BYTE.encode(text, add_special_tokens=False).ids
    assert own_ids(text) == expected
    assert bpe.load(bpe.default_path()).decode(expected).decode() == BYTE.decode(expected, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library_on_any_text(text):
    assert own_ids(text) == BYTE.encode(text, add_special_tokens=False).ids


def test_bpe_splits_every_assigned_character_alike():
    for lo in [*range(0, 0x3000, 64), *range(0xA700, 0xB000, 64), *range(0x10E00, 0x11F00, 64), *range(0x18000, 0x19300, 64), *range(0x1D600, 0x1E700, 64), *range(0x32300, 0x33600, 64)]:
        text = " ".join(f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(lo, lo + 64))
        assert own_ids(text) == BYTE.encode(text, add_special_tokens=False).ids, hex(lo)


def test_long_texts_are_cut_where_no_piece_crosses():
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n", ".", "é", " x"]) for _ in range(5000))
    parts = [*bpe.segments(text, 50)]
    assert "".join(parts) == text and len(parts) > 20
    assert [i for p in parts for i in own_ids(p)] == own_ids(text)


def test_tree_of_one_piece_equals_trees_in_step():
    own = bpe.load(bpe.default_path())
    for word in (b"x", b" international", b"aaaaaaaaaaaaaaaa", "éééé".encode()):
        one = bpe.RankTree(own.byte_ids[np.frombuffer(word, np.uint8)].tolist(), own.merges).merge()
        assert one == own.merge_many([word], 16)[0].tolist()


def test_bpe_query(spark):
    rows = {r["doc_id"]: r for r in bpe.op2_bpe(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = BYTE.encode(text, add_special_tokens=False).ids
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(BYTE.decode(ids, skip_special_tokens=False)))


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "y"), (3, ODD[3], "z"), (900, None, None)], "doc_id long, text string, n_tokens string")


def test_bpe_odd_rows(spark):
    docs = odd_docs(spark)
    got = bpe.bpe_digests(docs).collect()
    assert len(got) == len(ODD) + 3 and all(r["ids_sha256"] == sha("") for r in got if r["doc_id"] in (None, 900))
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert all(r["_decoded"] == (r["text"] or "") for r in back)
    assert bpe.bpe_digests(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "ab c " * (bpe.SEGMENT // 4))], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(long)).first()["_decoded"] == long.first()["text"]


# ---------------------------------------------------------------- files


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 10**6), min_size=1, max_size=60), st.integers(6, 16))
def test_code_lengths_are_a_prefix_code_within_the_limit(counts, limit):
    lengths = token_files.code_lengths(counts, limit)
    assert max(lengths.values()) <= limit and sum(2.0**-x for x in lengths.values()) <= 1
    if limit == 16:
        import heapq

        heap = [(n, k) for k, n in enumerate(counts.values())]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], a[1]))
        best = max(cost, sum(counts.values()))
        assert sum(counts[i] * x for i, x in lengths.items()) >= best or len(counts) == 1
        if max(lengths.values()) < 16:
            assert sum(counts[i] * x for i, x in lengths.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700))
def test_blocks_decode_to_what_was_encoded(ids):
    counts = {i: ids.count(i) + 1 for i in range(41)}
    code = token_files.Code(token_files.code_lengths(counts))
    bits, marks, data = code.encode(np.array(ids, np.int64))
    assert code.decode(data, marks, len(ids)).tolist() == ids
    if len(ids) > token_files.BLOCK:  # a block alone, from its checkpoint
        last = (len(ids) - 1) // token_files.BLOCK
        rest = len(ids) - last * token_files.BLOCK
        assert code.decode(data, marks[4 * last :], rest).tolist() == ids[-rest:]


def test_token_file_query(spark):
    rows = {r["doc_id"]: r for r in token_files.op4_token_files(spark, SF).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*WORDS.encode(r["text"], add_special_tokens=False).ids, 1]
        assert tuple(rows[r["doc_id"]]) == (r["doc_id"], at, len(ids), crc_ids(ids))
        at += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark)
    token_files.write_token_files(docs, f"file://{tmp_path}/a")
    got = token_files.read_token_files(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    texts = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: x[0])
    at = 0
    for r, (i, text) in zip(got, texts, strict=True):
        ids = [*WORDS.encode(text, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (None if i < 0 else i, at, ids)
        at += len(ids)
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_encode_like_whole_texts(text):
    got = token_files.encoder(token_files.default_path()).encode(pa.array([text]))[0].tolist()
    assert got == WORDS.encode(text, add_special_tokens=False).ids


def test_words_of_many_texts_keep_their_places():
    texts = [*ODD, *(f"x{chr(c)}{chr(c)}.,y {chr(c)}!" for c in range(0x21, 0x558) if not 0xD800 <= c < 0xE000), "x" * 90 + " y", "don't, it's; x.y! a,b ...", "<|startoftext|> a<|endoftext|>b", *ODD[::-1]]
    enc = token_files.WordEncoder(token_files.default_path())
    for own in (pa.array(texts), pa.array(["out", *texts, "out"]).slice(1, len(texts))):
        ids, ends = enc.encode(own, step=7)
        for text, a, z in zip(texts, [0, *ends], ends):
            assert ids[a:z].tolist() == WORDS.encode(text, add_special_tokens=False).ids
    assert [len(x) for x in token_files._groups(pa.array(["aa", "a", "b" * 9, "c", ""]), 3)] == [2, 1, 2]


# ---------------------------------------------------------------- counts


@pytest.mark.parametrize("rule", ["start", "end", "share"])
def test_section_tokens_follow_the_library_offsets(spark, rule):
    texts = [*ODD, "one\ntwo \n\nthree\n", "é\né", "a \n b"]
    texts = [t.replace("<|endoftext|>", "") for t in texts]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in token_counts.section_tokens(docs, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["start_char"]] = r["tokens"]
    for i, text in enumerate(texts):
        enc = BYTE.encode(text, add_special_tokens=False)
        starts = [k for k in range(len(text)) if k == 0 or text[k - 1] == "\n"] or [0]
        assert sorted(got[i]) == starts
        assert abs(sum(got[i].values()) - len(enc.ids)) < 1e-9
        if rule == "start" and text.isascii():
            expected = dict.fromkeys(starts, 0)
            at = 0
            for token in enc.ids:
                expected[max(s for s in starts if s <= at)] += 1
                at += len(bpe.load(bpe.default_path()).token_bytes[token])
            assert got[i] == expected


def test_field_tokens_add_up(spark):
    df = spark.createDataFrame([(1, "a b\nc", None, "d"), (2, "", "x\n\ny", "é")], "k long, p string, q string, r string")
    rows = token_counts.field_tokens(df, ["p", "q", "r"], "k").collect()
    for k, text in ((1, "a b\nc\n\nd"), (2, "\nx\n\ny\né")):
        assert sum(r["tokens"] for r in rows if r["k"] == k) == len(BYTE.encode(text, add_special_tokens=False).ids)
    assert len(rows) == 6
    assert hashlib.sha256(b"").hexdigest() == sha("")


def test_field_tokens_of_repeated_null_and_text_keys(spark):
    count = lambda t: len(BYTE.encode(t, add_special_tokens=False).ids)
    rows = [("x", "one two three", "four"), ("x", "one two three", "four"), (None, "null key here", ""), ("7", "five", None)]
    df = spark.createDataFrame([(*r, 5, "f") for r in rows], "k string, title string, body string, row int, key string")
    got = [tuple(r) for rule in ("start", "end", "share") for r in token_counts.field_tokens(df, ["title", "body"], "k", rule=rule).collect()]
    for k, n in (("x", 6), (None, 3), ("7", 3)):
        own = [r for r in got if r[0] == k]
        assert len(own) == 2 * n and {r[1] for r in own} == {"title", "body"}
        text = next(f"{t}\n{b or ''}" for key, t, b in rows if key == k)
        assert sum(r[2] for r in own) == pytest.approx(n * count(text))
    assert token_counts.field_tokens(df.limit(0), ["title", "body"], "k").collect() == []
