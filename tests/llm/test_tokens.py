import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from aerotrace.llm import byte_bpe, packing, token_files
from aerotrace.llm.encoding import TextEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, start string, k long, ids string"
TEXTS = [None, "", " ", "Hello, world.", "don't stop", "ÉCOLE été ñandú Straße ΣΊΣΥΦΟΣ", "a\x1cb", "<|endoftext|> x<|startoftext|>y", "e\u0301a\u0301 \u0301z", "x" * 30_000,
         "word " * 20_000, "日本語 テキスト", "tab\tand\nline", "İstanbul ǅ ﬁ", "1234 56,78.", "\u2003wide\u00a0space", "🙂🙂 ok", "Hello, world."]


def table(spark, texts=TEXTS):
    rows = [(len(texts) - i, t, "z", 1, "q") for i, t in enumerate(texts)] + [(None, "no id", "z", 1, "q"), (1, "again", "z", 1, "q")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(i, t) for i, t, *_ in rows]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer):
    enc = TextEncoder(WORD)
    assert enc.runs is not None
    for t in TEXTS[1:]:
        assert enc.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("aAbé'sS.,! \t\x1c\u0301Σ", max_size=40))
def test_encoder_equals_the_library_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    enc, tok = test_encoder_equals_the_library_on_any_text.made
    assert enc.ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


test_encoder_equals_the_library_on_any_text.made = TextEncoder(WORD), Tokenizer.from_file(WORD)


def test_token_files_round_trip(spark, tokenizer):
    df, rows = table(spark)
    shards = token_files.write(df, WORD, shard_bytes=2000)
    got = token_files.read(spark, shards).orderBy("start").collect()
    want = sorted(((i, ids_of(tokenizer, t)) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert [r["start"] for r in got] == [sum(len(x) for _, x in want[:k]) for k in range(len(want))]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(x), crc(x)) for i, x in want)
    one = next(r for r in got if r["doc_id"] == len(TEXTS) - 3)
    folder = shards.first()["folder"]
    assert token_files.read_document(folder, one["file"], one["doc_id"]).tolist() == ids_of(tokenizer, "Hello, world.")
    assert token_files.read_document(folder, one["file"], 10**9) is None


def test_token_files_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert token_files.read(spark, token_files.write(df, WORD)).collect() == []


def test_byte_bpe_equals_the_library(spark):
    df, rows = table(spark)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = {(r["doc_id"], bytes(r["ids"])): bytes(r["bytes"]) for r in byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    want = {(i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()): (t or "").encode() for i, t in rows}
    assert got == want
    assert byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).count() == len(rows)
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.text("ab c\n'sé1.", max_size=400))
def test_segments_and_long_matches_keep_the_ids(text):
    bpe = test_segments_and_long_matches_keep_the_ids.made
    whole = bpe.encoding.encode_ordinary(text)
    old = byte_bpe.SEGMENT, byte_bpe.LONG
    byte_bpe.SEGMENT, byte_bpe.LONG = 16, 8
    try:
        assert bpe.encode(text) == whole
    finally:
        byte_bpe.SEGMENT, byte_bpe.LONG = old


test_segments_and_long_matches_keep_the_ids.made = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)


def test_packing_places_every_id_once(spark, tokenizer):
    df, rows = table(spark)
    pieces = packing.pack(df, WORD).collect()
    seqs, docs = {}, {}
    for p in pieces:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    want = sorted((i or -1, len(ids_of(tokenizer, t))) for i, t in rows)
    assert sorted({(i or -1, n) for i, n in docs}) == sorted(set(want))
    assert sum(p["length"] for p in pieces) == sum(n for _, n in want)
    texts = dict(rows)
    for (i, n), ps in docs.items():
        if i == 1:  # repeated
            continue
        ids, at = ids_of(tokenizer, texts[i]), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == crc(ids[at:at + p["length"]])
            at += p["length"]
        assert at == n
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).collect() == []


def test_copies_of_one_row_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one task
    rows = [(7, "one row that is everywhere", "s", 0, "q")] * 1203 + [(8, None, "s", 0, "q")] * 120 + [(i, f"text {i}", "s", 0, "q") for i in range(100, 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    dealt = packing.dealt(df).withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, t, *_ in rows:
        want[i, t] = want.get((i, t), 0) + 1
    got, tasks = {}, set()
    for r in dealt:
        got[r["doc_id"], r["text"]] = got.get((r["doc_id"], r["text"]), 0) + r["copies"]
        tasks |= {r["task"]} if r["doc_id"] == 7 else set()
    assert got == want and max(r["copies"] for r in dealt) == 50 and len(tasks) > 1
    pieces = packing.pack(df, WORD).collect()
    starts = [p["doc_id"] for p in pieces if p["start"] == 0]
    assert {i: starts.count(i) for i in set(starts)} == {i: n for (i, _), n in want.items()}
    assert all(sum(p["length"] for p in pieces if p["doc_id"] == i) % p0["doc_tokens"] == 0 for i, p0 in {p["doc_id"]: p for p in pieces}.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_first_fit_decreasing_equals_a_plain_loop(sizes):
    bins, plain = packing.first_fit_decreasing([(i, 0, n) for i, n in enumerate(sizes)], 90), []
    for n in sorted(sizes, reverse=True):
        for b in plain:
            if sum(b) + n <= 90:
                b.append(n)
                break
        else:
            plain.append([n])
    assert [[p[2] for p in b] for b in bins] == plain
