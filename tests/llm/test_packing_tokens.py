"""Packing and token shards against brute force and exact round trips."""

from __future__ import annotations

import json
import random
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelane.llm import bitplane, packing
from wavelane.llm.queries import tokenizer
from wavelane.llm.tokens import Encoder, encoder

DOCS = "doc_id long, text string, source string, start int, bins string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "s", 5, "x") for k, t in texts], DOCS)


def slow_first_fit(sizes, capacity):
    """Every bin in turn, from the first."""
    free, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        out[i] = (b, capacity - free[b])
        free[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_tree_is_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == slow_first_fit(sizes, 50)


TEXTS = [
    "", " ", "  ", "\n\n", "a", "Hello, world!", "  two  blanks ", "tab\tand\nline\r\nend ", "don't we're I'LL", "x" * 5000,
    "naïve café ÀÉÎ ǅ ǆ İstanbul ı ß ẞ", "é combining å", "日本語 テキスト 한국어", "emoji 👩‍👩‍👧 🇩🇪", "a b c　d", "123 4567 1,000.50", "<s> </s> <unk> [CLS] <|endoftext|>",
    "word " * 300, "(a) [b] {c} \"d\" e- -f +g /h/ i@j k^l ~m", "Привет, мир! ёж", "\x0b\x0c\x1c\x85 x", "a\n b\n\n c", "I  I   I", "ﬁ ﬂ Å Ω", "퟿ \U0010ffff", "'s 't 'S", "foo​bar ﻿",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_equals_the_library(name):
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(tokenizer(name)), Encoder(tokenizer(name))
    plain.encode_special_tokens = True
    assert mine.kind != "whole"
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", "'", ".", "1", "ß", "İ", "я", "́", "\t", "#", "x"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(4000)]
    for t, got in zip(texts, mine.encode(texts), strict=True):
        assert list(array("I", got)) == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_operators_encode_as_an_untouched_tokenizer(name):
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(tokenizer(name)), encoder(tokenizer(name))
    assert mine.kind != "whole"
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", " ", "\n", "'", ".", "1", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x"]
    texts = ["one two <|endoftext|> three", *TEXTS, *("".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(2000))]
    for t, got in zip(texts, mine.encode(texts), strict=True):
        assert list(array("I", got)) == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_covers_each_id_once(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(0, 400)))) for i in range(120)]
    texts += [(500, None), (501, ""), (None, "no id"), (502, "copy"), (502, "copy"), (503, "long " * 5000)]
    path = tokenizer("byte_bpe_50k.json")
    rows = packing.pack(documents(spark, texts), path, capacity=128, group_docs=16, with_ids=True).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    for key in {k for k, _ in texts}:
        want = sorted(([*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts if k == key), key=len)
        mine = [r for r in rows if r["doc_id"] == key]
        if key != 502:
            got = sorted(mine, key=lambda r: r["start"])
            assert [r["start"] for r in got] == [128 * i for i in range(len(got))]
            assert [x for r in got for x in array("I", r["ids"])] == want[0]
            assert {r["doc_tokens"] for r in got} == {len(want[0])}
        assert sum(r["length"] for r in mine) == sum(map(len, want))
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in mine)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    total = sum(r["length"] for r in rows)
    assert 128 * len(by_sequence) <= 1.1 * total


def test_pack_empty_table_and_reruns(spark):
    path = tokenizer("byte_bpe_50k.json")
    assert packing.pack(documents(spark, []), path).collect() == []
    docs = documents(spark, [(i, "word " * (i % 50)) for i in range(200)])
    once, again = (sorted(map(tuple, packing.pack(d, path, capacity=64).collect())) for d in (docs, docs.repartition(5)))
    assert once == again


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, kind):
    x = np.array(ids, "<u4")
    assert bitplane.from_planes(bitplane.to_planes(x, kind), len(x), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("chunk", [4, 7, 65_536])
def test_shards_read_back_in_order(spark, tmp_path, kind, chunk):
    texts = [(9, "one two three"), (3, None), (None, "nameless"), (5, "rep"), (5, "eat"), (7, "word " * 100), (-2, "")]
    path = tokenizer("word_bpe_49k.json")
    manifest = bitplane.write_ids(documents(spark, texts).repartition(3), path, str(tmp_path / "ids"), 1, kind, chunk)
    rows = bitplane.read_ids(manifest, with_ids=True).collect()
    want, at = [], 0
    for key, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encoder(path).encode([t or ""])[0] + (1).to_bytes(4, "little")
        want.append((key, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_shard_index_gives_any_chunk(spark, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    manifest = bitplane.write_ids(documents(spark, [(1, "a b c d e f g h i j")]), path, str(tmp_path / "ids"), 1, "bit", 4)
    (m,) = manifest.collect()
    reader = bitplane.ShardReader(m["path"])
    whole = array("I", next(reader.each())[1])
    assert list(reader.chunk(1)) == list(whole[4:8])
    assert len(reader.index["chunks"]) == -(-len(whole) // 4)
    assert json.dumps(reader.index)
    reader.close()


def test_no_documents_no_shard(spark, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    manifest = bitplane.write_ids(documents(spark, []), path, str(tmp_path / "ids"))
    assert manifest.count() == 0
    assert bitplane.read_ids(manifest).count() == 0


def test_rows_that_repeat_spread_over_groups(spark):
    """One document a thousand times, without an id: no group gets more than its random share, no piece is lost."""
    docs = documents(spark, [(None, "one two three")] * 1000 + [(-(2**63), "least id")])
    got = packing.pack(docs, tokenizer("byte_bpe_50k.json"), group_docs=50).collect()
    assert len(got) == 1001 and sum(r["doc_id"] == -(2**63) for r in got) == 1
    groups = {}
    for r in got:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(groups) > 15 and max(groups.values()) < 150
    path = tokenizer("word_bpe_49k.json")
    read = bitplane.encode_decode(docs, path).collect()
    assert sorted(str(r["doc_id"]) for r in read) == sorted(["None"] * 1000 + [str(-(2**63))])
    assert sorted(r["start"] for r in read) == sorted({r["start"] for r in read})
