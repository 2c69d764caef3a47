"""The pipeline: each stage's decision takes effect on what the one before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from wavelane.llm import mixing, pii, quality, queries, similarity
from wavelane.llm.common import table, written
from wavelane.llm.packing import token_pieces
from wavelane.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    (_, judge), (_, dedup), (_, hide), (_, mix), (_, pack) = corpus_pipeline.STAGES

    kept = written(judge(spark, docs, SF), "t1")
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs, table(spark, SF, "labels")).collect()}
    assert kept.columns == columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in verdict.items() if v)
    assert 0 < kept.count() < docs.count()

    one = written(dedup(spark, kept, SF), "t2")
    groups: dict = {}
    for r in similarity.join(kept).collect():
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert one.columns == columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(map(min, groups.values()))

    hidden = written(hide(spark, one, SF), "t3")
    want = {r["doc_id"]: r["text"] for r in pii.surrogates(one, queries.PII_KEY).collect()}
    rows = hidden.collect()
    assert hidden.columns == columns
    assert {r["doc_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    mixed = written(mix(spark, hidden, SF), "t4")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(hidden).collect()}
    assert mixed.columns == columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: n for k, n in copies.items() if n})

    packed = pack(spark, mixed, SF).collect()
    pieces = token_pieces(mixed, queries.tokenizer("byte_bpe_50k.json"), 1024, 0).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in packed) == Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32")) for r in pieces)


def test_repeated_and_missing_ids_in_deduplication(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j k l m n"), (None, "h i j k l m n"), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [1, 3, 4, 5]


def test_unrelated_texts_of_one_id_stay(spark):
    """Of an id with a copy and a text of its own, the copy goes and the other stays."""
    rows = [(1, "a b c d e f g"), (5, "h i j k l m n"), (5, "o p q r s t u"), (6, "a b c d e f g"), (6, "v w x y z aa bb"), (None, "cc dd ee ff gg hh"), (None, "cc dd ee ff gg hh"), (None, "ii jj kk ll mm nn")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()))
    assert got == sorted((k or 0, t) for k, t in {*rows} - {(6, "a b c d e f g")})


def test_run_fills_sequences(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows
    assert max(filled.values()) <= 1024


def test_workers_memory_is_small(spark):
    """Each text goes to the quality rules once, and packing keeps few words."""
    docs = spark.createDataFrame([(1, "a b c " * 5, "en", "x"), (2, None, None, "y")], "doc_id long, text string, lang string, source string")
    got = quality.signals(docs, ("text", "source"))
    assert got.columns[-2:] == ["text", "source"] and sorted((r["doc_id"], r["text"], r["source"], r["n_words"]) for r in got.collect()) == [(1, "a b c " * 5, "x", 15), (2, None, "y", 0)]
    path = queries.tokenizer("byte_bpe_50k.json")
    few, many = Encoder(path, literal=False, keep=3), Encoder(path, literal=False)
    texts = [f"Words like w{i % 7}, Worda\nwordb; {'xyz'[: i % 4]} end" for i in range(40)]
    assert few.encode(texts) == many.encode(texts)
    assert all(len(m) <= 3 for m in (few.words, few.runs, few.tails, few.starts))


def test_quality_stage_sends_each_text_once(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sent = []
    before, quality.signals = quality.signals, lambda d, keep=(): sent.append(d.select(*{"text", *keep}).schema.simpleString().count("text:")) or before(d, keep)
    try:
        kept = corpus_pipeline.quality_stage(spark, docs, sf)
    finally:
        quality.signals = before
    assert sent == [1] and kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() > 0
