"""Mixing and top-k search against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from wavelane.llm import mixing, queries, topk

DOCS = "doc_id long, text string, source string, size int, key string, target string"


def fair_targets(sizes: dict, weights=(1, 2, 3), share=1.0, most=3.0) -> dict:
    """Water filling, one full source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        part = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if part[s] > most * sizes[s] + 1e-9]
        if not over:
            return full | part
        full |= {s: most * sizes[s] for s in over}


def table(spark, rows):
    return spark.createDataFrame([(k, t, s, 3, "k", "t") for k, t, s in rows], DOCS)


@pytest.mark.parametrize("seed", range(3))
def test_mix_reaches_targets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", None, "é"][: rng.randint(1, 6)]
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(0, 30))), names[int(len(names) * rng.random() ** 3)]) for i in range(400)]
    rows += [(5000, None, names[0]), (None, "no id", names[0]), (7000, "again again", names[0]), (7000, "again again", names[0])]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = fair_targets(sizes)
    by_id = {k: (words(t), s) for k, t, s in rows}
    taken: dict = dict.fromkeys(sizes, 0)
    for r in got:
        size, s = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[s])
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * size <= 3 * size
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(w for w, x in by_id.values() if x == s) + 0.05 * want[s]


def test_mix_reruns_agree_and_empty(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 7 == 0]) for i in range(300)]
    a = sorted(map(tuple, mixing.mix(table(spark, rows)).collect()))
    b = sorted(map(tuple, mixing.mix(table(spark, rows[::-1]).repartition(6)).collect()))
    assert a == b
    assert mixing.mix(table(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_inclusion_is_by_size(spark):
    """Chances grow with a document's size up to 1, and each stratum gives its expected number, rounded up or down."""
    sizes = [0, 1, 2, 5, 10, 30, 100, 300, 1000]
    rows = [(i, "w " * sizes[i % 9], "a") for i in range(9 * 60)] + [(10_000 + i, "w " * 400, "b") for i in range(60 * 9)]
    got = [r for r in mixing.mix(table(spark, rows), weights=(1.0, 3.0)).collect() if r["doc_id"] < 10_000]
    needs = got[0]["target"]
    assert 0 < needs < got[0]["source_size"]
    by_size = {n: [r for r in got if r["size"] == n] for n in sizes}
    chance = {n: by_size[n][0]["chance"] for n in sizes}
    cut = next(c / n for n, c in chance.items() if n and c < 1)
    assert all(chance[n] == pytest.approx(min(1, n * cut)) for n in sizes)
    assert sum(r["chance"] * r["size"] for r in got) == pytest.approx(needs)
    assert chance[1000] == 1 > chance[300] > 0
    for n in sizes:
        assert abs(sum(r["copies"] for r in by_size[n]) - 60 * chance[n]) < 1
    assert abs(sum(r["taken"] for r in got) - needs) < 300


def test_inclusion_within_a_stratum(spark):
    """Of documents of one stratum, a larger one is taken as much more often as it is larger."""
    rows = [(i, "w " * (64 if i % 2 else 79), "a") for i in range(6000)] + [(10_000 + i, "w " * 71, "b") for i in range(6000)]
    got = [r for r in mixing.mix(table(spark, rows), weights=(1.0, 2.0)).collect() if r["doc_id"] < 10_000]
    hits = {n: sum(r["copies"] for r in got if r["size"] == n) for n in (64, 79)}
    assert abs(sum(hits.values()) - sum(r["chance"] for r in got)) < 1
    assert 1.08 < hits[79] / hits[64] < 1.4


def test_rows_that_repeat_are_drawn_one_by_one(spark):
    """Rows without an id and with one text have random numbers of their own, and reruns agree whatever the order."""
    rows = [(None, "w " * 20, "a")] * 300 + [(i, "w " * 21, "a") for i in range(100)] + [(1000 + i, "w " * 30, "b") for i in range(300)]
    runs = []
    for df in (table(spark, rows), table(spark, rows[::-1]).repartition(5)):
        got = mixing.mix(df, weights=(1.0, 2.0)).collect()
        runs.append(sorted(((r["doc_id"] or -1, r["size"], r["copies"]) for r in got)))
        own = [r for r in got if r["size"] == 20]
        assert abs(sum(r["copies"] for r in got if r["size"] in (20, 21)) - sum(r["chance"] for r in got if r["size"] in (20, 21))) < 1
        # About 300 * chance; all alike would give 0 or 300.
        assert abs(sum(r["copies"] for r in own) - 300 * own[0]["chance"]) < 50
    assert runs[0] == runs[1]


VECTORS = "vec_id long, embedding array<float>, label int, v int, dim string"


def slow_top(rows, k, every=50):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, a in ok:
        if q % every == 0:
            hits = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(1000)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(2000 + i, same) for i in range(200)]  # a frequent vector, queries among its holders
    rows += [(5000, None), (5050, [1.0, None] + [0.0] * 6), (5100, [float("nan")] * 8), (5150, [float("inf")] * 8), (None, same)]
    rows += [(6000, [0.0] * 8), (6050, [1.0, 2.0, 3.0]), (6051, [1.0, 2.0, 3.5]), (6100, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    for conf in ({}, {"block_rows": 100, "block_queries": 3}, {"least_blocks": 1}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **conf).collect())
        assert got == slow_top(rows, 5)


def test_top_k_stops_early_and_exactly():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 6))
    lists = topk.SortedLists(x)
    for q in rng.integers(-300, 300, (40, 6)):
        rows, scores = lists.top(q, 5)
        want = np.sort(x @ q)[::-1][:5]
        assert np.sort(scores)[::-1][:5].tolist() == want.tolist()
        assert set(np.flatnonzero(x @ q >= want[4])) == set(rows)
        # With the kth score of another block, nothing that reaches it is lost.
        rows, _ = lists.top(q, 5, least=float(want[1]))
        assert set(np.flatnonzero(x @ q >= want[1])) <= set(rows)


def test_top_k_of_a_repeated_query(spark):
    """The vectors of one id are searched as one query; a row that both find counts by its better score, each copy once."""
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 49)] + [(50, rng.normal(size=4).astype(np.float32).tolist()) for _ in range(2)] * 2
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    ints = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    best = sorted((-max(int(a @ b) for q, a in ints if q == 50), i) for i, b in ints if i != 50)[:5]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2, "x"), (1, [2.0], 1, 2, "x")], VECTORS)
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.where("vec_id < 0")).collect() == []


def test_mixing_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = "doc_id, size, source_size, target, copies, taken"
    want = con.execute(f"SELECT {cols} FROM ({queries.ORACLE_SQL['op4_mixing']})").fetchall()
    got = queries.op4_mixing(spark, sf).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["op5_topk"]).fetchall())
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op5_topk(spark, sf).collect())
    assert got == sorted((q, r, v, s) for q, v, s, r in ((x[0], x[2], x[3], x[1]) for x in want))
