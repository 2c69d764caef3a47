"""Fill-in-middle against a plain restatement by slices, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelane.llm import infill, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text: str) -> tuple:
    """n, form, prefix and middle length, output."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 60))
def test_rotation_in_place(data, i, m, j):
    i, m, j = sorted(min(x, len(data)) for x in (i, m, j))
    buffer = bytearray(data)
    infill.rotate(buffer, i, m, j)
    assert bytes(buffer) == data[:i] + data[m:j] + data[i:m] + data[j:]


def test_reversal_in_small_steps(monkeypatch):
    monkeypatch.setattr(infill, "SCRATCH", 3)
    for n in range(40):
        buffer = bytearray(range(n))
        infill.reverse(buffer, 0, n)
        assert bytes(buffer) == bytes(range(n))[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ <>PSM\n\té日\U0001f600\x00", max_size=50), st.data())
def test_restored_from_output_and_form(text, data):
    raw = text.encode()
    starts = infill.unit_starts(raw)
    assert [*starts] == [len(text[: m.start()].encode()) for m in UNIT.finditer(text)]
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    places = [*starts.tolist(), len(raw)]
    a, b = sorted(data.draw(st.sampled_from(places)) for _ in range(2))
    for form in ("psm", "spm", "plain"):
        assert infill.restore(bytes(infill.arrange(raw, a, b, form)), form) == raw


def test_units_over_scanned_parts(monkeypatch):
    text = ("abéc日 d" * 20).encode()
    want = infill.unit_starts(text).tolist(), infill.code_points(text, 3, 100)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(infill, "SCAN", size)
        assert (infill.unit_starts(text).tolist(), infill.code_points(text, 3, 100)) == want


def test_edge_rows(spark):
    rng = random.Random(3)
    long_ = "".join(rng.choices(["word", " ", "\n", "ü", ".", "x1"], k=300_000))
    rows = [(1, None), (2, ""), (3, "a"), (None, "one two three"), (5, "has <S> inside"), (6, long_), (7, "same"), (7, "same"), (8, " \n "), *((i, "Some text, number %d." % i) for i in range(9, 60))]
    df = spark.createDataFrame([(k, t, "x", 9) for k, t in rows], "doc_id long, text string, n string, form int")
    got = infill.transform(df).collect()
    assert len(got) == len(rows)
    want = sorted(repr((k, *plainly("" if k is None else k, t or ""))) for k, t in rows)
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode())) for r in got) == want
    texts = sorted(repr((k, t or "")) for k, t in rows)
    assert sorted(repr((r.doc_id, bytes(r.restored).decode())) for r in got) == texts
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(df.limit(0)).count() == 0
    assert "restored" not in infill.transform(df, check=False).columns


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_digests(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op13_infill(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, p, m, output = plainly(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(docs[r.doc_id]))
