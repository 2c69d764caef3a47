"""Every speech query against its SQL, and the driver contract without the training-data operators."""

from __future__ import annotations

import importlib.abc
import importlib.util
import math
import sys
from pathlib import Path

import duckdb
import pytest

from wavelane import queries as speech

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "events embeddings".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(speech.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(speech.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(map(normal, r)) for r in cur.fetchall())
    df = speech.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(normal(r[c]) for c in cols) for r in df.collect()) == want


def test_gated_recognition_finds_text_and_stage_times_are_whole(spark):
    assert any(r["text"] for r in speech.queries()["recognize_gated"](spark, SF).collect())
    (r,) = speech.queries()["stage_times"](spark, SF).collect()
    assert r["total_ms"] == pytest.approx(r["vad_ms"] + r["preprocess_ms"] + r["infer_ms"] + r["decode_ms"])
    assert r["rtf"] == pytest.approx(r["total_ms"] / r["audio_ms"]) and r["audio_ms"] == 32_000 * 1000 / 16_000
    assert set(speech.queries()) - set(speech.oracle_sql()) == {"stage_times"}


class Hidden(importlib.abc.MetaPathFinder):
    """Makes some modules impossible to find."""

    def __init__(self, *names: str):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if name in self.names:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


def test_entry_without_training_data_operators(monkeypatch):
    """The entry module loads and serves the other queries when the subpackage and the pipeline are gone."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("wavelane.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import wavelane

    monkeypatch.delattr(wavelane, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden("corpus_pipeline", "wavelane.llm"), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("entry_alone", ROOT / "__spark_entry__.py")
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == set(speech.queries())
    assert set(alone.oracle_sql()) == set(speech.oracle_sql())


def test_entry_runs(spark):
    spec = importlib.util.spec_from_file_location("entry_whole", ROOT / "__spark_entry__.py")
    whole = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(whole)
    assert whole.entry(spark).count() == 10
    assert set(whole.oracle_sql()) <= set(whole.queries())
