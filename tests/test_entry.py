import importlib
import sys

import pytest


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 40
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["lattica.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_parts(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith(("lattica.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    import lattica

    monkeypatch.delattr(lattica, "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    assert "heat_step" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_library_does_not_import_the_training_data_parts():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "lattica"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lattica.llm" not in path.read_text(), path
