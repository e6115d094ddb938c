import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "total", "complete", "partial", "last_enriched"] and df.count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_training_data_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("prospecta.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("prospecta.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", gone)
    try:
        bare = importlib.reload(entry)
        names = set(bare.queries())
        assert "a01_coverage_matrix" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
