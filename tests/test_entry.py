"""The entry module without the optional corpus subpackage."""

import sys


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import __spark_entry__ as E
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sluice.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "sluice.llm", None)
    names = set(E.queries())
    assert "search_page" in names and "pipeline" not in names
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in names)
    assert set(E.oracle_sql()) <= names


def test_nothing_imports_the_corpus_subpackage():
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "sluice")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as h:
                    assert "sluice.llm" not in h.read(), f
