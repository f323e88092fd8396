import sys

import __spark_entry__
from emberlens.queries import QUERIES


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("emberlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "emberlens.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(QUERIES)
