"""The driver contract without the training-data subpackage."""

import importlib.util

import __spark_entry__ as entry
from quillstone import plans


def test_queries_without_the_llm_folders(monkeypatch):
    find = importlib.util.find_spec

    def hidden(name, *a):
        if name.startswith("quillstone.llm"):
            raise ModuleNotFoundError(name)
        return find(name, *a)

    monkeypatch.setattr(importlib.util, "find_spec", hidden)
    assert entry.queries() == plans.QUERIES and entry.oracle_sql() == plans.ORACLES
