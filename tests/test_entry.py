import builtins

import pytest

import __spark_entry__ as entry


def test_only_a_missing_folder_is_passed_over(monkeypatch):
    real, missing = builtins.__import__, ["stationflow.llm"]

    def broken(name, *more, **named):
        if name == "stationflow.llm":
            raise ImportError("broken", name=missing[0])
        return real(name, *more, **named)

    monkeypatch.setattr(builtins, "__import__", broken)
    assert entry._llm() == ({}, {})
    missing[0] = "ahocorasick"
    with pytest.raises(ImportError):
        entry._llm()


def test_every_sql_form_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
