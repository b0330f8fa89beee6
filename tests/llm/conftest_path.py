"""Helpers that tests import by name."""

from __future__ import annotations

from importlib import util
from pathlib import Path

from spanlock.llm.common import table  # noqa: F401

_spec = util.spec_from_file_location("llm_fixtures", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
documents = _module.documents


def groups(n: int, linked) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]
