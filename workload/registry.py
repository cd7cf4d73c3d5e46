"""Query registry: name -> Spark callable, oracle SQL, inventory ids covered."""

from __future__ import annotations

import re
from collections.abc import Callable

from . import duck_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(covers: str, sql: str | None = None):
    """Register a function named like its query; `covers` lists inventory ids."""
    def wrap(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers.split()
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn
    return wrap


def expand(sql: str) -> str:
    """Prepend the view definitions a statement uses, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+\b", text):
            if name in duck_views.VIEWS and name not in needed:
                visit(duck_views.VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({duck_views.VIEWS[n].strip()})" for n in needed)
    if recursive:
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:].lstrip()}"
    return f"WITH {head}\n{body}"
