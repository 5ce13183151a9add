"""Every query of the library's own operators, with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules holding QUERIES {name: builder} and SQL {name: text}.
MODULES: tuple[str, ...] = ("extract", "review", "contents", "state", "kernels", "profile", "structure")


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quireflow.plans.{m}"), what)
    return out


def queries() -> dict[str, Callable]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
