"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_lookalikes", "p2_repetition", "p3_scan_noise", "p4_markup", "p5_language", "p6_tokens", "p7_mixture", "p8_stuffing")


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"quireflow.llm.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
