"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("topk", "ngram_join", "quality", "packing", "secrets", "licenses", "sentencepiece_lattice", "ann", "hmm", "warc", "byte_bpe", "merkle", "resample")


def _all(attribute: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"foliant.llm.{m}"), attribute).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
