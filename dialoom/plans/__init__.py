"""Registered queries of the engine, with their SQL."""

from . import evaluation, linking, prompts, sessions, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
