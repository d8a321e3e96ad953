"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from . import code, generated, relational, typed
from .generated import q02 as flagship
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "code", "flagship", "generated", "relational", "typed"]
