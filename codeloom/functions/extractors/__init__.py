"""Fact extractors, one for each language; `extract(language, path, text)` gives a row of the facts schema."""

from __future__ import annotations

import hashlib

from . import braces, configs, markup, python_
from .base import Facts

EXTRACTORS = {"python": python_.extract, "html": markup.html, "xml": markup.xml, "markdown": markup.markdown, "css": markup.css, "scss": markup.css, "yaml": configs.yaml_, "helm": configs.helm, "hcl": configs.hcl, "bash": configs.bash} | {x: braces.extract for x in ("go", "rust", "java", "typescript", "tsx", "zig")}


def register(language: str, extractor) -> None:
    """Adds a language: extractor(facts) reads facts.text and calls its define(), refer(), scope() and import_()."""
    EXTRACTORS[language] = extractor


def extract(language: str, path: str, text: str) -> dict:
    """Never raises on bad input: what could not be read is a row of `errors` and a gap."""
    facts = Facts(path, language, text)
    try:
        EXTRACTORS[language](facts)
    except (SyntaxError, ValueError, RecursionError, IndexError) as e:
        facts.error(getattr(e, "offset", None) or 0)
    return facts.row() | {"content_sha256": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()}
