"""Structural search and rewriting with `$X` metavariables over tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"\$\$?[A-Z][A-Z0-9_]*|[A-Za-z_][A-Za-z0-9_]*|\d[\w.]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|=>|->|[=!<>]=|&&|\|\||\S")
_COMMENT = {"python": r"#[^\n]*", "bash": r"#[^\n]*", "yaml": r"#[^\n]*", "hcl": r"#[^\n]*|//[^\n]*"}
_OPEN, _CLOSE = "([{", ")]}"


def tokens(text: str, language: str) -> list[tuple[str, int, int]]:
    masked = re.sub(_COMMENT.get(language, r"//[^\n]*|/\*.*?\*/"), lambda m: " " * len(m.group()), text, flags=re.S if language not in _COMMENT else 0)
    found = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(masked)]
    if language not in ("python", "bash"):
        return found
    out, depth = [], 0  # where lines end statements, a line break outside brackets is a token
    for i, x in enumerate(found):
        if i and depth == 0 and "\n" in masked[found[i - 1][2] : x[1]]:
            out.append((";", x[1], x[1]))
        depth += (x[0] in _OPEN) - (x[0] in _CLOSE) if len(x[0]) == 1 else 0
        out.append(x)
    return out


def _match(pattern: list[str], code: list[tuple[str, int, int]], i: int, bound: dict[str, tuple[int, int]]):
    """End of a match at token i and its bindings; a metavariable takes the shortest balanced run of tokens that lets the rest match."""
    if not pattern:
        return i, bound
    first, rest = pattern[0], pattern[1:]
    if first.startswith("$") and not first.startswith("$$"):
        depth, j = 0, i
        while j < len(code):
            text = code[j][0]
            depth += (text in _OPEN) - (text in _CLOSE) if len(text) == 1 else 0
            if depth < 0 or depth == 0 and text in (",", ";") and j > i or text in (",", ";") and j == i:
                return None
            j += 1
            if depth == 0:
                if (known := bound.get(first)) is not None:
                    if [x[0] for x in code[known[0] : known[1]]] == [x[0] for x in code[i:j]]:
                        if got := _match(rest, code, j, bound):
                            return got
                elif got := _match(rest, code, j, bound | {first: (i, j)}):
                    return got
        return None
    want = first[1:] if first.startswith("$$") else first
    return _match(rest, code, i + 1, bound) if i < len(code) and code[i][0] == want else None


def find(text: str, language: str, pattern: str) -> list[tuple[int, int, dict[str, str]]]:
    """(start, end, bindings) of matches in characters; matches don't nest."""
    wanted, code, out, i = [t for t, _, _ in tokens(pattern, "none")], tokens(text, language), [], 0
    while i < len(code):
        got = _match(wanted, code, i, {})
        if got and got[0] > i:
            end, bound = got
            out.append((code[i][1], code[end - 1][2], {k: text[code[a][1] : code[b - 1][2]] for k, (a, b) in bound.items()}))
            i = end
        else:
            i += 1
    return out


def unbound(pattern: str, template: str) -> list[str]:
    """Metavariables of a template that its pattern doesn't bind."""
    return sorted(set(re.findall(r"(?<!\$)\$[A-Z][A-Z0-9_]*", template)) - set(re.findall(r"(?<!\$)\$[A-Z][A-Z0-9_]*", pattern)))


def search(files: DataFrame, language: str, pattern: str, template: str | None = None) -> DataFrame:
    """(path, start, end, text, replacement) in bytes: every match and, with a template, what it becomes. Unknown metavariables in the template are refused."""
    if template is not None and (odd := unbound(pattern, template)):
        raise ValueError(f"not in the pattern: {odd}")

    def run(batches):
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                for a, z, bound in find(text, language, pattern):
                    new = template if template is None else re.sub(r"\$[A-Z][A-Z0-9_]*", lambda m: bound.get(m.group(), m.group()), template)
                    out.append((path, len(text[:a].encode()), len(text[:z].encode()), text[a:z], new))
            yield pd.DataFrame(out, columns=["path", "start", "end", "text", "replacement"])

    return files.where(files.language == language).select("path", "text").mapInPandas(run, "path string, start bigint, end bigint, text string, replacement string")
