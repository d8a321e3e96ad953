"""Scalars that need a loop over characters or paths (P2-P5, N8, N13, N15, N16), as plain functions and Arrow UDFs."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def line_col(text: str, offset: int) -> tuple[int, int]:
    """1-based line and character column of a byte offset; past the end it is the end."""
    before = text.encode("utf-8")[: max(0, offset)].decode("utf-8", "ignore")
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def offset_of(text: str, line: int, col: int) -> int | None:
    """Byte offset of a line and column; the column is held inside its line, the line must exist."""
    lines = text.split("\n")
    if not 1 <= line <= len(lines):
        return None
    before = "\n".join(lines[: line - 1]) + ("\n" if line > 1 else "")
    return len((before + lines[line - 1][: max(0, col - 1)]).encode("utf-8"))


def parse_range(text: str) -> tuple[str, int, int, int, int]:
    """Path:line:col-line:col; an inverted range is refused."""
    m = re.fullmatch(r"(.+):(\d+):(\d+)-(\d+):(\d+)", text)
    if not m:
        raise ValueError(f"not a range: {text}")
    a, b, c, d = map(int, m.groups()[1:])
    if (c, d) < (a, b):
        raise ValueError(f"inverted range: {text}")
    return m[1], a, b, c, d


def full_line_span(text: str, start: int, end: int) -> tuple[int, int]:
    """P5: a span in characters widened to whole lines, the last line break included."""
    last = text.find("\n", max(start, end - 1))
    return text.rfind("\n", 0, start) + 1, len(text) if last < 0 else last + 1


def reindent(text: str, by: str) -> str:
    """P5: the same lines with another common indent."""
    lines = text.split("\n")
    least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(by + x[least:] if x.strip() else x for x in lines)


def normal_path(path: str) -> str:
    """`.` and `..` resolved without looking at any disk."""
    return "" if (out := posixpath.normpath(path)) == "." else out


def relative_link(from_path: str, to_path: str) -> str:
    """What a file writes to name another; begins with a dot."""
    out = posixpath.relpath(to_path, posixpath.dirname(from_path) or ".")
    return out if out.startswith(".") else f"./{out}"


def snake(name: str) -> str:
    """N13."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).replace("-", "_").lower()


def pascal(name: str) -> str:
    """N13."""
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[_-]+", name) if p)


def suggest_name(expression: str) -> str:
    """A variable name for an expression: what is called or read last, or `value`."""
    words = re.findall(r"[A-Za-z_]\w*", re.sub(r"\(.*\)|\[.*\]|\".*\"|'.*'", "", expression, flags=re.S))
    return snake(re.sub(r"^(get|fetch|load|read|make|build)_?(?=[A-Z]|[a-z]+$)", "", words[-1]) or "value") if words else "value"


def line_cols(text: Column, offset: Column) -> Column:
    """P2 over columns: struct(line, col)."""

    @F.pandas_udf("line int, col int")
    def run(texts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_col(t or "", int(o)) for t, o in zip(texts, offsets)], columns=["line", "col"])

    return run(text, offset)


def normal_paths(path: Column) -> Column:
    """N8 over columns."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(normal_path, na_action="ignore")

    return run(path)
