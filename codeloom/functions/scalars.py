"""Scalar functions over names, paths, spans and texts (N, P, H and R rows of the inventory) as Column expressions.

Everything here stays in the JVM; what needs a loop over characters is in `codeloom.functions.python_scalars`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{IsAlphabetic}\p{N}_]"


def qualified_name(qualifier: Column, name: Column) -> Column:
    """N1."""
    return F.when(qualifier.isNull(), name).otherwise(F.concat(qualifier, F.lit("::"), name))


def anchor_slug(heading: Column) -> Column:
    """What a heading is called in links."""
    kept = F.regexp_replace(F.trim(heading), r"[^\p{IsAlphabetic}\p{N} _-]", "")
    return F.lower(F.regexp_replace(kept, " ", "-"))


def loose(name: Column) -> Column:
    """Spelling without dashes, underscores and case."""
    return F.lower(F.translate(name, "-_", ""))


def bean_property(method: Column) -> Column:
    """getX, setX and isX name the property x; null for other names."""
    part = F.regexp_extract(method, r"^(?:get|set|is)([A-Z].*)$", 1)
    return F.when(part != "", F.concat(F.lower(F.substring(part, 1, 1)), F.regexp_extract(method, r"^(?:get|set|is)[A-Z](.*)$", 1)))


def edit_distance(a: Column, b: Column) -> Column:
    """N5."""
    return F.levenshtein(a, b)


def word_pattern(word: str) -> str:
    """A pattern for a word as it is written, with no letter, digit or underscore beside it."""
    quoted = word.replace("\\E", "\\E\\\\E\\Q")
    return rf"(?<!{WORD})\Q{quoted}\E(?!{WORD})"


def whole_word(text: Column, word: str) -> Column:
    """Whether a word occurs with no letter, digit or underscore beside it."""
    return text.rlike(word_pattern(word))


def file_name(path: Column) -> Column:
    """N9."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """N9."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def under(path: Column, roots: list[str]) -> Column:
    """component-wise prefix of any root."""
    out = F.lit(False)
    for root in roots:
        root = root.strip("/")
        out = out | (path == root) | path.startswith(f"{root}/") if root else F.lit(True)
    return out


def route_for(path: Column) -> Column:
    """Url template of a route file: groups in brackets dropped, [x] and [...x] become {x}."""
    folder = F.regexp_replace(path, r"^(?:src/)?app/|/?(?:route|page)\.[jt]sx?$", "")
    flat = F.regexp_replace(F.regexp_replace(folder, r"\([^)/]*\)/?", ""), r"\[\[?(?:\.\.\.)?([^\]]+)\]\]?", "{$1}")
    return F.concat(F.lit("/"), F.regexp_replace(flat, "/$", ""))


def contains_offset(start: Column, end: Column, offset: Column) -> Column:
    """Half open."""
    return (start <= offset) & (offset < end)


def contains(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Equal ends count."""
    return (start <= inner_start) & (inner_end <= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Touching spans don't overlap."""
    return (a_start < b_end) & (b_start < a_end)


def content_hash(text: Column) -> Column:
    """H1: tells whether a text has changed, no more."""
    return F.xxhash64(text)


def cache_key(language: Column, text: Column) -> Column:
    """H2."""
    return F.sha2(F.concat(language, F.lit("\0"), text), 256)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def link_fragment(destination: Column) -> Column:
    """What a link names in this workspace: nothing for absolute urls, else what follows the first #, else itself; null where nothing is left."""
    fragment = F.when(F.instr(destination, "#") > 0, F.regexp_extract(destination, "#(.*)$", 1)).otherwise(destination)
    return F.when(~destination.contains("://") & (fragment != ""), fragment)
