"""Files to fact tables: one Arrow-batched pass over the texts, then normalised tables as projections of it (X rows)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extractors
from ..functions.lineage import cut
from ..functions.extractors import EXTRACTORS, extract
from ..schemas import FACTS


def extracted(files: DataFrame) -> DataFrame:
    """A row of nested facts for each file (path, language, text)."""
    columns = [f.strip().split(" ", 1)[0] for f in ("path", "language", "content_sha256", "symbols", "refs", "scopes", "imports", "text_spans", "supertypes", "subtrees", "notes", "flows", "errors", "gaps")]

    def run(batches):
        for b in batches:
            rows = [extract(lang, path, text or "") for path, lang, text in zip(b["path"], b["language"], b["text"]) if lang in EXTRACTORS]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "language", "text").mapInPandas(run, FACTS)


@dataclass
class Tables:
    """Normalised facts. Ids are natural keys: a symbol is `path:name_start`, so ids never depend on partitioning."""

    files: DataFrame
    nested: DataFrame
    symbols: DataFrame
    refs: DataFrame
    scopes: DataFrame
    scope_chain: DataFrame
    imports: DataFrame
    bindings: DataFrame
    texts: DataFrame
    supertypes: DataFrame
    subtrees: DataFrame
    notes: DataFrame
    flows: DataFrame
    errors: DataFrame
    gaps: DataFrame


def place(path: str, at: str):
    return F.concat(F.col(path), F.lit(":"), F.lpad(F.col(at).cast("string"), 9, "0"))


def tables(files: DataFrame, nested: DataFrame | None = None) -> Tables:
    """Explodes nested facts. Give stored ones (K6) to skip extraction."""
    nested = extracted(files) if nested is None else nested
    nested = nested.persist()

    def each(name: str) -> DataFrame:
        return nested.select("path", "language", F.explode(name).alias("x")).select("path", "language", "x.*")

    symbols = each("symbols").withColumn("symbol_id", place("path", "name_start")).withColumn("container_id", F.when(F.col("container").isNotNull(), place("path", "container"))).drop("container")
    symbols = symbols.withColumn("qualified_name", F.when(F.col("qualifier").isNull(), F.col("name")).otherwise(F.concat_ws("::", "qualifier", "name")))
    symbols = cut(symbols)  # symbols and references are what every plan joins: written once, they are a leaf of each
    refs = each("refs").withColumn("ref_id", place("path", "start")).withColumn("enclosing_id", F.when(F.col("enclosing").isNotNull(), place("path", "enclosing"))).drop("enclosing")
    refs = cut(refs)
    scopes = each("scopes")
    imports = nested.select("path", "language", F.explode("imports").alias("x")).select("path", "language", "x.*")
    named = imports.select("path", "language", "import_pos", "module", F.explode("names").alias("n")).select("path", "language", "import_pos", "module", F.col("n.original").alias("original"), F.col("n.local").alias("name"))
    alias = imports.where("alias is not null").select("path", "language", "import_pos", "module", F.lit("*").alias("original"), F.col("alias").alias("name"))
    bindings = named.union(alias).groupBy("path", "language", "name").agg(F.min(F.struct("import_pos", "original", "module")).alias("b")).select("path", "language", "name", "b.*")
    return Tables(
        files, nested, symbols, refs, scopes, _chains(nested), imports, bindings, each("text_spans"), each("supertypes"), each("subtrees"), each("notes").withColumn("symbol_id", place("path", "owner")),
        each("flows").withColumn("symbol_id", place("path", "target")), nested.select("path", F.explode("errors").alias("at")), nested.select("path", F.explode("gaps").alias("gap")),
    )


def _chains(nested: DataFrame) -> DataFrame:
    """scope_chain: every ancestor of a scope with its distance, the scope itself at 0. A file's scopes are walked inside its own row."""

    def run(batches):
        for b in batches:
            out = []
            for path, scopes in zip(b["path"], b["scopes"]):
                parent = {s["scope_id"]: s["parent_id"] for s in scopes}
                for s in parent:
                    at, d = s, 0
                    while at is not None and at == at:
                        out.append((path, s, int(at), d))
                        at, d = parent.get(at), d + 1
            yield pd.DataFrame(out, columns=["path", "scope_id", "ancestor_id", "distance"])

    return nested.select("path", "scopes").mapInPandas(run, "path string, scope_id int, ancestor_id int, distance int")


def fingerprint() -> str:
    """H4: changes with the source of the extractors, so that facts of other rules are not taken from a cache."""
    folder, digest = Path(extractors.__file__).parent, hashlib.sha256()
    for path in sorted(folder.glob("*.py")):
        digest.update(path.name.encode() + b"\0" + path.read_bytes())
    return digest.hexdigest()


def workspace_key(files: DataFrame) -> str:
    """K7: a key of all paths and contents, whatever their order, and of the extractors."""
    row = files.select(F.xxhash64("path", "language", "text").alias("a"), F.xxhash64("text", "path", F.lit(1)).alias("b")).agg(F.count("*"), F.bit_xor("a"), F.bit_xor("b")).first()
    return hashlib.sha256(f"{fingerprint()}:{tuple(row)}".encode()).hexdigest()


def cache_counters(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(files, hits, misses, entries) of a fact cache for some files, by language and content."""
    keyed = files.select(F.sha2(F.concat("language", F.lit("\0"), "text"), 256).alias("key"))
    known = cached.select("key").distinct()
    entries = known.count()
    return keyed.join(known.withColumn("hit", F.lit(True)), "key", "left").agg(F.count("*").alias("files"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.lit(entries).alias("entries"))


def missing_from_cache(files: DataFrame, cached: DataFrame) -> DataFrame:
    """K6: files whose content no cached facts have: an anti-join on language and hash."""
    keyed = files.withColumn("key", F.sha2(F.concat("language", F.lit("\0"), "text"), 256))
    return keyed.join(cached.select("key").distinct(), "key", "left_anti").drop("key")
