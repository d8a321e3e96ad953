"""Declared and inferred types of values (Q17), from what extractors note of annotations and initialisers.

A type has a basis: declared; literal, both-operands, construction, return-of-call or field, from the initialiser; or the
basis of the value that a name stands for, followed for CHAIN steps in the same file. Names are looked up in the same
language: in the same file first, else where only one symbol has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schemas import TYPES
from .facts import Tables
from .resolving import nearest_preceding

#: Fixed value: how many names a value is followed through.
CHAIN = 4


def _looked_up(rows: DataFrame, known: DataFrame, take: str) -> DataFrame:
    """rows (path, language, wanted) with what `known` (path, language, name, take) says of the name: its own file's first, else the only one's."""
    here = known.groupBy("path", F.col("name").alias("wanted")).agg(F.min(take).alias("__here"))
    alone = known.groupBy("language", F.col("name").alias("wanted")).agg(F.count("*").alias("__n"), F.min(take).alias("__any")).where("__n = 1").drop("__n")
    return rows.join(here, ["path", "wanted"], "left").join(alone, ["language", "wanted"], "left").withColumn(take, F.coalesce("__here", "__any")).drop("__here", "__any")


def types(t: Tables) -> DataFrame:
    """(symbol_id, type, basis) of every symbol whose type is declared or can be told."""
    places = t.symbols.select("symbol_id", "path", "language", "name", "kind", "name_start")
    declared = t.notes.where("name = '@declares'").groupBy("symbol_id").agg(F.min("arg").alias("type")).withColumn("basis", F.lit("declared"))
    noted = t.notes.where("name = '@value'").groupBy("symbol_id").agg(F.min("arg").alias("said")).join(declared, "symbol_id", "left_anti")
    values = cut(noted.select("symbol_id", F.split("said", "[|]")[0].alias("how"), F.split("said", "[|]")[1].alias("wanted")).join(places.select("symbol_id", "path", "language", "name_start"), "symbol_id"))
    plain = values.where("how in ('literal', 'both')").select("symbol_id", F.col("wanted").alias("type"), F.when(F.col("how") == "both", "both-operands").otherwise("literal").alias("basis"))
    classes = places.where(F.col("kind").isin(TYPES)).select("path", "language", "name", F.col("name").alias("made"))
    returns = places.where("kind in ('function', 'method')").join(declared.select("symbol_id", F.col("type").alias("returned")), "symbol_id").select("path", "language", "name", "returned")
    calls = _looked_up(_looked_up(values.where("how = 'call'"), classes, "made"), returns, "returned")
    called = calls.where("made is not null or returned is not null").select("symbol_id", F.coalesce("made", "returned").alias("type"), F.when(F.col("made").isNotNull(), "construction").otherwise("return-of-call").alias("basis"))
    fields = places.where("kind = 'field'").join(declared.select("symbol_id", "type"), "symbol_id").groupBy("language", F.col("name").alias("wanted")).agg(F.min_by("type", F.struct("path", "name_start")).alias("type"))
    members = values.where("how = 'member'").join(fields, ["language", "wanted"]).select("symbol_id", "type", F.lit("field").alias("basis"))
    known = cut(declared.union(plain).union(called).union(members))
    # A name stands for the last binding of it before the place, in the same file.
    bound = places.where("kind in ('variable', 'parameter', 'constant')").select("path", F.col("name").alias("wanted"), F.col("name_start").alias("at"), F.col("symbol_id").alias("of"))
    asked = values.where("how = 'name'").select("symbol_id", "path", "wanted", (F.col("name_start") - 1).alias("before"))
    named = nearest_preceding(asked, bound, ["path", "wanted"], "before", "at", ["of"], "of").where("prev_of is not null")
    named = cut(named.select("symbol_id", F.col("prev_of").alias("of")))
    for _ in range(CHAIN):
        new = named.join(known.select("symbol_id"), "symbol_id", "left_anti").join(known.select(F.col("symbol_id").alias("of"), "type", "basis"), "of").select("symbol_id", "type", "basis")
        new = cut(new)
        if new.isEmpty():
            break
        known = cut(known.union(new))
    return known


def held(t: Tables, known: DataFrame) -> DataFrame:
    """(path, scope_id, name, types, settled): what all assignments of a variable in a scope hold; settled if they agree."""
    rows = t.symbols.where("kind in ('variable', 'constant', 'parameter')").select("symbol_id", "path", "scope_id", "name").join(known, "symbol_id")
    return rows.groupBy("path", "scope_id", "name").agg(F.sort_array(F.collect_set("type")).alias("types")).withColumn("settled", F.size("types") == 1)
