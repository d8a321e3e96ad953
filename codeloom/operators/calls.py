"""Call graph and type hierarchy over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schemas import CALLABLE
from .facts import Tables
from .graphs import Factored, closure
from .resolving import FIELD, divide_loosely, with_key


#: Languages whose types share hierarchies.
FAMILIES = {"rust": "rust", "go": "go", "typescript": "ts", "tsx": "ts", "java": "java", "python": "python"}
#: What a possible callee rests on, strongest first.
BASES = ["implemented-trait", "interface-method-set", "declared-supertype", "method-name"]


def family(language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), language)


def go_implementations(t: Tables) -> DataFrame:
    """(src, dst): Go types and the interfaces whose methods they all have, with as many parameters and in the same signature, where both can be read."""
    go = t.symbols.where("language = 'go'")
    note = lambda name, to: t.notes.where(F.col("name") == name).groupBy("symbol_id").agg(F.min("arg").alias(to))
    method = go.where("kind = 'method' and qualifier is not null").join(note("@arity", "arity"), "symbol_id", "left").join(note("@signature", "signature"), "symbol_id", "left")
    method = method.select(F.col("qualifier").alias("owner"), F.concat_ws("/", "name", "arity").alias("item"), "signature")
    interface = go.where("kind = 'interface'").select(F.col("name").alias("owner")).distinct()
    need = method.join(interface, "owner", "left_semi").withColumnRenamed("owner", "interface")
    have = method.join(interface, "owner", "left_anti")
    return divide_loosely(have, need, "owner", "item", "interface", "signature").select(F.col("owner").alias("src"), F.col("interface").alias("dst"))


def hierarchy(t: Tables) -> DataFrame:
    """(src, dst, family): a type and each type that it is declared under, plus Go types that have an interface's methods."""
    declared = t.supertypes.select(F.col("type").alias("src"), F.col("parent").alias("dst"), family(F.col("language")).alias("family"))
    return declared.where("family is not null").union(go_implementations(t).withColumn("family", F.lit("go"))).distinct()


def subtypes(t: Tables) -> DataFrame:
    """(src, dst) of hierarchies of all languages."""
    return hierarchy(t).select("src", "dst").distinct()


def ancestors_of(t: Tables) -> DataFrame:
    """(src, dst) closed under transitivity."""
    return closure(subtypes(t)).where("src <> dst")


def below(t: Tables) -> DataFrame:
    """(family, src, dst): every type and the types above it, of one family of languages."""
    key = lambda c: F.concat_ws(":", "family", c)
    all_ = closure(hierarchy(t).select(key("src").alias("src"), key("dst").alias("dst"))).where("src <> dst")
    part = lambda c: F.substring_index(c, ":", -1).alias(c)
    return all_.select(F.substring_index("src", ":", 1).alias("family"), part("src"), part("dst"))


def _methods(t: Tables) -> DataFrame:
    m = t.symbols.where("kind = 'method' and qualifier is not null").withColumn("family", family(F.col("language"))).where("family is not null")
    return m.select("symbol_id", "family", F.col("qualifier").alias("owner"), "name")


def families(t: Tables, up: DataFrame | None = None) -> DataFrame:
    """(abstract_id, concrete_id): a method and the methods of equal name in every type below."""
    m, up = _methods(t), below(t) if up is None else up
    lower = m.withColumnsRenamed({"symbol_id": "concrete_id", "owner": "src"})
    upper = m.withColumnsRenamed({"symbol_id": "abstract_id", "owner": "dst"})
    return lower.join(up, ["family", "src"]).join(upper, ["family", "dst", "name"]).select("abstract_id", "concrete_id")


def attribute_family(t: Tables, fields: DataFrame) -> DataFrame:
    """E5: (symbol_id, member_id): for each field (column symbol_id) those of its name in the whole tree that its type stands in: the types above it, and all types below one of these.

    One labelled walk: a state is a type and whether the walk has turned down; up-steps end where down-steps begin, so
    types that are only related through a shared descendant stay apart.
    """
    every = t.symbols.where("kind = 'field' and qualifier is not null").withColumn("family", family(F.col("language"))).where("family is not null")
    every = every.select("symbol_id", "family", F.col("qualifier").alias("owner"), "name", "language")
    asked = every.join(fields.select("symbol_id").distinct(), "symbol_id", "left_semi")
    edges = cut(hierarchy(t).select("family", "src", "dst"))
    state = asked.select("family", F.col("owner").alias("origin"), F.col("owner").alias("type"), F.lit(False).alias("down")).distinct()
    seen = frontier = cut(state)
    while not frontier.isEmpty():
        climb = frontier.where("not down").join(edges.select("family", F.col("src").alias("type"), "dst"), ["family", "type"]).select("family", "origin", F.col("dst").alias("type"), F.lit(False).alias("down"))
        turn = frontier.join(edges.select("family", F.col("dst").alias("type"), "src"), ["family", "type"]).select("family", "origin", F.col("src").alias("type"), F.lit(True).alias("down"))
        frontier = cut(climb.union(turn).distinct().join(seen, ["family", "origin", "type", "down"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    related = seen.select("family", F.col("origin").alias("owner"), "type").distinct()
    members = every.select("family", F.col("owner").alias("type"), "name", "language", F.col("symbol_id").alias("member_id"))
    return asked.join(related, ["family", "owner"]).join(members, ["family", "type", "name", "language"]).select("symbol_id", "member_id").distinct()


def dispatch_sets(t: Tables, up: DataFrame, kin: DataFrame) -> DataFrame:
    """(set_id, dst, basis): for each family of languages and method name the methods that a call on a value of unknown type may reach, with the best of its bases.

    Traits and interfaces of Rust and Go bring in their own methods and those of the types that have them; classes of
    TypeScript and Java bring in their own by name alone and those below them by declaration; Python's count only
    within a hierarchy.
    """
    m = _methods(t)
    kinds = t.symbols.where(F.col("kind").isin("trait", "interface")).select(family(F.col("language")).alias("family"), F.col("name").alias("owner")).distinct()
    declared = F.when(F.col("family") == "rust", 0).when(F.col("family") == "go", 1).otherwise(2)
    abstract = m.where("family in ('rust', 'go')").join(kinds, ["family", "owner"], "left_semi").select("symbol_id", "family", "name", declared.alias("rank"))
    classes = m.where("family in ('ts', 'java')").select("symbol_id", "family", "name", F.lit(3).alias("rank"))
    parents = m.where("family = 'python'").join(up.select("family", F.col("dst").alias("owner")).distinct(), ["family", "owner"], "left_semi").select("symbol_id", "family", "name", F.lit(2).alias("rank"))
    under = m.join(kin.select(F.col("concrete_id").alias("symbol_id")).distinct(), "symbol_id", "left_semi").select("symbol_id", "family", "name", declared.alias("rank"))
    every = abstract.union(classes).union(parents).union(under).groupBy("family", "name", "symbol_id").agg(F.min("rank").alias("rank"))
    return every.select(F.concat_ws(":", "family", "name").alias("set_id"), F.col("symbol_id").alias("dst"), F.element_at(F.array(*map(F.lit, BASES)), F.col("rank") + 1).alias("basis"))


def call_graph(t: Tables, resolved: DataFrame) -> dict[str, DataFrame]:
    """nodes, direct edges (src, dst, path, offset, confidence, origin, basis), sites and sets, unresolved and file-scope calls.

    Proven calls between callables are direct edges. A call of a method that others override may reach those too, and a
    call of a member whose target isn't proven may reach every method of its dispatch set, in place of the weak answer.
    Such possible edges are kept factored: sites (src, set_id, path, offset) lead to sets (set_id, dst, basis), so a name
    with many calls and many methods takes their sum and not their product. Walks go through the sets; `edges` writes the
    pairs out for those who ask for them.
    """
    nodes = t.symbols.where(F.col("kind").isin(CALLABLE)).select(F.col("symbol_id").alias("node"), "name", "path", "language", "kind", "qualifier")
    calls = with_key(resolved.where("kind = 'call' or kind = 'identifier'"), "target_id", nodes.select(F.col("node").alias("target_id"), F.col("kind").alias("t_kind"), F.col("qualifier").alias("t_qualifier")), "ref_id")
    up = cut(below(t))
    kin = cut(families(t, up))
    named = dispatch_sets(t, up, kin)
    calls = calls.withColumn("set_id", F.when((F.col("kind") == "call") & F.col("member") & (F.col("t_kind").isNull() | (F.col("confidence") >= FIELD)), F.concat_ws(":", family(F.col("language")), "name")))
    calls = cut(with_key(calls, "set_id", named.select("set_id").distinct().withColumn("open", F.lit(True)), "ref_id").withColumn("open", F.coalesce("open", F.lit(False))))
    sure = calls.where("t_kind is not null and not open")
    direct = sure.where("enclosing_id is not null").select(F.col("enclosing_id").alias("src"), F.col("target_id").alias("dst"), "path", F.col("start").alias("offset"), "confidence", F.lit("resolved").alias("origin"), F.lit(None).cast("string").alias("basis"))
    over = kin.select(F.concat(F.lit("over:"), "abstract_id").alias("set_id"), F.col("concrete_id").alias("dst"), F.lit("declared-supertype").alias("basis"))
    overridden = kin.select(F.col("abstract_id").alias("dst")).distinct()
    sites = direct.join(overridden, "dst", "left_semi").select("src", F.concat(F.lit("over:"), "dst").alias("set_id"), "path", "offset")
    sites = sites.union(calls.where("open and enclosing_id is not null").select(F.col("enclosing_id").alias("src"), "set_id", "path", F.col("start").alias("offset"))).withColumn("confidence", F.lit(FIELD))
    sets = over.union(named).withColumn("confidence", F.lit(FIELD)).join(sites.select("set_id").distinct(), "set_id", "left_semi")
    unresolved = calls.where("kind = 'call' and (t_kind is null and not open or open and enclosing_id is null)").select("path", "start", "name", "enclosing_id")
    file_scope = sure.where("enclosing_id is null and kind = 'call'").select("path", F.col("start").alias("offset"), F.col("target_id").alias("dst"), "confidence")
    return {"nodes": nodes, "direct": direct.dropDuplicates(["src", "dst", "path", "offset"]), "sites": sites.distinct(), "sets": sets, "unresolved": unresolved, "file_scope": file_scope}


def pairs(graph: dict[str, DataFrame]) -> DataFrame:
    """All edges (src, dst, path, offset, confidence, origin, basis), possible ones written out."""
    key = ["src", "dst", "path", "offset"]
    possible = graph["sites"].drop("confidence").join(graph["sets"], "set_id").select(*key, "confidence", F.lit("hierarchy").alias("origin"), "basis").join(graph["direct"].select(*key), key, "left_anti")
    return graph["direct"].unionByName(possible)


def walkable(graph: dict[str, DataFrame]) -> Factored:
    return Factored(graph["direct"], graph["sites"], graph["sets"])
