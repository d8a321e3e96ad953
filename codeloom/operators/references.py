"""The resolution cascade over fact tables (J1-J3, J8-J16, J25-J26, appendix A).

Every rule is a join that gives (ref_id, target, rule, confidence); an ambiguous answer is an answer too and stops the
cascade. The lowest rule wins by one aggregation. Rules that a second key decides (file, folder, receiver) join by name
and that key; rules that a name alone decides join counts of definitions by name, so a common name makes no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..schemas import CALLABLE, LANGUAGES, LOCAL, MEMBERS, STRING_KEYED, TYPES
from .facts import Tables, place
from .provenance import chart_keys, module_outputs, object_keys
from .resolving import EXACT, FIELD, IMPORTED, NAME, first_answer, with_key

SELF = ["self", "this", "cls"]
#: Groups of languages whose names may refer to each other; string-keyed names cross all of them.
FAMILIES = [["typescript", "tsx"], ["css", "scss"], ["yaml", "helm"]]
#: Rule -> tier of its only answer, tier of several; and the rules that take the first of several.
TIERS_OF = {1: (EXACT, FIELD), 2: (EXACT, FIELD), 3: (IMPORTED, FIELD), 4: (EXACT, EXACT), 5: (EXACT, EXACT), 6: (EXACT, NAME), 7: (IMPORTED, FIELD), 8: (IMPORTED, FIELD), 9: (IMPORTED, FIELD), 10: (EXACT, EXACT), 11: (EXACT, EXACT), 12: (IMPORTED, FIELD), 13: (EXACT, FIELD), 14: (FIELD, FIELD), 15: (NAME, NAME)}
#: Path receivers that no type answers: the module that a folder forms, and the module that a file's name is. They come behind rule 2.
BESIDE, STEM = 102, 103
TIERS_OF |= {BESIDE: (EXACT, FIELD), STEM: (IMPORTED, FIELD)}
KEEPS_FIRST = [1, 4, 5, 6, 7, 8, 9, 10, 11, 13]
RECEIVER_LANGUAGES = ["python", "rust", "typescript", "tsx", "go", "zig"]


def admissible(a: Column, b: Column, kind: Column) -> Column:
    """F21."""
    out = (a == b) | kind.isin(STRING_KEYED)
    for group in FAMILIES:
        out = out | a.isin(group) & b.isin(group)
    return out


def _spoken_in(language: Column, kind: Column) -> Column:
    """The languages whose references may mean a definition."""
    out = F.when(kind.isin(STRING_KEYED), F.array(*map(F.lit, LANGUAGES)))
    for group in FAMILIES:
        out = out.when(language.isin(group), F.array(*map(F.lit, group)))
    return out.otherwise(F.array(language))


def import_files(t: Tables) -> DataFrame:
    """(path, import_pos, file) by module path: relative and dotted forms, packages by __init__, unique stems last."""
    files = t.files.select("path", "language")
    folder = S.parent(F.col("path"))
    module = F.col("module")
    dotted = F.regexp_extract(module, r"^(\.*)(.*)$", 2)
    up = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    steps = F.split(folder, "/")
    base = F.when(up > 1, F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - (up - 1), F.lit(0))), "/")).otherwise(folder)
    inside = lambda b, p: F.when(b == "", p).otherwise(F.concat(b, F.lit("/"), p))
    as_path = F.translate(dotted, ".", "/")
    python = F.array(*[inside(base, F.concat(as_path, F.lit(x))) for x in (".py", "/__init__.py")], *[F.concat(as_path, F.lit(x)) for x in (".py", "/__init__.py")], inside(base, F.lit("__init__.py")))
    plain = F.regexp_replace(F.regexp_replace(inside(folder, module), r"(^|/)\./", "$1"), r"[^/]+/\.\./", "")
    script = F.array(*[F.concat(plain, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", ".css", ".scss")])
    java = F.array(F.concat(F.translate(module, ".", "/"), F.lit(".java")))
    rust = F.array(*[F.concat(F.lit("src/"), F.regexp_replace(F.regexp_replace(module, "^(crate|self|super)::", ""), "::", "/"), F.lit(x)) for x in (".rs", "/mod.rs")])
    tries = F.when(F.col("language") == "python", python).when(F.col("language") == "java", java).when(F.col("language") == "rust", rust).otherwise(script)
    asked = t.imports.select("path", "language", "import_pos", "module", F.posexplode(tries).alias("rank", "file"))
    direct = asked.join(files.select(F.col("path").alias("file")), "file").groupBy("path", "import_pos").agg(F.min_by("file", "rank").alias("file"))
    stems = files.select(S.stem(F.col("path")).alias("stem"), "language", F.col("path").alias("file")).groupBy("stem", "language").agg(F.count("*").alias("n"), F.min("file").alias("by_stem")).where("n = 1")
    last = F.element_at(F.split(F.regexp_replace(module, r"\.(ts|js|css|scss|zig)$", ""), r"[./]|::"), -1)
    loose = t.imports.select("path", "language", "import_pos", last.alias("stem")).join(stems, ["stem", "language"]).select("path", "import_pos", "by_stem")
    return t.imports.select("path", "import_pos").join(direct, ["path", "import_pos"], "left").join(loose, ["path", "import_pos"], "left").select("path", "import_pos", F.coalesce("file", "by_stem").alias("file")).where("file is not null and file <> path")


def resolve(t: Tables, found: DataFrame | None = None) -> DataFrame:
    """refs with target_id, confidence and the rule that answered. found: import_files, where it is at hand."""
    found = cut(import_files(t)) if found is None else found  # short plans: each of these tables is used by several rules
    bound = t.bindings.join(found, ["path", "import_pos"], "left").select("path", F.col("name").alias("bound"), "original", "module", F.col("file").alias("bound_file"))
    types = t.symbols.where(F.col("kind").isin(TYPES)).select("language", F.col("name").alias("receiver")).distinct().withColumn("receiver_is_type", F.lit(True))
    refs = t.refs.join(bound.select("path", F.col("bound").alias("receiver"), F.col("bound_file").alias("receiver_file"), F.lit(True).alias("receiver_bound")), ["path", "receiver"], "left")
    refs = refs.join(bound.select("path", F.col("bound").alias("name"), "original", "bound_file", F.lit(True).alias("name_bound")), ["path", "name"], "left")
    refs = with_key(refs, "receiver", types, "ref_id", ["language"])
    owner = t.symbols.select(F.col("symbol_id").alias("enclosing_id"), F.col("qualifier").alias("own_type"))
    refs = with_key(refs, "enclosing_id", owner, "ref_id")
    for c in ("receiver_bound", "name_bound", "receiver_is_type"):
        refs = refs.withColumn(c, F.coalesce(c, F.lit(False)))
    on_value = (F.col("kind") == "call") & F.col("receiver").isNotNull() & ~F.col("receiver_is_path") & ~F.col("receiver_bound")
    refs = refs.withColumn("member", (F.col("kind") == "field") | on_value)

    s = t.symbols.select(F.col("name").alias("s_name"), F.col("symbol_id").alias("target_id"), F.col("path").alias("s_path"), F.col("language").alias("s_language"), F.col("kind").alias("s_kind"), F.col("name_start").alias("s_at"), "full_start", "full_end", F.col("scope_id").alias("s_scope"), F.col("qualifier").alias("s_qualifier"), "exported", S.parent(F.col("path")).alias("s_folder"))
    shared = s.withColumn("language", F.explode(_spoken_in(F.col("s_language"), F.col("s_kind")))).groupBy(F.col("s_name").alias("name"), "language").agg((F.bool_or(F.col("s_kind") == "field") & F.bool_or(F.col("s_kind") == "method")).alias("both_kinds")).where("both_kinds")
    refs = cut(refs.withColumn("r_folder", S.parent(F.col("path"))).join(shared, ["name", "language"], "left").withColumn("both_kinds", F.coalesce("both_kinds", F.lit(False))))
    top = F.col("s_qualifier").isNull() & ~F.col("s_kind").isin(LOCAL)
    is_member = F.col("s_kind").isin(MEMBERS) & F.col("s_qualifier").isNotNull()
    plain = F.col("kind") != "string-ref"
    nil = lambda c: F.coalesce(c, F.lit(False))

    # A name that fields and methods share: a call means the methods, any other access the fields.
    other = F.col("member") & F.col("both_kinds") & (((F.col("kind") == "call") & (F.col("s_kind") == "field")) | ((F.col("kind") == "field") & (F.col("s_kind") == "method")))

    def met(left: DataFrame, *keys: tuple[str, str]) -> DataFrame:
        """References with the symbols of their name that a second key has in common too: a common name alone makes no pairs."""
        test = F.col("name") == F.col("s_name")
        for r, k in keys:
            test = test & (F.col(r) == F.col(k))
        return left.join(s, test).where(admissible(F.col("language"), F.col("s_language"), F.col("s_kind")) & ~other)

    def ordered(df: DataFrame, rule, a=None, b=None, c=None) -> DataFrame:
        zero = F.lit(0)
        order = F.struct((zero if a is None else a).cast("int").alias("a"), (zero if b is None else b).cast("int").alias("b"), (zero if c is None else c).cast("bigint").alias("c"), F.col("target_id").alias("t"))
        return df.select("ref_id", "target_id", (F.lit(rule) if isinstance(rule, int) else rule).alias("rule"), order.alias("o"))

    # In the reference's own file: members for members, locals only from their own scope chain, never the binding being defined.
    chain = t.scope_chain.select("path", "scope_id", F.col("ancestor_id").alias("s_scope"), "distance")
    local = met(refs.where(plain & ~F.col("in_import")), ("path", "s_path")).join(chain, ["path", "scope_id", "s_scope"], "left")
    binding = F.col("s_kind").isin(*LOCAL)
    own_value = (F.col("s_kind") == "variable") & (F.col("full_start") <= F.col("start")) & (F.col("start") < F.col("full_end"))
    fits = F.when(F.col("member"), is_member).otherwise(~is_member | F.col("receiver_bound") | ~F.col("language").isin(RECEIVER_LANGUAGES))
    local = local.where(fits & (F.col("expects").isNull() | (F.col("expects") == F.col("s_kind"))) & ~own_value & (~binding | F.col("distance").isNotNull()))
    inside = {
        4: F.col("member") & F.col("receiver").isin(SELF) & (F.col("s_qualifier") == F.col("own_type")),
        5: ~F.col("member") & F.col("distance").isNotNull(),
        6: ~F.col("member"),
    }
    local = local.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(nil(x), F.lit(r)) for r, x in inside.items()]))))
    five, far = F.col("rule") == 5, F.abs(F.col("s_at") - F.col("start"))
    rows = ordered(local, F.col("rule"), F.when(five, F.col("distance")).otherwise(0), F.when(five & binding & (F.col("s_at") > F.col("start")), 1).otherwise(0), F.when(F.col("rule").isin(5, 6), far).otherwise(0))

    # By a second key: the receiver, the folder, the file that an import names.
    files = t.imports.join(found, ["path", "import_pos"]).select("path", F.col("start").alias("i_start"), F.col("end").alias("i_end"), "is_glob", "file")
    named = refs.where("in_import").join(files, "path").where("i_start <= start and start < i_end").select(*refs.columns, "file").distinct()
    globbed = refs.where(plain & ~F.col("member")).join(files.where("is_glob").select("path", "file").distinct(), "path")
    expected = F.when(F.col("expects").isNotNull(), F.col("s_kind") == F.col("expects")).otherwise(F.col("s_kind").isin(STRING_KEYED))
    keyed = ~plain & ~((F.col("language") == "helm") & nil(F.col("expects") == "key")) & ~nil(F.col("receiver").rlike("^(ConfigMap|Secret)/"))
    for r, df in (
        (1, met(refs.where("language = 'hcl'"), ("r_folder", "s_folder"), ("receiver", "s_qualifier"))),
        (2, met(refs.where(plain & (F.col("receiver_is_path") | F.col("receiver_is_type"))), ("receiver", "s_qualifier"), ("language", "s_language"))),
        (3, met(refs.where(plain & F.col("receiver_bound")), ("receiver_file", "s_path")).where(top)),
        (7, met(named, ("file", "s_path")).where(top)),
        (BESIDE, met(refs.where(plain & F.col("receiver_is_path") & F.col("receiver").isin("super", "self")), ("r_folder", "s_folder"), ("language", "s_language")).where("s_qualifier is null")),
        (12, met(globbed, ("file", "s_path")).where(top)),
        (13, met(refs.where(plain & F.col("language").isin("go", "hcl") & ~F.col("member")), ("r_folder", "s_folder")).where(top)),
    ):
        rows = rows.union(ordered(df, r))
    # A module's name is its file's, or its folder's where the file is the folder's own.
    stem, own_file = S.stem(F.col("s_path")), S.stem(F.col("s_path")).isin("mod", "lib")
    modules = s.where(top).withColumn("s_module", F.explode(F.when(own_file, F.array(stem, F.element_at(F.split("s_folder", "/"), -1))).otherwise(F.array(stem))))
    asked = refs.where(plain & F.col("receiver_is_path"))
    by_stem = asked.join(modules, (F.col("name") == F.col("s_name")) & (F.col("receiver") == F.col("s_module")) & (F.col("language") == F.col("s_language"))).where(~other)
    rows = rows.union(ordered(by_stem, STEM))
    imported = refs.where(plain & F.col("name_bound")).withColumn("wanted", F.when(F.col("original").isin("*", "default"), F.col("name")).otherwise(F.col("original")))
    fitting = admissible(F.col("language"), F.col("s_language"), F.col("s_kind"))
    from_import = imported.where("bound_file is not null").join(s, (F.col("wanted") == F.col("s_name")) & (F.col("bound_file") == F.col("s_path"))).where(top & fitting)
    for r, df in ((8, from_import), (9, _barrels(imported, t, found, s, top)), (12, _packages(refs, t, s)), (1, module_outputs(t, refs)), (10, object_keys(t, refs)), (10, chart_keys(t, refs))):
        rows = rows.union(ordered(df, r))
    grouped = rows.groupBy("ref_id", "rule").agg(F.min("o").alias("o"), F.count_distinct("target_id").alias("n"))

    # By the name alone: only how many definitions there are and the least of them, counted for each name before references are met.
    spoken = s.withColumn("language", F.explode(_spoken_in(F.col("s_language"), F.col("s_kind")))).withColumnRenamed("s_name", "name")
    least = [F.min("target_id").alias("t"), F.count_distinct("target_id").alias("n")]
    by_kind = spoken.groupBy("name", "language", "s_kind").agg(*least)
    strings = refs.where(keyed & F.col("receiver").isNull()).join(by_kind, ["name", "language"]).where(expected).select("ref_id", F.lit(10).alias("rule"), "t", "n")
    owned = spoken.where("s_qualifier is not null").groupBy("name", "language", "s_kind", F.col("s_qualifier").alias("receiver")).agg(*least)
    strings = strings.union(refs.where(keyed & F.col("receiver").isNotNull()).join(owned, ["name", "language", "receiver"]).where(expected).select("ref_id", F.lit(10).alias("rule"), "t", "n"))
    slugs = s.where("s_kind = 'heading'").groupBy(S.anchor_slug(F.col("s_name")).alias("name")).agg(*least)
    strings = strings.union(refs.where("kind = 'string-ref' and (expects = 'heading' or expects is null)").join(slugs, "name").select("ref_id", F.lit(11).alias("rule"), "t", "n"))
    members = refs.where(plain & F.col("member")).join(spoken.where(is_member).groupBy("name", "language", "s_kind").agg(*least), ["name", "language"]).where(~other).select("ref_id", F.lit(14).alias("rule"), "t", "n")

    def elsewhere(asked: DataFrame, name: str, rule: int) -> DataFrame:
        """Exported definitions in other files than the reference's: the first file's, or the second's where the first is its own."""
        each = cut(spoken.where(top & F.col("exported")).groupBy(F.col("name").alias(name), "language", "s_path").agg(*least))
        first = each.groupBy(name, "language").agg(F.sum("n").alias("total"), F.min(F.struct("s_path", "t")).alias("first"))
        second = each.join(first.select(name, "language", "first"), [name, "language"]).where("s_path <> first.s_path").groupBy(name, "language").agg(F.min(F.struct("s_path", "t")).alias("second"))
        own = each.select(name, "language", F.col("s_path").alias("path"), F.col("n").alias("own"))
        met_ = asked.join(first, [name, "language"]).join(second, [name, "language"], "left").join(own, [name, "language", "path"], "left")
        n = F.col("total") - F.coalesce("own", F.lit(0))
        return met_.select("ref_id", F.lit(rule).alias("rule"), F.when(F.col("first.s_path") != F.col("path"), F.col("first.t")).otherwise(F.col("second.t")).alias("t"), n.alias("n")).where("n > 0")

    counted = strings.union(members).union(elsewhere(refs.where(plain & ~F.col("member")), "name", 15)).union(elsewhere(imported.where("bound_file is null"), "wanted", 8))
    zero = [F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("c")]
    grouped = grouped.union(counted.select("ref_id", "rule", F.struct(*zero, "t").alias("o"), "n")).groupBy("ref_id", "rule").agg(F.min("o").alias("o"), F.sum("n").alias("n"))
    hit, vague = F.lit(EXACT), F.lit(FIELD)
    for r, (h, v) in TIERS_OF.items():
        hit, vague = F.when(F.col("rule") == r, h).otherwise(hit), F.when(F.col("rule") == r, v).otherwise(vague)
    one = F.col("n") == 1
    answered = grouped.select("ref_id", F.when(one | F.col("rule").isin(*KEEPS_FIRST), F.col("o.t")).alias("target_id"), F.when(one, hit).otherwise(vague).cast("int").alias("confidence"), "rule")
    place_of = F.when(F.col("rule") == BESIDE, 21).when(F.col("rule") == STEM, 22).otherwise(F.col("rule") * 10)
    out = first_answer(refs, "ref_id", "target_id", [answered.withColumn("rule", place_of)])
    out = out.withColumn("rule", F.when(F.col("rule") == 21, BESIDE).when(F.col("rule") == 22, STEM).when(F.col("rule") == 99, 99).otherwise((F.col("rule") / 10).cast("int")))
    untyped = F.col("kind").isin("field", "call") & F.col("receiver").isNotNull() & ~F.col("receiver").isin(SELF) & ~F.col("receiver_is_path") & ~F.col("receiver_bound") & ~F.col("receiver_is_type") & (F.col("language") != "hcl")
    return out.withColumn("confidence", F.when(untyped, F.greatest("confidence", F.lit(FIELD))).otherwise(F.col("confidence"))).select(*t.refs.columns, "target_id", "confidence", "rule", "member", "receiver_bound")


def affected(before: Tables, after: Tables, changed: DataFrame, links: DataFrame) -> DataFrame:
    """The references of `after` whose answers the changed files (path) may alter; all others keep theirs.

    An answer comes from definitions of a name, in files that imports lead to. So those are affected that stand in a
    changed file, that name or are received by something a changed file defines or defined, or whose file imports a changed
    one, directly or through others that hand names on. links: import_files of both.
    """
    from .graphs import reach

    names = lambda t: t.symbols.join(changed, "path", "left_semi").select("name", S.anchor_slug(F.col("name")).alias("slug"))
    both = names(before).union(names(after))
    spoken = cut(both.select("name").union(both.select("slug")).union(both.select(F.substring_index("name", ".", -1))).distinct())
    links = links.select(F.col("file").alias("src"), F.col("path").alias("dst")).distinct()
    importers = reach(links, changed.select(F.col("path").alias("node")), rounds=64).select(F.col("node").alias("path"))
    refs = after.refs
    hit = refs.join(spoken, "name", "left_semi").select("ref_id")
    hit = hit.union(refs.join(spoken.withColumnRenamed("name", "receiver"), "receiver", "left_semi").select("ref_id"))
    hit = hit.union(refs.join(importers.distinct(), "path", "left_semi").select("ref_id"))
    return refs.join(hit.distinct(), "ref_id", "left_semi")


def _barrels(imported: DataFrame, t: Tables, found: DataFrame, s: DataFrame, top: Column, hops: int = 8) -> DataFrame:
    """Follows names through files that import and re-export them, a hop at a time, up to the reference's bound. A name that is found goes no further."""
    again = cut(t.bindings.join(found, ["path", "import_pos"]).select(F.col("path").alias("at"), F.col("name").alias("wanted"), F.col("original").alias("next_wanted"), F.col("file").alias("next_at")).distinct())
    walk = imported.where("bound_file is not null").select("ref_id", F.col("bound_file").alias("at"), "wanted")
    out = []
    for _ in range(hops):
        walk = cut(walk.join(again, ["at", "wanted"]).select("ref_id", F.col("next_at").alias("at"), F.col("next_wanted").alias("wanted")).distinct())
        out.append(walk.join(s, (F.col("wanted") == F.col("s_name")) & (F.col("at") == F.col("s_path"))).where(top).select("ref_id", "target_id"))
        if walk.isEmpty():
            break
        walk = walk.join(out[-1], "ref_id", "left_anti")
    return reduce(DataFrame.unionByName, out)


def _packages(refs: DataFrame, t: Tables, s: DataFrame) -> DataFrame:
    """Go names in the one folder that ends with the longest suffix of an import's path."""
    from .resolving import longest_suffix_folder

    wanted = t.bindings.where("language = 'go'").select("path", F.col("name").alias("receiver"), "module")
    folders = t.files.where("language = 'go'").select(S.parent(F.col("path")).alias("folder")).where("folder <> ''").distinct()
    located = longest_suffix_folder(wanted, "module", folders, "folder").where("folder is not null").select("path", "receiver", "folder")
    asked = refs.where("language = 'go' and receiver_bound").join(located, ["path", "receiver"])
    return asked.join(s, (F.col("name") == F.col("s_name")) & (F.col("folder") == F.col("s_folder"))).where(F.col("exported") & F.col("s_qualifier").isNull())


def entity_key(kind: Column, name: Column, path: Column, language: Column, container: Column, qualifier: Column, symbol: Column) -> Column:
    """What makes several sites one entity."""
    multi = kind.isin("selector", "property", "element-id", "data-attribute")
    overloads = language.isin("typescript", "tsx") & kind.isin(CALLABLE) | (language == "python") & (kind == "method")
    part = F.lit("|")
    none = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(multi, F.concat(name, part, kind))
        .when(overloads, F.concat(name, part, kind, part, path, part, none(container)))
        .when(language.isin("helm", "yaml") & (kind == "key"), F.concat(name, part, none(qualifier), part, F.regexp_extract(path, r"^(.*?)(?:/templates)?/[^/]*$", 1)))
        .when((kind == "field") & qualifier.isNotNull(), F.concat(name, part, kind, part, qualifier, part, path))
        .otherwise(symbol)
    )


def with_entities(symbols: DataFrame) -> DataFrame:
    c = F.col
    return symbols.withColumn("entity", entity_key(c("kind"), c("name"), c("path"), c("language"), c("container_id"), c("qualifier"), c("symbol_id")))


__all__ = ["admissible", "entity_key", "import_files", "place", "resolve", "with_entities"]
