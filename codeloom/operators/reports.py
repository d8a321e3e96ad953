"""The user-visible reports (Q rows) as DataFrame plans over fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..schemas import CALLABLE, IMPERATIVE, LANGUAGES, LOCAL
from .calls import families, walkable
from .clones import greedy_cover
from .facts import Tables
from .graphs import Seen, dead_cycles, reach, taint, trace
from .references import with_entities
from .resolving import FIELD, containing, tier_name, with_key

# -- statistics ----------------------------------------------------------------------------------------------------------


def stats(t: Tables, resolved: DataFrame) -> DataFrame:
    """Q2, A1: per language."""
    f = t.files.groupBy("language").agg(F.count("*").alias("files"))
    s = t.symbols.groupBy("language").agg(F.count("*").alias("symbols"))
    r = resolved.groupBy("language").agg(F.count("*").alias("references"), F.count("target_id").alias("resolved"), *[F.count_if(F.col("target_id").isNotNull() & (F.col("confidence") == i)).alias(n.replace("-", "_")) for i, n in enumerate(("exact", "import-qualified", "field-based", "name-only"))])
    return f.join(s, "language", "left").join(r, "language", "left").na.fill(0)


def parse_tally(t: Tables) -> DataFrame:
    """A2, Q20."""
    n = t.nested.select("language", F.size("errors").alias("e"))
    return n.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("e") > 0).alias("with_errors"), F.sum("e").alias("error_nodes"))


# -- definitions and uses ------------------------------------------------------------------------------------------------


def definitions(t: Tables, name: str) -> DataFrame:
    """Q3: sites of a name: primary, same entity, implementations; a site has its strongest role."""
    every = with_entities(t.symbols)
    hit = every.where((F.col("qualified_name") == name) | (F.col("name") == name.rpartition("::")[2]))
    exact = hit.where(F.col("qualified_name") == name)
    found = exact if not exact.isEmpty() else hit
    kin = families(t).join(found.select(F.col("symbol_id").alias("abstract_id")), "abstract_id", "left_semi").select(F.col("concrete_id").alias("symbol_id"), F.lit(2).alias("role"))
    same = every.join(found.select("entity").distinct(), "entity", "left_semi").select("symbol_id", F.lit(1).alias("role"))
    first = found.groupBy("entity").agg(F.min("symbol_id").alias("symbol_id")).select("symbol_id", F.lit(0).alias("role"))
    role = first.union(same).union(kin).groupBy("symbol_id").agg(F.min("role").alias("role"))
    return t.symbols.join(role, "symbol_id").select("path", "name_start", "name", "kind", "qualified_name", F.element_at(F.array(F.lit("primary"), F.lit("same-entity"), F.lit("implementation")), F.col("role") + 1).alias("role"))


def first_definition(t: Tables, name: str) -> DataFrame:
    """The best single site: the primary one, then the exported, then by place."""
    role = F.array_position(F.array(F.lit("primary"), F.lit("same-entity"), F.lit("implementation")), F.col("role"))
    exported = t.symbols.select("path", "name_start", "exported")
    return definitions(t, name).join(exported, ["path", "name_start"]).orderBy(role, F.desc("exported"), "path", "name_start").limit(1)


def references_to(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Refs of the symbols in column symbol_id."""
    return resolved.join(targets.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi")


def definition_at(t: Tables, resolved: DataFrame, path: str, offset: int) -> DataFrame:
    """the symbol whose name holds a byte offset, else the target of the reference there."""
    own = t.symbols.where((F.col("path") == path) & (F.col("name_start") <= offset) & (F.lit(offset) < F.col("name_end"))).select("symbol_id", F.lit(0).alias("rank"))
    used = reference_at(resolved, path, offset).where("target_id is not null").select(F.col("target_id").alias("symbol_id"), F.lit(1).alias("rank"))
    best = own.union(used).groupBy().agg(F.min_by("symbol_id", "rank").alias("symbol_id"))
    return t.symbols.join(best, "symbol_id")


def reference_at(resolved: DataFrame, path: str, offset: int) -> DataFrame:
    """the first reference that holds a byte offset."""
    return resolved.where((F.col("path") == path) & (F.col("start") <= offset) & (F.lit(offset) < F.col("end"))).orderBy("start").limit(1)


def graph_summary(graph: dict) -> DataFrame:
    """Edges by tier and origin."""
    direct = graph["direct"].groupBy("confidence", "origin").agg(F.count("*").alias("edges"))
    # The pairs of a set are counted as a product; those that repeat a direct edge don't count.
    size = graph["sets"].groupBy("set_id").agg(F.count("*").alias("members"))
    possible = graph["sites"].groupBy("set_id").agg(F.count("*").alias("n")).join(size, "set_id").agg(F.coalesce(F.sum(F.col("n") * F.col("members")), F.lit(0)).alias("edges"))
    again = graph["direct"].select("src", "dst", "path", "offset").join(graph["sites"].select("src", "path", "offset", "set_id"), ["src", "path", "offset"]).join(graph["sets"].select("set_id", "dst"), ["set_id", "dst"], "left_semi")
    possible = possible.union(again.agg(-F.count("*"))).agg(F.sum("edges").alias("edges")).where("edges > 0")
    rows = direct.union(possible.select(F.lit(FIELD).alias("confidence"), F.lit("hierarchy").alias("origin"), "edges"))
    return rows.groupBy(tier_name(F.col("confidence")).alias("tier"), "origin").agg(F.sum("edges").cast("int").alias("edges"))


def hierarchy_callers(graph: dict, target: DataFrame) -> DataFrame:
    """Callers that reach a symbol through the type hierarchy alone."""
    sets = graph["sets"].join(target.select(F.col("symbol_id").alias("dst")), "dst", "left_semi").select("set_id").distinct()
    return graph["sites"].join(sets, "set_id", "left_semi").select(F.col("src").alias("node")).distinct()


def holders(t: Tables, symbols: DataFrame) -> DataFrame:
    """Everything that contains the symbols, up their container chains."""
    up = t.symbols.where("container_id is not null").select(F.col("symbol_id").alias("src"), F.col("container_id").alias("dst"))
    return reach(up, symbols.select(F.col("symbol_id").alias("node"))).join(symbols.select(F.col("symbol_id").alias("node")), "node", "left_anti")


def mentions(t: Tables, word: str) -> DataFrame:
    """Q18: whole-word hits in strings, comments and prose, with their byte offset."""
    part = F.regexp_instr("text", F.lit(S.word_pattern(word)))
    hit = t.texts.where(S.whole_word(F.col("text"), word))
    return hit.select("path", "language", (F.col("start") + F.octet_length(F.substring("text", F.lit(1), part - 1))).alias("start"), "text")


def usages(t: Tables, resolved: DataFrame, name: str) -> DataFrame:
    """Q6: references of the entity and its implementations, same-named references that resolve elsewhere or nowhere, and mentions in text."""
    sites = definitions(t, name).select(F.concat("path", F.lit(":"), F.lpad(F.col("name_start").cast("string"), 9, "0")).alias("symbol_id"))
    leaf = name.rpartition("::")[2]
    of = references_to(resolved, sites).select("path", "start", F.lit("reference").alias("kind"), "confidence")
    same = resolved.where(F.col("name") == leaf).join(sites.select(F.col("symbol_id").alias("target_id")), "target_id", "left_anti").select("path", "start", F.lit("same-name").alias("kind"), "confidence")
    known = of.unionByName(same)
    text = mentions(t, leaf).select("path", "start", F.lit("textual").alias("kind"), F.lit(None).cast("int").alias("confidence")).join(known.select("path", "start"), ["path", "start"], "left_anti")
    return known.unionByName(text)


def impact(t: Tables, resolved: DataFrame, graph: dict, name: str, depth: int = 3) -> DataFrame:
    """Q9: references, callers up to `depth` by the best route's weakest link, cross-language references, mentions."""
    target = t.symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
    refs = references_to(resolved, target)
    of = target.select(F.col("symbol_id").alias("target_id"), F.col("language").alias("t_language"))
    rows = refs.join(of, "target_id").select(F.when(F.col("language") == F.col("t_language"), "reference").otherwise("cross-language").alias("kind"), "path", F.col("start").alias("at"), "confidence", F.lit(1).alias("depth"))
    callers = taint(walkable(graph), target.select(F.col("symbol_id").alias("node")), depth).join(graph["nodes"].select("node", "path"), "node")
    rows = rows.unionByName(callers.select(F.lit("caller").alias("kind"), "path", F.element_at(F.split("node", ":"), -1).cast("bigint").alias("at"), F.col("tier").alias("confidence"), "depth"))
    text = mentions(t, name).select(F.lit("textual").alias("kind"), "path", F.col("start").alias("at"), F.lit(None).cast("int").alias("confidence"), F.lit(0).alias("depth"))
    return rows.unionByName(text.join(rows.select("path", "at"), ["path", "at"], "left_anti"))


# -- entry points and unused ---------------------------------------------------------------------------------------------


def entry_points(t: Tables, resolved: DataFrame, rules: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Symbols that a rule's conditions all fit, and what packages name as their commands; null conditions fit everything. One row for each symbol and kind."""
    c = F.col
    notes = t.notes.where("owner >= 0 and name not like '@%'").select("symbol_id", F.struct("name", F.coalesce("arg", F.lit("")).alias("arg")).alias("note"))
    s = t.symbols.join(notes.groupBy("symbol_id").agg(F.collect_set("note").alias("notes")), "symbol_id", "left")
    guard = t.notes.where("name = 'main-guard'").select("path", c("arg").alias("name")).distinct().withColumn("guarded", F.lit(True))
    s = s.join(guard, ["path", "name"], "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
    textual = [r["language"] for r in rules.where("keyword is not null or directive is not null").select("language").distinct().collect()]  # rules are written by hand: a small table
    if textual:
        s = s.join(_heads(t, textual), "symbol_id", "left")
    else:
        s = s.withColumn("first_word", F.lit(None).cast("string")).withColumn("directives", F.lit(None).cast("array<string>"))
    every = F.array(*map(F.lit, sorted(LANGUAGES)))
    r = rules.withColumn("language", F.explode(F.when(F.col("language").isNull(), every).otherwise(F.array("language"))))
    r = r.withColumnsRenamed({"language": "r_language", "kind": "entry_kind", "keyword": "r_keyword", "directive": "r_directive"})
    tests = {
        "r_language": c("language") == c("r_language"), "name_is": c("name") == c("name_is"), "name_starts": c("name").startswith(c("name_starts")), "name_ends": c("name").endswith(c("name_ends")), "symbol_kind": c("kind") == c("symbol_kind"),
        "file_is": S.file_name(c("path")) == c("file_is"), "path_contains": c("path").contains(c("path_contains")), "path_starts": c("path").startswith(c("path_starts")), "path_ends": c("path").endswith(c("path_ends")), "path_matches": F.rlike(c("path"), c("path_matches")),
        "annotation": F.exists(F.coalesce(c("notes"), F.array().cast("array<struct<name:string,arg:string>>")), lambda n: ((n["name"] == c("annotation")) | n["name"].endswith(F.concat(F.lit("."), c("annotation")))) & (c("argument_starts").isNull() | n["arg"].startswith(c("argument_starts")))),
        "r_keyword": c("first_word") == c("r_keyword"), "r_directive": F.array_contains(c("directives"), c("r_directive")), "main_guard": c("guarded") == c("main_guard"), "is_exported": c("exported") == c("is_exported"), "top_level": c("container_id").isNull() == c("top_level"),
    }
    fits = F.lit(True)
    for name, test in tests.items():
        fits = fits & (c(name).isNull() | F.coalesce(test, F.lit(False)))
    found = s.join(_bounded(r), fits & (c("language") == c("r_language"))).select("symbol_id", "entry_kind", "rule", "threat_model")
    found = found.union(packaged(t, resolved, t.files if files is None else files).select("symbol_id", F.lit("main"), "rule", F.lit("local")))
    return found.groupBy("symbol_id", "entry_kind").agg(F.min("rule").alias("rule"), F.min_by("threat_model", "rule").alias("threat_model")).withColumnRenamed("entry_kind", "kind")


def _bounded(rules: DataFrame, most: int = 20_000) -> DataFrame:
    """The rules as a broadcast side while they are no more than `most`; a user's catalog beyond that is joined by language."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules


DIRECTIVE = r"""["'](use [a-z]+)["']"""
#: White space and comments, of any length.
_BLANK = r"(?:\s++|//[^\n]*+|/\*(?s:.*?)\*/)*+"


def _heads(t: Tables, languages: list[str]) -> DataFrame:
    """(symbol_id, first word of its declaration, directives at the top of its file and body)."""
    file = F.regexp_extract("text", r"\A" + _BLANK + DIRECTIVE, 1)
    files = t.files.where(F.col("language").isin(languages)).select("path", F.col("text").cast("binary").alias("raw"), file.alias("file_directive"))
    own = t.symbols.where(F.col("language").isin(languages) & (F.col("kind") != "parameter")).select("path", "symbol_id", "full_start", "full_end").join(files, "path")
    whole = F.decode(F.expr("substring(raw, int(full_start + 1), int(full_end - full_start))"), "utf-8")
    own = own.select("symbol_id", "file_directive", whole.alias("whole"))
    return own.select("symbol_id", F.regexp_extract("whole", r"\A" + _BLANK + r"(\w+)", 1).alias("first_word"), F.array("file_directive", F.regexp_extract("whole", r"\A[^{]*\{" + _BLANK + DIRECTIVE, 1)).alias("directives"))


def packaging_scripts(files: DataFrame) -> DataFrame:
    """(path, script, module, function) of commands that setup.py, setup.cfg and pyproject.toml declare, read line by line."""
    target = r"""^\s*["']?([\w.-]+)\s*["']?\s*=\s*["']?([\w.]+):([\w.]+)["']?\s*,?\s*$"""
    inline = r"""["']([\w.-]+)\s*=\s*([\w.]+):([\w.]+)["']"""
    name = S.file_name(F.col("path"))
    toml = files.where(name == "pyproject.toml").select("path", F.explode(F.split(F.regexp_extract("text", r"(?s)\[(?:project\.scripts|tool\.poetry\.scripts)\]\n(.*?)(?:\n\[|\z)", 1), "\n")).alias("line"), F.lit(target).alias("pattern"))
    setup = files.where(name.isin("setup.py", "setup.cfg")).where(F.col("text").contains("console_scripts")).select("path", F.explode(F.split(F.regexp_extract("text", r"(?s)console_scripts(.*)", 1), "[\n,]")).alias("line"), F.when(name == "setup.py", inline).otherwise(target).alias("pattern"))
    rows = toml.union(setup)
    part = lambda i: F.when(F.col("pattern") == target, F.regexp_extract("line", target, i)).otherwise(F.regexp_extract("line", inline, i))
    return rows.select("path", part(1).alias("script"), part(2).alias("module"), part(3).alias("function")).where("script <> ''")


def packaged(t: Tables, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, rule) of functions that installed commands name, and of those that a __main__.py calls outside its functions."""
    scripts = packaging_scripts(files).select(F.explode(F.array(*[F.concat(F.lit(a), F.translate("module", ".", "/"), F.lit(b)) for a in ("", "src/") for b in (".py", "/__init__.py")])).alias("path"), F.col("function").alias("name"))
    named = t.symbols.where("kind = 'function'").join(scripts.distinct(), ["path", "name"], "left_semi").select("symbol_id", F.lit("python-console-script").alias("rule"))
    calls = resolved.where("kind = 'call' and enclosing_id is null and target_id is not null").where(S.file_name(F.col("path")) == "__main__.py")
    run = t.symbols.where(F.col("kind").isin(CALLABLE)).join(calls.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_semi").select("symbol_id", F.lit("python-package-main").alias("rule"))
    return named.union(run)


def unused(t: Tables, resolved: DataFrame, graph: dict, entries: DataFrame) -> DataFrame:
    """Symbols that no root reaches and nothing outside themselves refers to, and members of dead cycles; spared ones keep their first reason.

    What only the type hierarchy reaches is on the list too, spared as reached by dispatch.
    """
    seeds = entries.select(F.col("symbol_id").alias("node"))
    module = graph["file_scope"].select(F.col("dst").alias("node"))
    roots = seeds.union(module).distinct()
    reached = reach(walkable(graph), roots).select(F.col("node").alias("symbol_id"), F.lit(True).alias("reached"))
    directly = reach(graph["direct"], roots).select(F.col("node").alias("symbol_id"), F.lit(True).alias("directly"))
    dispatched = graph["sets"].select(F.col("dst").alias("symbol_id"), F.lit(True).alias("dispatched")).distinct()
    every = with_entities(t.symbols).where(~F.col("kind").isin("parameter", "key", "link-def"))
    inside = resolved.where("target_id is not null and not in_import").join(t.symbols.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("t_path"), "full_start", "full_end", F.col("name").alias("t_name"), F.col("kind").alias("t_kind")), "target_id")
    outside = inside.where("path <> t_path or start < full_start or start >= full_end")
    strong = outside.where(F.col("confidence") < FIELD).select("target_id")
    entity = with_entities(t.symbols).select("symbol_id", "entity")
    held = strong.join(entity.withColumnRenamed("symbol_id", "target_id"), "target_id").select("entity").distinct().withColumn("held", F.lit(True))
    weak = outside.where(F.col("confidence") >= FIELD).select(F.col("t_name").alias("name")).union(resolved.where("target_id is null and member").select("name")).distinct().withColumn("namesake", F.lit(True))
    callers = resolved.where("target_id is not null").select(F.col("enclosing_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    cycles = dead_cycles(callers, reached.withColumnRenamed("symbol_id", "node")).select(F.col("node").alias("symbol_id"), F.lit(True).alias("in_dead_cycle"))
    words = t.texts.where("language <> 'markdown'").select(F.explode(F.split("text", r"[^A-Za-z0-9_$-]+")).alias("w")).where("w <> ''").select(S.loose(F.col("w")).alias("loose")).distinct().withColumn("said", F.lit(True))
    holding = holders(t, t.symbols.join(entries.select("symbol_id"), "symbol_id", "left_semi")).select(F.col("node").alias("symbol_id"), F.lit(True).alias("holding"))
    own_types = t.symbols.where(F.col("kind").isin("trait", "interface")).select(F.col("name").alias("parent"))
    foreign = t.supertypes.where("language = 'rust'").join(own_types, "parent", "left_anti").select("language", F.col("type").alias("qualifier")).distinct().withColumn("foreign", F.lit(True))
    properties = words.select(F.col("loose").alias("property"), F.lit(True).alias("by_property"))
    out = every.withColumn("loose", S.loose(F.col("name"))).withColumn("property", F.when(F.col("language") == "java", S.loose(S.bean_property(F.col("name")))))
    out = with_key(with_key(out, "qualifier", foreign, "symbol_id", ["language"]), "property", properties, "symbol_id")
    for df, key in ((reached, "symbol_id"), (held, "entity"), (weak, "name"), (cycles, "symbol_id"), (words, "loose"), (directly, "symbol_id"), (dispatched, "symbol_id"), (holding, "symbol_id"), (seeds.select(F.col("node").alias("symbol_id"), F.lit(True).alias("entry")).distinct(), "symbol_id")):
        out = out.join(df, key, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    orphan = no("reached") & no("held") & no("entry")
    c = F.col
    reason = (
        F.when((c("language") == "hcl") & (c("kind") == "block") & (c("qualifier") == c("name")), "no-address").when(c("kind") == "heading", "structures-prose").when((c("kind") == "module") & c("language").isin("go", "java"), "names-the-files-place")
        .when(c("name").startswith("_"), "underscore").when(~no("namesake"), "ambiguous-name").when(~no("holding"), "holds-an-entry-point").when(~no("foreign") & (c("kind") == "method"), "implements-foreign-trait").when(~no("by_property"), "reached-by-its-property").when(~no("said"), "named-in-text")
    )
    by_dispatch = ~orphan & no("directly") & no("held") & no("entry") & ~no("dispatched")
    listed = orphan | ~no("in_dead_cycle") & no("entry")
    kept = F.when(listed, reason).otherwise("dynamic-dispatch")
    return out.where(listed | by_dispatch).select("path", "name_start", "name", "kind", "exported", F.coalesce("in_dead_cycle", F.lit(False)).alias("in_dead_cycle"), kept.alias("spared"))


# -- clones --------------------------------------------------------------------------------------------------------------


def duplicates(t: Tables, floor: int = 60, config_floor: int = 30) -> DataFrame:
    """Q12: maximal clones: subtrees of equal hash in a language, at least `floor` tokens, largest first, without the copies inside accepted larger ones."""
    big = t.subtrees.where(F.col("tokens") >= F.when(F.col("language").isin(IMPERATIVE), floor).otherwise(config_floor))
    some = big.groupBy("language", "hash").agg(F.count("*").alias("n")).where("n > 1")  # hashes that occur once go before anything is gathered
    rows = big.join(some.select("language", "hash"), ["language", "hash"], "left_semi")
    kept = greedy_cover(rows.select(F.concat_ws(":", "language", "hash").alias("class"), "path", "start", "end", "tokens", "depth"))
    out = kept.groupBy("class").agg(F.max("tokens").alias("tokens"), F.count("*").alias("instances"), F.sort_array(F.collect_list(F.struct("path", "start", "end"))).alias("places"))
    return out.select(F.substring_index("class", ":", 1).alias("language"), F.substring_index("class", ":", -1).alias("hash"), "tokens", "instances", "places", (F.col("tokens") * (F.col("instances") - 1)).alias("redundant"))


# -- data flow -----------------------------------------------------------------------------------------------------------


def _flows(t: Tables, uses: DataFrame) -> DataFrame:
    """(symbol_id, ref_id): a definition and the references that its initialiser holds."""
    return containing(uses.select("ref_id", "path", "start"), t.flows.select("path", "symbol_id", "source_start", "source_end"), ["path"], "ref_id", "source_start", "source_end", "symbol_id", "start").select("symbol_id", "ref_id").distinct()


def flow_backward(t: Tables, resolved: DataFrame, start: str, depth: int = 8) -> DataFrame:
    """Q13: what a definition is initialised from, step by step: (depth, symbol_id, confidence, stop). Parameters, calls, weak links and the bound end a route and say so."""
    kinds = t.symbols.select("symbol_id", "kind")
    uses = resolved.where("target_id is not null")
    edges = cut(_flows(t, uses).join(uses.select("ref_id", "target_id", F.col("confidence").alias("link")), "ref_id").groupBy("symbol_id", "target_id").agg(F.min("link").alias("link")))
    step = kinds.where(F.col("symbol_id") == start).select("symbol_id", F.lit(0).alias("depth"), F.lit(0).alias("confidence"), F.when(F.col("kind") == "parameter", "parameter").alias("stop"))
    frontier = cut(step)
    seen = Seen(frontier)
    for d in range(1, depth + 1):
        ahead = frontier.where("stop is null").select("symbol_id", F.col("confidence").alias("so_far")).join(edges, "symbol_id")
        nxt = ahead.groupBy(F.col("target_id").alias("symbol_id")).agg(F.min(F.greatest("so_far", "link")).alias("confidence"))
        nxt = nxt.join(seen.rows().select("symbol_id"), "symbol_id", "left_anti").join(kinds, "symbol_id")
        stop = F.when(F.col("kind") == "parameter", "parameter").when(F.col("kind").isin(CALLABLE), "call").when(F.col("confidence") >= FIELD, "weak-link").when(F.lit(d == depth), "depth-limit")
        frontier = cut(nxt.select("symbol_id", F.lit(d).alias("depth"), "confidence", stop.alias("stop")))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.rows()


def flow_forward(t: Tables, resolved: DataFrame, start: str, depth: int = 8) -> DataFrame:
    """Q14: definitions that a symbol's uses initialise: reachability over (used symbol, initialised symbol)."""
    uses = resolved.where("target_id is not null")
    edges = _flows(t, uses).join(uses.select("ref_id", "target_id"), "ref_id").select(F.col("target_id").alias("src"), F.col("symbol_id").alias("dst")).distinct()
    return trace(edges, t.symbols.where(F.col("symbol_id") == start).select(F.col("symbol_id").alias("node")), depth)


# -- configuration -------------------------------------------------------------------------------------------------------

#: What reads an environment variable, by language; the name is the first group.
ENV_READS = {
    "python": r"""os\.(?:getenv|environ(?:\.get)?)[\[(]\s*["']([A-Z][A-Z0-9_]*)["']""", "go": r'os\.(?:Getenv|LookupEnv)\(\s*"([A-Z][A-Z0-9_]*)"', "java": r'System\.getenv\(\s*"([A-Z][A-Z0-9_]*)"',
    "typescript": r"""process\.env(?:\.|\[["'])([A-Z][A-Z0-9_]*)""", "tsx": r"""process\.env(?:\.|\[["'])([A-Z][A-Z0-9_]*)""", "rust": r'env::var(?:_os)?\(\s*"([A-Z][A-Z0-9_]*)"', "bash": r"\$\{?([A-Z][A-Z0-9_]*)",
}


def env_reads(t: Tables) -> DataFrame:
    """(path, name)."""
    found = F.array().cast("array<string>")
    for lang, pattern in ENV_READS.items():
        found = F.when(F.col("language") == lang, F.regexp_extract_all("text", F.lit(pattern), 1)).otherwise(found)
    return t.files.select("path", F.explode(F.array_distinct(found)).alias("name"))


def env_declarations(t: Tables) -> DataFrame:
    """(path, name, value): name and value pairs of env lists and upper-case keys of environment maps, in YAML and templates."""
    text = F.when(F.col("language") == "helm", F.regexp_replace("text", r"\{\{-?\s*(?:if|end|else|range|with)[^}]*\}\}", "")).otherwise(F.col("text"))
    y = t.files.where(F.col("language").isin("yaml", "helm")).withColumn("text", text)
    pairs = r"-\s*name:\s*[\"']?([A-Z][A-Z0-9_]*)[\"']?\s*\n\s*value:\s*([^\n]*)"
    listed = y.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pairs), 1).alias("n"), F.regexp_extract_all("text", F.lit(pairs), 2).alias("v"))).alias("x")).select("path", F.col("x.n").alias("name"), F.trim("x.v").alias("value"))
    k = t.symbols.where("kind = 'key' and qualifier rlike '(^|[.])environment$'").select("path", "name", F.lit(None).cast("string").alias("value"))
    return listed.union(k.where("name rlike '^[A-Z][A-Z0-9_]*$'"))


def stitch(t: Tables) -> DataFrame:
    """Every declaration with the files that read its variable; orphans have none. Template values are named, with the values file of their chart that declares them."""
    from .provenance import chart_files

    reads = env_reads(t).groupBy("name").agg(F.sort_array(F.collect_set("path")).alias("readers"))
    out = env_declarations(t).join(reads, "name", "left")
    out = out.select("path", "name", "value", F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), r"\.Values\.([\w.]+)", 1), F.lit("")).alias("values_key"), F.coalesce("readers", F.array().cast("array<string>")).alias("readers"), F.col("readers").isNull().alias("orphan"))
    root = F.regexp_extract("path", r"^(?:(.*)/)?templates/", 1)
    return out.withColumn("chart", root).join(chart_files(t), ["chart", "values_key"], "left").select(*out.columns, "values_path")


def terraform_value(t: Tables) -> DataFrame:
    """Every source of each Terraform variable, ranked: module default, terraform.tfvars, *.auto.tfvars in order of their names; losers stay."""
    from .ranking import competition

    var = t.symbols.where("language = 'hcl' and qualifier = 'var'").select("path", "name", "symbol_id", S.parent(F.col("path")).alias("folder"))
    text = t.files.select("path", "text")
    value = F.expr("trim(substring(text, int(source_start + 1), int(source_end - source_start)))")
    default = var.join(t.flows.select("symbol_id", "source_start", "source_end"), "symbol_id").join(text, "path").select("folder", "name", "path", value.alias("value"), F.lit(0).alias("rank"))
    given = t.files.where(F.col("path").endswith(".tfvars")).select("path", S.parent(F.col("path")).alias("folder"), F.explode(F.split("text", "\n")).alias("line")).select("folder", F.regexp_extract("line", r"^\s*(\w+)\s*=", 1).alias("name"), "path", F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)).alias("value"), F.when(S.file_name(F.col("path")) == "terraform.tfvars", 1).when(F.col("path").endswith(".auto.tfvars"), 2).otherwise(-1).alias("rank")).where("name <> ''")
    rows = default.unionByName(given.join(var.select("folder", "name").distinct(), ["folder", "name"], "left_semi")).withColumn("subject", F.concat_ws("/", "folder", "name")).withColumn("participates", F.col("rank") >= 0)
    return competition(rows, "subject", [F.desc("participates"), F.desc("rank"), F.desc("path")]).withColumn("wins", F.col("wins") & F.col("participates"))


def css_values(t: Tables) -> DataFrame:
    """The cascade's winner for each (selector subject, property), undecided where files tie."""
    import pandas as pd

    from ..functions.extractors.markup import declarations
    from .ranking import css_cascade

    def run(batches):
        for b in batches:
            rows = [(p, d["start"], d["property"], d["value"], d["selector"], d["specificity"], d["important"], d["layer"], ";".join(d["conditions"])) for p, x in zip(b["path"], b["text"]) for d in declarations(x)]
            yield pd.DataFrame(rows, columns=["path", "start", "property", "value", "selector", "specificity", "important", "layer", "conditions"])

    rows = t.files.where("language in ('css', 'scss')").select("path", "text").mapInPandas(run, "path string, start bigint, property string, value string, selector string, specificity struct<ids:int,classes:int,elements:int>, important boolean, layer int, conditions string")
    subject = F.concat_ws("|", F.regexp_extract("selector", r"([.#]?[\w-]+)(?:::?[\w-]+(?:\([^)]*\))?)*$", 1), "property", "conditions")
    return css_cascade(rows.withColumn("subject", subject), "subject")


def helm_values(inputs: DataFrame) -> DataFrame:
    """Ranked sources of chart values. Columns: key, path, source (chart, enclosing, unpassed, file, set), position, value."""
    from .ranking import competition

    base = F.when(F.col("source") == "chart", 0).when(F.col("source") == "enclosing", F.col("position")).when(F.col("source") == "unpassed", 100).when(F.col("source") == "file", 101 + F.col("position")).otherwise(1_000_000 + F.col("position"))
    rows = inputs.withColumn("rank", base).withColumn("participates", F.col("source") != "unpassed")
    return competition(rows, "key", [F.desc("participates"), F.desc("rank"), F.col("path")]).withColumn("wins", F.col("wins") & F.col("participates"))


def ambiguous_names(t: Tables) -> DataFrame:
    """E8."""
    return t.symbols.where(~F.col("kind").isin(LOCAL)).groupBy("name").agg(F.count_distinct("path").alias("files")).where("files > 1")


def readable(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("tier", tier_name(F.col("confidence")))
