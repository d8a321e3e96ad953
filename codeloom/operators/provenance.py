"""Where configuration values come from, across folders: Terraform module calls (J13, J29) and charts with subcharts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import python_scalars as P
from ..functions import scalars as S
from ..functions.lineage import cut
from .facts import Tables


def module_calls(t: Tables) -> DataFrame:
    """(path, folder, label, child): Terraform module blocks and the folder that each one's relative source names."""
    rows = t.imports.where("language = 'hcl' and alias is not null and module like '.%'").select("path", S.parent(F.col("path")).alias("folder"), F.col("alias").alias("label"), "module")
    return rows.withColumn("child", P.normal_paths(F.concat_ws("/", F.nullif("folder", F.lit("")), "module"))).drop("module")


def module_callers(t: Tables) -> DataFrame:
    """(child, variable, path, label, value): what each caller of a folder's module passes to its variables; null where the call passes nothing and the default holds."""
    var = t.symbols.where("language = 'hcl' and qualifier = 'var'").select(S.parent(F.col("path")).alias("child"), F.col("name").alias("variable"))
    calls = module_calls(t)
    text = t.files.where("language = 'hcl'").select("path", "text")
    block = F.expr(r"""regexp_extract(text, concat(r'(?s)module\s+"', label, r'"\s*\{(.*?)\n\}'), 1)""")
    bodies = calls.join(text, "path").select("path", "label", "child", block.alias("body"))
    given = bodies.select("path", "label", "child", F.explode(F.split("body", "\n")).alias("line")).select("path", "label", "child", F.regexp_extract("line", r"^\s*(\w+)\s*=", 1).alias("variable"), F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1)).alias("value")).where("variable not in ('', 'source', 'version')")
    return calls.select("path", "label", "child").join(var, "child").join(given, ["path", "label", "child", "variable"], "left").select("child", "variable", "path", "label", "value")


def module_outputs(t: Tables, refs: DataFrame) -> DataFrame:
    """(ref_id, target_id): module.<label>.<name> to the output of that name in the folder that the label's source names."""
    asked = refs.where("language = 'hcl' and receiver like 'module.%'").select("ref_id", "name", S.parent(F.col("path")).alias("folder"), F.substring_index("receiver", ".", -1).alias("label"))
    out = t.symbols.where("language = 'hcl' and qualifier = 'output'").select("name", F.col("symbol_id").alias("target_id"), S.parent(F.col("path")).alias("child"))
    return asked.join(module_calls(t).select("folder", "label", "child").distinct(), ["folder", "label"]).join(out, ["name", "child"]).select("ref_id", "target_id")


def object_keys(t: Tables, refs: DataFrame) -> DataFrame:
    """(ref_id, target_id): a key reference to the keys of the Kubernetes object that it names, in that object's own document."""
    objects = t.notes.where("name like 'k8s:%'").select("path", "owner", F.concat(F.substring_index("name", ":", -1), F.lit("/"), "arg").alias("receiver"))
    holds = objects.join(t.scopes.select("path", "scope_id", F.col("start").alias("a"), F.col("end").alias("b")), "path").where("a <= owner and owner < b")
    document = holds.where("scope_id > 0").groupBy("path", "owner", "receiver").agg(F.max_by(F.struct("a", "b"), F.col("b") - F.col("a")).alias("d"))
    document = objects.join(document, ["path", "owner", "receiver"], "left").select("path", "receiver", F.coalesce("d.a", F.lit(0)).alias("a"), F.coalesce("d.b", F.lit(2**62)).alias("b"))
    keys = t.symbols.where("kind = 'key' and qualifier in ('data', 'stringData', 'binaryData')").select(F.col("path").alias("k_path"), "name", "name_start", F.col("symbol_id").alias("target_id"))
    asked = refs.where("expects = 'key' and (receiver like 'ConfigMap/%' or receiver like 'Secret/%')").select("ref_id", "name", "receiver")
    found = asked.join(document.withColumnRenamed("path", "k_path"), "receiver").join(keys, ["k_path", "name"]).where("a <= name_start and name_start < b")
    return found.select("ref_id", "target_id").distinct()


def chart_keys(t: Tables, refs: DataFrame) -> DataFrame:
    """(ref_id, target_id): `.Values` paths in a template to the keys of its own chart's value files, the default file first."""
    root = F.regexp_extract("path", r"^(?:(.*)/)?templates/", 1)
    asked = refs.where("language = 'helm' and expects = 'key' and kind = 'string-ref'").select("ref_id", "name", F.coalesce("receiver", F.lit("")).alias("owner"), root.alias("chart"))
    file = S.file_name(F.col("path"))
    keys = t.symbols.where("kind = 'key' and language = 'yaml'").where(file.rlike(r"^values.*\.ya?ml$")).select("name", F.coalesce("qualifier", F.lit("")).alias("owner"), S.parent(F.col("path")).alias("chart"), "symbol_id", (~file.startswith("values.y")).alias("later"))
    return asked.join(keys, ["name", "owner", "chart"]).groupBy("ref_id").agg(F.min_by("symbol_id", F.struct("later", "symbol_id")).alias("target_id"))


def chart_files(t: Tables) -> DataFrame:
    """(chart, values_key, values_path): the values file of a chart that declares a dotted key, the default file first."""
    file = S.file_name(F.col("path"))
    keys = t.symbols.where("kind = 'key' and language = 'yaml'").where(file.rlike(r"^values.*\.ya?ml$"))
    return keys.groupBy(S.parent(F.col("path")).alias("chart"), F.concat_ws(".", "qualifier", "name").alias("values_key")).agg(F.min_by("path", F.struct(~file.startswith("values.y"), "path")).alias("values_path"))


def _leaves(files: DataFrame) -> DataFrame:
    """(path, key, value): leaves of YAML value files, keys as dotted paths."""

    def run(batches):
        import yaml

        def walk(x, at):
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from walk(v, [*at, str(k)])
            elif at:
                yield ".".join(at), None if x is None else str(x).lower() if isinstance(x, bool) else str(x)

        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    out += [(path, k, v) for k, v in walk(yaml.safe_load(text), [])]
                except yaml.YAMLError:
                    pass  # the file's error is a row of the errors table
            yield pd.DataFrame(out, columns=["path", "key", "value"])

    return files.select("path", "text").mapInPandas(run, "path string, key string, value string")


def helm_inputs(t: Tables, passed: list[str] = (), sets: dict[str, str] | None = None) -> DataFrame:
    """Every source of every chart's values: (key, path, source, position, value, written), key as `chart/dotted.path`, written as the file has it.

    A parent's key whose first parts name a subchart belongs to the subchart, at each level between, however deep; further out beats
    nearer. Value files beside the default one take part if passed, in that order; settings come last.
    """
    charts = t.files.where(S.file_name(F.col("path")) == "Chart.yaml").select(S.parent(F.col("path")).alias("chart"))
    file = S.file_name(F.col("path"))
    values = t.files.where("language = 'yaml'").where(file.rlike(r"^values.*\.ya?ml$")).withColumn("chart", S.parent(F.col("path"))).join(charts, "chart", "left_semi")
    leaves = _leaves(values).withColumn("chart", S.parent(F.col("path")))
    order = F.lit(-1)
    for i, p in enumerate(passed):
        order = F.when(F.col("path") == p, i).otherwise(order)
    default = S.file_name(F.col("path")).startswith("values.y")
    own = leaves.select("chart", "key", F.col("key").alias("written"), "path", F.when(default, "chart").when(order >= 0, "file").otherwise("unpassed").alias("source"), F.when(default, 0).otherwise(F.greatest(order, F.lit(0))).alias("position"), "value")
    if sets:
        top = charts.agg(F.min("chart")).first()[0]  # settings are given to the outermost chart
        own = own.unionByName(t.files.sparkSession.createDataFrame([(top, k, k, "--set", "set", i, v) for i, (k, v) in enumerate(sets.items())], "chart string, key string, written string, path string, source string, position int, value string"))
    nested = charts.withColumn("name", F.regexp_extract("chart", r"(?:^|/)charts/([^/]+)$", 1)).where("name <> ''").select(F.regexp_replace("chart", r"/?charts/[^/]+$", "").alias("parent"), F.col("name").alias("sub_name"), F.col("chart").alias("sub"))
    out, level, depth = own, own, 0
    while True:  # a level is lost of every key, so this ends with the longest one
        depth += 1
        level = level.withColumn("name", F.substring_index("key", ".", 1)).join(nested, (F.col("chart") == F.col("parent")) & (F.col("name") == F.col("sub_name"))).select(F.col("sub").alias("chart"), F.expr("substring(key, length(substring_index(key, '.', 1)) + 2)").alias("key"), "written", "path", F.when(F.col("source") == "chart", "enclosing").otherwise(F.col("source")).alias("source"), F.when(F.col("source").isin("chart", "enclosing"), F.lit(depth)).otherwise(F.col("position")).alias("position"), "value").where("key <> ''")
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select(F.concat_ws("/", F.nullif("chart", F.lit("")), "key").alias("key"), "path", "source", "position", "value", "written")


def helm_sources(t: Tables, passed: list[str] = (), sets: dict[str, str] | None = None) -> DataFrame:
    """Q15: helm_inputs ranked, losers kept; contested where two take part at the top rank, and then nobody wins."""
    from .reports import helm_values

    ranked = helm_values(helm_inputs(t, passed, sets))
    top = ranked.where("participates").groupBy("key", "rank").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("n", "rank").alias("n"))
    return ranked.join(top, "key", "left").withColumn("contested", F.coalesce(F.col("n") > 1, F.lit(False))).withColumn("wins", F.col("wins") & ~F.col("contested")).drop("n")


def file_edges(t: Tables, found: DataFrame, languages: list[str]) -> DataFrame:
    """(src, dst): files of some languages and the files that they source or import."""
    return found.join(t.files.where(F.col("language").isin(languages)).select("path"), "path", "left_semi").select(F.col("path").alias("src"), F.col("file").alias("dst")).distinct()


def visible_scripts(t: Tables, found: DataFrame) -> DataFrame:
    """(path, name, script): functions that each script sees through `source`, its own included."""
    from .graphs import closure

    edges = file_edges(t, found, ["bash"])
    own = t.files.where("language = 'bash'").select(F.col("path").alias("src"), F.col("path").alias("dst"))
    sees = closure(edges).union(own).distinct()
    functions = t.symbols.where("language = 'bash' and kind = 'function'").select(F.col("path").alias("dst"), "name")
    return sees.join(functions, "dst").select(F.col("src").alias("path"), "name", F.col("dst").alias("script"))


def reaches_style(t: Tables, found: DataFrame, origin: str, destination: str) -> bool:
    """Whether a stylesheet still imports another, directly or through others."""
    from .graphs import reach

    edges = file_edges(t, found, ["css", "scss"])
    seed = t.files.where(F.col("path") == origin).select(F.col("path").alias("node"))
    return not reach(edges, seed).where(F.col("node") == destination).isEmpty()


#: Which typed edge leads from what to what: a value that is written down, the key of a chart or the variable of a module
#: that it competes for, uses of those, environment variables and their readers.
CONSUMES = [
    ("value", "supplies", "key"), ("value", "overridden", "lost"), ("value", "named", "use"), ("key", "expands", "use"), ("use", "declares", "environment"), ("environment", "reads", "reader"),
    ("value", "given", "variable"), ("value", "given-overridden", "lost"), ("variable", "initialises", "variable"), ("variable", "passes", "variable"), ("property", "substitutes", "use"),
]


def _node(kind: str, *parts):
    return F.concat(F.lit(f"{kind}:"), *parts)


def _readers(t: Tables) -> DataFrame:
    """(name, node): environment variables and the functions, or else files, that read them."""
    from .reports import env_reads
    from .resolving import innermost

    reads = env_reads(t).distinct()
    quoted = t.texts.select("path", "start", F.regexp_extract("text", r"""^["'`]([A-Z][A-Z0-9_]*)["'`]$""", 1).alias("name")).where("name <> ''").join(reads, ["path", "name"], "left_semi")
    functions = t.symbols.where("kind in ('function', 'method')").select("path", "symbol_id", "full_start", "full_end")
    places = quoted.withColumn("place", F.concat_ws(":", "path", "start"))
    holders = innermost(places, functions, ["path"], "place", "full_start", "full_end", "symbol_id", "start").select("path", "name", F.col("symbol_id").alias("holder"))
    bare = t.refs.join(reads, ["path", "name"], "left_semi").select("path", "name", F.col("enclosing_id").alias("holder"))
    found = reads.join(holders.union(bare).distinct(), ["path", "name"], "left")
    return found.select("name", F.coalesce(_node("function", F.col("holder")), _node("file", F.col("path"))).alias("node")).distinct()


def consumer_edges(t: Tables, resolved: DataFrame, passed: list[str] = (), sets: dict[str, str] | None = None) -> DataFrame:
    """Q15: typed edges (src, dst, label) from written values to what consumes them, through charts, manifests, modules and the environment."""
    from .reports import env_declarations, terraform_value
    from .resolving import innermost

    won = F.when(F.col("wins"), F.lit("supplies")).otherwise("overridden")
    charts = helm_sources(t, passed, sets).select(_node("value", F.col("path"), F.lit("#"), F.col("written")).alias("src"), _node("key", F.col("key")).alias("dst"), won.alias("label"))
    # A use of a map consumes every key below it.
    root = F.coalesce(F.nullif(F.regexp_extract("path", r"^(?:(.*)/)?templates/", 1), F.lit("")), F.lit(""))
    uses = t.refs.where("language = 'helm' and expects = 'key' and kind = 'string-ref'").select("path", "start", F.concat_ws(".", "receiver", "name").alias("dotted"), root.alias("chart"))
    used = uses.select(_node("use", F.col("path"), F.lit(":"), F.col("start").cast("string")).alias("dst"), F.concat_ws("/", F.nullif("chart", F.lit("")), "dotted").alias("asked"))
    last = F.substring_index(F.substring(F.col("dst"), 5, 1 << 30), "/", -1)
    parts = F.split(last, r"\.")
    keys = charts.select("dst").distinct().withColumn("folder", F.substring(F.col("dst"), 5, 1 << 30)).withColumn("folder", F.expr("substring(folder, 1, length(folder) - length(substring_index(folder, '/', -1)))"))
    keys = keys.select(F.col("dst").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat("folder", F.array_join(F.slice(parts, F.lit(1), i), ".")))).alias("asked"))
    expands = keys.join(used, "asked").select("src", "dst", F.lit("expands").alias("label"))
    template = env_declarations(t).select("path", F.col("name").alias("variable"), F.regexp_extract(F.coalesce("value", F.lit("")), r"\.Values\.([\w.]+)", 1).alias("dotted")).where("dotted <> ''")
    declares = uses.join(template, ["path", "dotted"]).select(_node("use", F.col("path"), F.lit(":"), F.col("start").cast("string")).alias("src"), _node("environment", F.col("variable")).alias("dst"), F.lit("declares").alias("label"))
    keyed = r"-\s*name:\s*[\"']?([A-Z][A-Z0-9_]*)[\"']?\s+valueFrom:\s+(?:configMap|secret)KeyRef:\s+(?:name:\s*(\S+)\s+key:\s*(\S+)|key:\s*(\S+)\s+name:\s*(\S+))"
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(keyed), i).alias(f"g{i}") for i in range(1, 6)])
    by_key = t.files.where("language in ('yaml', 'helm')").select("path", F.explode(found).alias("x")).select("path", F.col("x.g1").alias("variable"), F.concat("x.g2", "x.g5").alias("object"), F.concat("x.g3", "x.g4").alias("name"))
    named_refs = resolved.where("expects = 'key' and (receiver like 'ConfigMap/%' or receiver like 'Secret/%')").select("path", "start", "name", F.substring_index("receiver", "/", -1).alias("object"), "target_id")
    use = _node("use", F.col("path"), F.lit(":"), F.col("start").cast("string"))
    declares = declares.union(named_refs.join(by_key, ["path", "object", "name"]).select(use, _node("environment", F.col("variable")), F.lit("declares")))
    written = t.symbols.where("language = 'yaml' and kind = 'key'").select(F.col("symbol_id").alias("target_id"), _node("value", F.col("path"), F.lit("#"), F.concat_ws(".", "qualifier", "name")).alias("src"))
    named = named_refs.join(written, "target_id").select("src", use.alias("dst"), F.lit("named").alias("label"))
    reads = _readers(t).select(_node("environment", F.col("name")).alias("src"), F.col("node").alias("dst"), F.lit("reads").alias("label"))
    hcl = t.symbols.where("language = 'hcl'").select("symbol_id", "path", "name", "qualifier", S.parent(F.col("path")).alias("folder"))
    variables = hcl.where("qualifier = 'var'").select("symbol_id", "folder", "name")
    given = terraform_value(t).where("rank <> 0").select("folder", "name", "path", F.when(F.col("wins"), F.lit("given")).otherwise("given-overridden").alias("label")).join(variables, ["folder", "name"])
    given = given.select(_node("value", F.col("path"), F.lit("#"), F.col("name")).alias("src"), _node("variable", F.col("symbol_id")).alias("dst"), "label")
    points = resolved.where("language = 'hcl' and target_id is not null").select("ref_id", "path", "start", "target_id")
    spans = t.flows.where("language = 'hcl'").select("path", F.col("symbol_id").alias("filled"), "source_start", "source_end")
    fills = innermost(points, spans, ["path"], "ref_id", "source_start", "source_end", "filled", "start").where("filled is not null and filled <> target_id")
    fills = fills.select(_node("variable", F.col("target_id")).alias("src"), _node("variable", F.col("filled")).alias("dst"), F.lit("initialises").alias("label"))
    passes = module_callers(t).withColumn("part", F.explode(F.regexp_extract_all("value", F.lit(r"((?:var|local)\.\w+)"), 1))).select("child", "variable", S.parent(F.col("path")).alias("folder"), F.substring_index("part", ".", 1).alias("qualifier"), F.substring_index("part", ".", -1).alias("name"))
    passes = passes.join(hcl.select("folder", "qualifier", "name", F.col("symbol_id").alias("from_id")), ["folder", "qualifier", "name"]).join(variables.select(F.col("folder").alias("child"), F.col("name").alias("variable"), F.col("symbol_id").alias("to_id")), ["child", "variable"])
    passes = passes.select(_node("variable", F.col("from_id")).alias("src"), _node("variable", F.col("to_id")).alias("dst"), F.lit("passes").alias("label"))
    styles = t.symbols.where("kind = 'property' and name like '--%'").select(F.col("symbol_id").alias("target_id"))
    substitutes = resolved.join(styles, "target_id", "left_semi").select(_node("property", F.col("target_id")).alias("src"), use.alias("dst"), F.lit("substitutes").alias("label"))
    out = charts
    for edges in (expands, declares, named, reads, given, fills, passes, substitutes):
        out = out.union(edges)
    return out.distinct()


def consumers(t: Tables, edges: DataFrame, symbols: DataFrame, depth: int = 8) -> DataFrame:
    """Q15 forward: what consumes the symbols (column symbol_id): regular_walk's rows, their origins as symbols.

    A key of a values file or manifest, a variable or an assignment to one, or a custom property. A value that loses
    against another is followed to the competition it loses.
    """
    s = t.symbols.join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")
    values = s.where("language = 'yaml' and kind = 'key'").select("symbol_id", _node("value", F.col("path"), F.lit("#"), F.concat_ws(".", "qualifier", "name")).alias("node"), F.lit("value").alias("state"))
    variables = s.where("language = 'hcl'").select("symbol_id", _node("variable", F.col("symbol_id")).alias("node"), F.lit("variable").alias("state"))
    styles = s.where("kind = 'property'").select("symbol_id", _node("property", F.col("symbol_id")).alias("node"), F.lit("property").alias("state"))
    from .graphs import regular_walk

    starts = cut(values.union(variables).union(styles))
    return regular_walk(edges, starts, CONSUMES, depth).join(starts.select("symbol_id", F.col("node").alias("origin")), "origin").drop("origin")
