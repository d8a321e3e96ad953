"""OpenAPI documents from route declarations (Q22, Q23), capabilities (Q21), and command-line chart inputs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import IMPERATIVE, LANGUAGES
from .facts import Tables

VERBS = ["get", "post", "put", "delete", "patch", "head", "options"]


def fastapi_routes(t: Tables) -> DataFrame:
    """Q23: (route, verb, operation, file, params) of functions under route decorators; a function's own parameters are the operation's."""
    verb = F.regexp_extract("name", r"\.(\w+)$", 1)
    notes = t.notes.where("language = 'python' and owner >= 0 and arg is not null").where(verb.isin(VERBS)).select("symbol_id", "path", verb.alias("verb"), F.col("arg").alias("route"))
    f = t.symbols.where("kind in ('function', 'method')").select("symbol_id", F.col("name").alias("operation"))
    params = t.symbols.where("kind = 'parameter'").groupBy(F.col("container_id").alias("symbol_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("name_start", "name"))), lambda x: x["name"]).alias("params"))
    return notes.join(f, "symbol_id").join(params, "symbol_id", "left").select("route", "verb", "operation", F.col("path").alias("file"), F.coalesce("params", F.array().cast("array<string>")).alias("params"))


def next_routes(t: Tables) -> DataFrame:
    """Exported functions named by a verb in route files; the url comes from the file's path."""
    s = t.symbols.where("language in ('typescript', 'tsx') and kind = 'function' and exported").where(F.lower("name").isin(VERBS)).where(F.col("path").rlike(r"(^|/)app/(.*/)?route\.[jt]sx?$"))
    route = S.route_for(F.regexp_replace("path", r"^.*?(?=app/)", ""))
    return s.select(route.alias("route"), F.lower("name").alias("verb"), F.col("name").alias("operation"), F.col("path").alias("file"), F.regexp_extract_all(route, F.lit(r"\{(\w+)\}"), 1).alias("params"))


def openapi(routes: DataFrame) -> DataFrame:
    """One JSON path item for each route, in order."""
    operation = F.struct(F.col("operation").alias("operationId"), F.transform("params", lambda p: F.struct(p.alias("name"), F.when(F.col("route").contains(F.concat(F.lit("{"), p, F.lit("}"))), "path").otherwise("query").alias("in"))).alias("parameters"))
    return routes.groupBy("route").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("verb", operation.alias("o"))))).alias("item")).select("route", F.to_json("item").alias("json"))


#: JSON types of Python's.
JSON_TYPES = {"int": "integer", "float": "number", "str": "string", "bool": "boolean", "list": "array", "dict": "object"}


def schemas(t: Tables, base: str = "BaseModel") -> DataFrame:
    """Q23: (name, json) of the classes under a base class: their fields with declared types; those without a default are required."""
    from .calls import ancestors_of

    models = ancestors_of(t).where(F.col("dst") == base).select(F.col("src").alias("qualifier")).distinct()
    fields = t.symbols.where("kind = 'field' and language = 'python'").join(models, "qualifier", "left_semi")
    said = t.notes.where("name = '@declares'").groupBy("symbol_id").agg(F.min("arg").alias("declared"))
    given = t.flows.select("symbol_id", F.lit(True).alias("given")).distinct().union(t.notes.where("name = '@value'").select("symbol_id", F.lit(True))).distinct()
    plain = F.regexp_extract("declared", r"^(\w+)", 1)
    kind = F.lit(None).cast("string")
    for python, name in JSON_TYPES.items():
        kind = F.when(plain == python, name).otherwise(kind)
    reference = F.when(kind.isNull(), F.concat(F.lit("#/components/schemas/"), plain))
    rows = fields.join(said, "symbol_id").join(given, "symbol_id", "left").withColumn("optional", F.coalesce("given", F.lit(False)) | F.col("declared").rlike(r"Optional|\bNone\b"))
    each = F.sort_array(F.collect_list(F.struct("name_start", "name", F.struct(kind.alias("type"), reference.alias("$ref")).alias("schema"), "optional")))
    lists = rows.groupBy("qualifier").agg(each.alias("f"))
    return lists.select(F.col("qualifier").alias("name"), F.to_json(F.struct(F.lit("object").alias("type"), F.map_from_entries(F.transform("f", lambda x: F.struct(x["name"], x["schema"]))).alias("properties"), F.transform(F.filter("f", lambda x: ~x["optional"]), lambda x: x["name"]).alias("required"))).alias("json"))


#: JSON types of TypeScript's.
SCRIPT_TYPES = {"string": {"type": "string"}, "number": {"type": "number"}, "boolean": {"type": "boolean"}, "Date": {"type": "string", "format": "date-time"}, "null": {"type": "null"}, "any": {}, "unknown": {}, "object": {"type": "object"}}


def _split(text: str, at: str) -> list[str]:
    """Splits outside brackets and quotes."""
    parts, depth, quote = [""], 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += (c in "<([{") - (c in ">)]}")
            if c == at and depth == 0:
                parts.append("")
                continue
        parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def script_schema(declared: str | None, known: set[str]) -> tuple[dict, bool]:
    """(schema, whether it may be absent) of a TypeScript type; names among `known` are references, other types are anything."""
    kinds = _split(declared or "", "|")
    absent = "undefined" in kinds
    kinds = [k for k in kinds if k != "undefined"]
    if len(kinds) > 1:
        if all(k[0] in "\"'" for k in kinds):
            return {"type": "string", "enum": [k[1:-1] for k in kinds]}, absent
        return {"anyOf": [script_schema(k, known)[0] for k in kinds]}, absent
    kind = kinds[0] if kinds else ""
    while kind.startswith("(") and kind.endswith(")"):
        return script_schema(kind[1:-1], known)[0], absent
    if kind.endswith("[]"):
        return {"type": "array", "items": script_schema(kind[:-2], known)[0]}, absent
    name, _, inner = kind.partition("<")
    arguments = _split(inner[:-1], ",") if inner else []
    if name in ("Array", "ReadonlyArray", "Set") and len(arguments) == 1:
        return {"type": "array", "items": script_schema(arguments[0], known)[0]}, absent
    if name in ("Record", "Map") and len(arguments) == 2:
        return {"type": "object", "additionalProperties": script_schema(arguments[1], known)[0]}, absent
    if name in ("Partial", "Readonly", "Required", "Promise") and len(arguments) == 1:
        return script_schema(arguments[0], known)[0], absent
    if kind[:1] in ("'", '"') and len(kind) > 1:
        return {"type": "string", "enum": [kind[1:-1]]}, absent
    return ({"$ref": f"#/components/schemas/{kind}"} if kind in known else dict(SCRIPT_TYPES.get(kind, {}))), absent


def script_schemas(t: Tables, resolved: DataFrame) -> DataFrame:
    """Q22: (name, path, json) of the TypeScript types that route handlers name, and of all that their fields name in turn.

    Types refer to each other by `$ref`, so recursive and shared ones are written once. A closure over type references:
    a field's declared type leads to the types it names, that of its own file first, else the only one of that name.
    """
    from .graphs import reach
    from .references import import_files

    types = t.symbols.where("language in ('typescript', 'tsx') and kind in ('interface', 'class', 'type')").select("symbol_id", "name", "path")
    handlers = next_routes(t).select(F.col("file").alias("path"), F.col("operation").alias("name")).distinct()
    inside = t.symbols.join(handlers, ["path", "name"], "left_semi").where("kind = 'function'").select(F.col("symbol_id").alias("enclosing_id"))
    named = resolved.join(inside, "enclosing_id", "left_semi").join(types.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi").select(F.col("target_id").alias("node")).distinct()
    fields = t.symbols.where("kind = 'field' and language in ('typescript', 'tsx') and qualifier is not null").join(t.notes.where("name = '@declares'").groupBy("symbol_id").agg(F.min("arg").alias("declared")), "symbol_id")
    optional = t.notes.where("name = '@optional'").select("symbol_id", F.lit(True).alias("optional")).distinct()
    fields = fields.join(optional, "symbol_id", "left").join(types.select(F.col("symbol_id").alias("owner_id"), F.col("name").alias("qualifier"), "path"), ["path", "qualifier"])
    mentions = fields.select("owner_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("declared", F.lit(r"([A-Za-z_$][\w$]*)"), 1))).alias("name")).distinct()
    imported = t.bindings.join(import_files(t), ["path", "import_pos"]).select("path", "name", F.when(F.col("original").isin("*", "default"), F.col("name")).otherwise(F.col("original")).alias("original"), F.col("file").alias("t_path"))
    place = types.select(F.col("symbol_id").alias("type_id"), "name", F.col("path").alias("t_path"))
    own = mentions.join(place.withColumnRenamed("t_path", "path"), ["path", "name"]).select("owner_id", "name", "type_id", F.lit(0).alias("rank"))
    bound = mentions.join(imported, ["path", "name"]).join(place.withColumnRenamed("name", "original"), ["original", "t_path"]).select("owner_id", "name", "type_id", F.lit(1).alias("rank"))
    only = place.groupBy("name").agg(F.min("type_id").alias("type_id"), F.count("*").alias("n")).where("n = 1")
    links = own.union(bound).union(mentions.join(only, "name").select("owner_id", "name", "type_id", F.lit(2).alias("rank"))).groupBy("owner_id", "name").agg(F.min_by("type_id", F.struct("rank", "type_id")).alias("type_id"))
    wanted = reach(links.select(F.col("owner_id").alias("src"), F.col("type_id").alias("dst")), named)
    known = links.groupBy("owner_id").agg(F.collect_set("name").alias("known"))
    lists = fields.join(wanted.select(F.col("node").alias("owner_id")), "owner_id", "left_semi").groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct("name_start", "name", "declared", F.coalesce("optional", F.lit(False)).alias("optional")))).alias("fields"))
    rows = types.withColumnRenamed("symbol_id", "owner_id").join(wanted.select(F.col("node").alias("owner_id")), "owner_id", "left_semi").join(lists, "owner_id", "left").join(known, "owner_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for name, path, held, names in zip(b["name"], b["path"], b["fields"], b["known"]):
                properties, required = {}, []
                for f in held if held is not None else []:
                    schema, absent = script_schema(f["declared"], set(names) if names is not None else set())
                    properties[f["name"]] = schema
                    if not absent and not f["optional"]:
                        required.append(f["name"])
                out.append((name, path, json.dumps({"type": "object", "properties": properties} | ({"required": required} if required else {}))))
            yield pd.DataFrame(out, columns=["name", "path", "json"])

    return rows.select("name", "path", "fields", "known").mapInPandas(run, "name string, path string, json string")


#: What each verb of the workspace needs of a language.
CAPABILITIES = {
    "symbols": None, "references": None, "mentions": None, "rename": None, "delete": None, "unused": None, "callers": IMPERATIVE, "impact": IMPERATIVE, "duplicates": IMPERATIVE,
    "flow": [*IMPERATIVE, "hcl", "css", "scss", "yaml", "helm"], "search": [*IMPERATIVE, "css", "scss", "hcl"], "hierarchy": ["python", "go", "java", "rust", "typescript", "tsx"], "entry-points": [*IMPERATIVE, "hcl"],
    "cascade": ["css", "scss"], "values": ["hcl", "helm", "yaml"], "stitch": ["yaml", "helm", "python", "go", "java", "typescript", "tsx", "rust", "bash"], "api": ["python", "typescript", "tsx"],
    "unused-imports": ["python", "typescript", "tsx", "go", "rust", "java", "zig"], "signature": [x for x in IMPERATIVE if x != "bash"],
    "types": ["python"], "extract": ["python"], "inline": ["python"], "rewrite": ["python"], "remove-flag": ["python"],
}


def capabilities(spark: SparkSession) -> DataFrame:
    """(capability, language, support)."""
    rows = [(c, lang, "supported" if langs is None or lang in langs else "not-applicable") for c, langs in CAPABILITIES.items() for lang in LANGUAGES]
    return spark.createDataFrame(rows, "capability string, language string, support string")


def split_unescaped(text: str, sep: str) -> list[str]:
    """Splits where the separator isn't escaped by a backslash or held in braces."""
    out, part, depth, i = [], "", 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            part, i = part + text[i : i + 2], i + 2
            continue
        depth += (c == "{") - (c == "}")
        if c == sep and depth == 0:
            out.append(part)
            part = ""
        else:
            part += c
        i += 1
    return [*out, part]


def chart_inputs(args: list[str]) -> list[dict]:
    """Value files and --set entries of a command line, in order; later ones win."""
    out, i = [], 0
    while i < len(args):
        flag, _, value = args[i].partition("=")
        if flag in ("-f", "--values", "--set", "--set-string") and not value:
            i += 1
            value = args[i] if i < len(args) else ""
        if flag in ("-f", "--values"):
            out += [{"source": "file", "position": len(out) + n, "path": p, "key": None, "value": None} for n, p in enumerate(value.split(","))]
        elif flag in ("--set", "--set-string"):
            for entry in split_unescaped(value, ","):
                key, _, v = entry.partition("=")
                out.append({"source": "set", "position": len(out), "path": flag, "key": re.sub(r"\\(.)", r"\1", key), "value": re.sub(r"\\(.)", r"\1", v)})
        i += 1
    return out
