"""Report queries: web pages of the driver as a workspace, and a small workspace of many languages with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import python_scalars as P
from ..operators import api, calls, reports
from ..sources import workspace as W
from ..workspace import Workspace
from .registry import query, t
from .sample import FILES

_kept: dict[str, Workspace] = {}


def sample(spark) -> Workspace:
    app = spark.sparkContext.applicationId
    if app not in _kept:
        _kept.clear()
        _kept[app] = Workspace.of(spark, FILES)
    return _kept[app]


def pages_workspace(spark, d) -> Workspace:
    return Workspace(W.from_pages(t(spark, d, "pages")))


@query("q02_stats_of_pages")
def page_stats(spark, d):
    """Scan, extract, resolve, aggregate: statistics of the pages by language."""
    return pages_workspace(spark, d).stats()


@query("x05_class_references", """
SELECT name, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(c), '[\\s,]+')) AS name FROM (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages)) WHERE name <> '' GROUP BY name""")
def class_references(spark, d):
    return pages_workspace(spark, d).tables.refs.where("expects = 'selector'").groupBy("name").agg(F.count("*").alias("n"))


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of known rows."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) AS v({columns})"


_EDGES = [("app.py", "shop/core.py", 1), ("app.py", "app.py", 0), ("geo/shape.go", "geo/shape.go", 0), ("shop/core.py", "shop/core.py", 0), ("shop/core.py", "shop/core.py", 2), ("shop/core.py", "shop/util.py", 1), ("test_app.py", "app.py", 1), ("web/cart.ts", "web/sum.ts", 1)]


@query("q08_call_graph", values("from_path, to_path, confidence", _EDGES))
def call_graph(spark, d):
    e = sample(spark).graph["edges"]
    return e.select(F.substring_index("src", ":", 1).alias("from_path"), F.substring_index("dst", ":", 1).alias("to_path"), "confidence").distinct()


@query("q03_definitions", values("path, qualified_name, role", [("shop/core.py", "Item::base", "primary"), ("shop/core.py", "Book::base", "primary")]))
def definitions(spark, d):
    return sample(spark).definitions("base").select("path", "qualified_name", "role")


@query("q06_usages", values("path, kind", [("app.py", "reference"), ("app.py", "reference"), ("docs/guide.md", "textual"), ("shop/__init__.py", "reference")]))
def usages(spark, d):
    return sample(spark).usages("total").select("path", "kind")


@query("q07_callers", values("path, depth", [("shop/util.py", 0), ("shop/core.py", 1), ("app.py", 2), ("app.py", 3), ("test_app.py", 3)]))
def callers(spark, d):
    return sample(spark).callers("clamp", 3).select(F.substring_index("node", ":", 1).alias("path"), "depth")


@query("q09_impact", values("kind, path, confidence, depth", [("caller", "app.py", 1, 2), ("caller", "app.py", 1, 3), ("caller", "shop/core.py", 1, 1), ("caller", "test_app.py", 1, 3), ("reference", "shop/core.py", 1, 1), ("reference", "shop/core.py", 1, 1)]))
def impact(spark, d):
    return sample(spark).impact("clamp").select("kind", "path", "confidence", "depth")


@query("q10_entry_points", values("path, kind, rule, threat_model", [("app.py", "main", "python-main-guard", "local"), ("cmd/main.go", "main", "go-main", "local"), ("test_app.py", "test", "pytest-function", "none"), *[("infra/main.tf", "infra-input", "terraform-variable", "local")] * 2]))
def entry_points(spark, d):
    return sample(spark).entry_points().select(F.substring_index("symbol_id", ":", 1).alias("path"), "kind", "rule", "threat_model")


@query("q11_unused", values("path, name, in_dead_cycle, spared", [("shop/core.py", "settings", False, None), ("shop/core.py", "dead_a", True, None), ("shop/core.py", "dead_b", True, None), ("shop/core.py", "_spared", False, "underscore"), ("shop/util.py", "orphan_helper", False, None)]))
def unused(spark, d):
    return sample(spark).unused().where("kind = 'function' and path like 'shop/%'").select("path", "name", "in_dead_cycle", "spared")


@query("q13_flow_backward", values("path, depth, stop", [("app.py", 0, None), ("app.py", 1, None), ("shop/core.py", 1, "call"), ("app.py", 2, "parameter")]))
def flow(spark, d):
    w = sample(spark)
    start = w.tables.symbols.where("name = 'result'").first()["symbol_id"]
    return w.flow(start).select(F.substring_index("symbol_id", ":", 1).alias("path"), "depth", "stop")


@query("q15_terraform_values", values("subject, path, value, place, wins", [("infra/size", "infra/z.auto.tfvars", "3", 1, True), ("infra/size", "infra/terraform.tfvars", "2", 2, False), ("infra/size", "infra/main.tf", "1", 3, False), ("infra/zone", "infra/main.tf", '"a"', 1, True)]))
def terraform(spark, d):
    return sample(spark).terraform().select("subject", "path", "value", "place", "wins")


@query("q15_css_cascade", values("subject, value, wins", [(".big|color|", "green", True), (".gone|color|", "black", True), (".card|color|", "red", False), (".card|--ink|", "blue", True), (".card|color|", "var(--ink)", True)]))
def css(spark, d):
    return sample(spark).css().select("subject", "value", "wins")


@query("q16_stitch", values("name, values_key, readers, orphan", [("SHOP_MODE", "mode", "shop/core.py,web/cart.ts", False), ("NOBODY", None, "", True)]))
def stitch(spark, d):
    return sample(spark).stitch().select("name", "values_key", F.array_join("readers", ",").alias("readers"), "orphan")


@query("q18_mentions", values("path, text", [("docs/guide.md", "Call `total` for prices, see [top](#big-guide) and [site][home].")]))
def mentions(spark, d):
    return sample(spark).mentions("total").select("path", "text")


@query("q19_structural_search", values("path, text, replacement", [("shop/core.py", "return self.base() * n", "return mul(self.base(), n)")]))
def search(spark, d):
    return sample(spark).search("python", "return $X * $Y", "return mul($X, $Y)").select("path", "text", "replacement")


@query("a02_parse_tally", values("language, with_errors", [(x, int(x == "python")) for x in ("bash", "css", "go", "hcl", "helm", "html", "markdown", "python", "typescript", "yaml")]))
def tally(spark, d):
    return sample(spark).parse_tally().select("language", F.col("with_errors").cast("int").alias("with_errors"))


@query("m01_rename", values("path, refused", [("shop/__init__.py", None), ("shop/core.py", None)]))
def rename(spark, d):
    w = sample(spark)
    return w.apply(w.rename("total", "sum_up")[0]).select("path", "refused")


@query("m03_safe_delete", values("path, removed", [("shop/util.py", 34)]))
def delete(spark, d):
    return sample(spark).delete("orphan_helper").select("path", (F.col("end") - F.col("start")).cast("int").alias("removed"))


@query("m08_unused_imports", values("path, name, module", [("shop/core.py", "unused_name", ".util")]))
def imports(spark, d):
    return sample(spark).unused_imports().select("path", "name", "module")


@query("f11_recipe_predicates", values("path, name", [("shop/core.py", "dead_a"), ("shop/core.py", "dead_b"), ("shop/core.py", "settings"), ("shop/util.py", "orphan_helper")]))
def recipe(spark, d):
    return sample(spark).run("step dead code\n  select symbols\n  where kind=function lang=python unused\n  report\n")[0]["rows"].select("path", "name")


@query("s03_languages", values("language, files", [("bash", 2), ("css", 1), ("go", 2), ("hcl", 3), ("helm", 1), ("html", 1), ("markdown", 1), ("python", 6), ("typescript", 2), ("yaml", 2)]))
def languages(spark, d):
    return sample(spark).files.groupBy("language").agg(F.count("*").cast("int").alias("files"))


@query("f06_definition_at_offset", values("path, name", [("shop/core.py", "total")]))
def definition_at(spark, d):
    w = sample(spark)
    return reports.definition_at(w.tables, w.resolved, "app.py", 100).select("path", "name")


@query("f07_reference_at_offset", values("name, start", [("price", 98)]))
def reference_at(spark, d):
    return reports.reference_at(sample(spark).resolved, "app.py", 100).select("name", F.col("start").cast("int").alias("start"))


@query("f09_internal_unused", values("path, name", [("shop/core.py", "_spared")]))
def internal(spark, d):
    return sample(spark).unused(internal=True).where("kind = 'function'").select("path", "name")


@query("a04_graph_by_tier_and_origin", values("tier, origin, edges", [("exact", "resolved", 5), ("import-qualified", "resolved", 4), ("field-based", "hierarchy", 2)]))
def summary(spark, d):
    return reports.graph_summary(sample(spark).graph)


@query("a10_entry_point_summary", values("kind, n", [("main", 2), ("test", 1), ("infra-input", 2)]))
def entry_summary(spark, d):
    return sample(spark).entry_points().groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("a15_capability_totals", values("support, n", [("supported", 195), ("not-applicable", 189)]))
def capability_totals(spark, d):
    return api.capabilities(spark).groupBy("support").agg(F.count("*").cast("int").alias("n"))


@query("e04_dispatch_family", values("abstract_path, concrete_path", [("shop/core.py", "shop/core.py"), ("geo/shape.go", "geo/shape.go")]))
def family(spark, d):
    return calls.families(sample(spark).tables).select(F.substring_index("abstract_id", ":", 1).alias("abstract_path"), F.substring_index("concrete_id", ":", 1).alias("concrete_path"))


@query("e06_subtype_closure", values("src, dst", [("Book", "Item"), ("Square", "Shape")]))
def subtype_closure(spark, d):
    return calls.ancestors_of(sample(spark).tables)


@query("g09_hierarchy_callers", values("path", [("shop/core.py",)]))
def hierarchy_callers(spark, d):
    w = sample(spark)
    return reports.hierarchy_callers(w.graph, w.tables.symbols.where("qualified_name = 'Book::base'")).select(F.substring_index("node", ":", 1).alias("path"))


@query("g11_container_chain", values("name", [("Item",), ("cost",)]))
def container_chain(spark, d):
    w = sample(spark)
    return reports.holders(w.tables, w.tables.symbols.where("name = 'n' and path = 'shop/core.py'")).join(w.tables.symbols.select(F.col("symbol_id").alias("node"), "name"), "node").select("name")


@query("g17_unreachable_functions", values("name", [("dead_a",), ("dead_b",), ("_spared",), ("orphan_helper",), ("settings",)]))
def unreachable(spark, d):
    return sample(spark).unreachable().where("path like 'shop/%' and kind = 'function'").select("name")


@query("w05_chart_values", values("value, place, wins", [("c", 1, True), ("b", 2, False), ("a", 3, False), ("d", 4, False)]))
def chart_values(spark, d):
    rows = [("tag", "values.yaml", "chart", 0, "a"), ("tag", "prod.yaml", "file", 0, "b"), ("tag", "--set", "set", 1, "c"), ("tag", "other.yaml", "unpassed", 0, "d")]
    return reports.helm_values(spark.createDataFrame(rows, "key string, path string, source string, position int, value string")).select("value", "place", "wins")


@query("n08_normal_paths", values("path, normal", [("a/./b/../c", "a/c"), ("../x", "../x"), (".", ""), ("a//b", "a/b")]))
def normal(spark, d):
    paths = spark.createDataFrame([("a/./b/../c",), ("../x",), (".",), ("a//b",)], "path string")
    return paths.select("path", P.normal_paths(F.col("path")).alias("normal"))


@query("p02_line_and_column", "SELECT doc_id, CAST(len(string_split(half, chr(10))) AS INTEGER) AS line, CAST(length(string_split(half, chr(10))[-1]) + 1 AS INTEGER) AS col FROM (SELECT doc_id, left(coalesce(text, ''), length(coalesce(text, '')) // 2) AS half FROM documents)")
def line_and_column(spark, d):
    """Where the byte offset of each text's middle lies."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.octet_length(F.expr("substring(text, 1, int(length(text) div 2))"))
    return docs.select("doc_id", P.line_cols(F.col("text"), half).alias("p")).select("doc_id", "p.line", "p.col")
