"""Report queries over a workspace written from the driver's tables, with SQL that derives the answers from the tables alone.

A part is a Python function that calls the next part's, three calls in a row; brands are packages, sizes modules. Nations
are classes under their region's, regions Terraform folders and YAML files, and every size is an environment variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, graphs, reports
from ..operators.references import with_entities
from ..schemas import TYPES
from ..sources import workspace as W
from ..workspace import NotFound, Workspace
from .registry import query, t

_kept: dict[tuple[str, str], Workspace] = {}

#: Parts as functions: key, brand number, file, function name.
P = """p AS (SELECT p_partkey AS k, p_name, p_size, regexp_extract(p_brand, '([0-9]+)$', 1) AS b,
  'parts/b' || regexp_extract(p_brand, '([0-9]+)$', 1) || '/m' || p_size || '_' || (p_partkey // 2000) || '.py' AS f,
  CASE WHEN p_partkey % 8 = 1 THEN '_make_' ELSE 'make_' END || p_partkey AS fn FROM part)"""
#: Calls between them; c is the confidence that their resolution has.
E = """e AS (SELECT a.k AS src, z.k AS dst, a.f AS sf, z.f AS df, a.fn AS sfn, z.fn AS dfn, CASE WHEN a.f = z.f THEN 0 ELSE 1 END AS c
  FROM p a JOIN p z ON z.k = a.k + 1 WHERE a.k % 4 <> 0)"""
#: Each brand's test calls its first part.
T = "s AS (SELECT p.* FROM p JOIN (SELECT b, min(k) AS k FROM p GROUP BY b) USING (b, k))"


def _files(spark, d) -> DataFrame:
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    k = F.col("p_partkey")
    part = t(spark, d, "part").select(k.alias("k"), "p_name", "p_size", number.alias("b"), F.concat(F.lit("m"), F.col("p_size"), F.lit("_"), F.expr("p_partkey div 2000")).alias("m"), F.concat(F.when(k % 8 == 1, "_make_").otherwise("make_"), k).alias("fn"))
    ahead = part.select((F.col("k") - 1).alias("k"), F.col("b").alias("nb"), F.col("m").alias("nm"), F.col("fn").alias("nfn")).where("k % 4 <> 0")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), t(spark, d, "part").count() // 20_000 + 1)  # a task's share of the files doesn't grow with the table
    part = part.join(ahead, "k", "left")
    lines = lambda *cs: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])
    c = F.col
    env = F.when(c("k") % 10 == 0, lines('    os.getenv("SIZE_', c("p_size"), '")\n')).otherwise("")
    body = lines("\n\ndef ", c("fn"), '(x):\n    """Part ', c("p_name"), '."""\n    y = x\n', env, "    return ", F.when(c("nfn").isNull(), "y").otherwise(lines(c("nfn"), "(y)")), "\n")
    far = F.when(c("nfn").isNotNull() & ((c("nb") != c("b")) | (c("nm") != c("m"))), lines("from parts.b", c("nb"), ".", c("nm"), " import ", c("nfn"), "\n"))
    joined = lambda x: F.array_join(x, "")
    modules = part.repartition(tasks, "b", "m").groupBy("b", "m").agg(F.sort_array(F.collect_set(far)).alias("imports"), F.sort_array(F.collect_list(F.struct("k", body.alias("body")))).alias("bodies"))
    modules = modules.select(lines("parts/b", c("b"), "/", c("m"), ".py").alias("path"), lines(joined("imports"), joined(F.col("bodies.body"))).alias("text"))
    brands = part.groupBy("b").agg(F.min_by(F.struct("m", "fn"), "k").alias("first"))
    util = brands.select(lines("parts/b", c("b"), "/util.py"), F.lit("def shared(x):\n    return x\n"))
    tests = brands.select(lines("tests/test_b", c("b"), ".py"), lines("from parts.b", c("b"), ".", c("first.m"), " import ", c("first.fn"), "\n\n\ndef test_b", c("b"), "():\n    assert ", c("first.fn"), "(1)\n"))
    place = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(c("n_nationkey").alias("n"), "n_name", c("r_regionkey").alias("r"), "r_name")

    def by_region(path: tuple, first, each) -> DataFrame:
        rows = place.groupBy("r", "r_name").agg(F.sort_array(F.collect_list(F.struct("n", each.alias("x")))).alias("xs"))
        return rows.select(lines(*path), lines(first, joined(F.col("xs.x"))))

    geo = by_region(("geo/r", c("r"), ".py"), lines("class Region_", c("r"), ":\n    def code(self):\n        return ", c("r"), "\n"), lines("\n\nclass Nation_", c("n"), "(Region_", c("r"), "):\n    def code(self):\n        return ", c("n"), "\n\n    def name(self):\n        return self.code()\n"))
    keys = by_region(("deploy/r", c("r"), ".yaml"), lines("regions:\n  ", c("r_name"), ":\n"), lines("    ", c("n_name"), ": ", c("n"), "\n"))
    infra = by_region(("infra/r", c("r"), "/main.tf"), F.lit(""), lines('variable "n', c("n"), '" {\n  default = ', c("n"), "\n}\n\n"))
    given = by_region(("infra/r", c("r"), "/terraform.tfvars"), F.lit(""), F.when(c("n") % 2 == 0, lines("n", c("n"), " = ", c("n") + 100, "\n")).otherwise(""))
    sizes = part.select("p_size").distinct().groupBy().agg(F.sort_array(F.collect_list("p_size")).alias("sizes"))  # few: a dimension
    sizes = sizes.select(F.lit("deploy/sizes.yaml"), lines("env:\n", joined(F.transform("sizes", lambda s: lines("  - name: SIZE_", s, "\n    value: s", s, "\n")))))
    out = modules
    for x in (util, tests, geo, keys, infra, given, sizes):
        out = out.union(x.coalesce(1))  # a few rows, one for each brand or region
    return out


def shop(spark, d) -> Workspace:
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        for old in _kept.values():
            old.close()
            old.given.unpersist()
        _kept.clear()
        _kept[key] = Workspace(_files(spark, d).persist())
    return _kept[key]


# -- F: filters and predicates ------------------------------------------------------------------------------------------


@query("f01_name_substring", f"WITH {P} SELECT f AS path, fn AS name, 'function' AS kind FROM p WHERE contains(fn, 'make_1')")
def f01(spark, d):
    return shop(spark, d).symbols(name="make_1").select("path", "name", "kind")


@query("f02_kind_equality", "SELECT 'geo/r' || n_regionkey || '.py' AS path, 'Nation_' || n_nationkey AS name FROM nation UNION ALL SELECT 'geo/r' || r_regionkey || '.py', 'Region_' || r_regionkey FROM region")
def f02(spark, d):
    return shop(spark, d).symbols(kind="class").select("path", "name")


@query("f03_functions_under_roots", f"WITH {P} SELECT f AS path, fn AS name FROM p WHERE b IN ('1', '12') UNION ALL SELECT DISTINCT 'parts/b' || b || '/util.py', 'shared' FROM p WHERE b IN ('1', '12')")
def f03(spark, d):
    return shop(spark, d).symbols(kind="function", roots=["parts/b1", "parts/b12"]).select("path", "name")


@query("f05_qualified_name_with_fallback", """
SELECT 'Region_1::code' AS want, 'geo/r1.py' AS path, 'Region_1::code' AS qualified_name, 'primary' AS role FROM region WHERE r_regionkey = 1
UNION ALL SELECT 'Region_1::code', 'geo/r1.py', 'Nation_' || n_nationkey || '::code', 'implementation' FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'none::code', 'geo/r' || n_regionkey || '.py', 'Nation_' || n_nationkey || '::code', 'primary' FROM nation
UNION ALL SELECT 'none::code', 'geo/r' || r_regionkey || '.py', 'Region_' || r_regionkey || '::code', 'primary' FROM region""")
def f05(spark, d):
    """A qualified name, and one whose qualifier nothing has, which falls back to its last part."""
    w = shop(spark, d)
    one, two = (reports.definitions(w.tables, x).select(F.lit(x).alias("want"), "path", "qualified_name", "role") for x in ("Region_1::code", "none::code"))
    return one.union(two)


@query("f14_glob_names", f"WITH {P} SELECT f AS path, fn AS name FROM p WHERE fn LIKE 'make\\_%7' ESCAPE '\\' AND position('7' IN substr(fn, 6)) = length(fn) - 5")
def f14(spark, d):
    """A glob's parts are taken at their leftmost place, so make_77 doesn't fit."""
    return shop(spark, d).run("step a\n  select symbols\n  where kind=function name~make_*7\n  report\n")[0]["rows"].select("path", "name")


@query("f13_files_by_path", f"WITH {P} SELECT DISTINCT f AS path FROM p WHERE f LIKE 'parts/b2/m%\\_0.py' ESCAPE '\\'")
def f13(spark, d):
    return shop(spark, d).run("step a\n  select files\n  where file~parts/b2/m*_0.py\n  report\n")[0]["rows"].select("path")


@query("f16_entry_rules", f"WITH {P} SELECT DISTINCT 'tests/test_b' || b || '.py' AS path, 'test_b' || b AS name, 'test' AS kind, 'pytest-function' AS rule FROM p")
def f16(spark, d):
    w = shop(spark, d)
    return w.entry_points("test").join(w.tables.symbols.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "kind", "rule")


_UNUSED = f"{P}, {T}, u AS (SELECT f AS path, fn AS name, CASE WHEN k % 8 = 1 THEN 'underscore' END AS spared FROM p WHERE k % 4 IN (0, 1) AND (k % 4 = 1 OR k = 0) AND k NOT IN (SELECT k FROM s) UNION ALL SELECT DISTINCT 'parts/b' || b || '/util.py', 'shared', NULL FROM p)"


@query("f24_first_reason", f"WITH {_UNUSED} SELECT * FROM u")
def f24(spark, d):
    return shop(spark, d).unused().where("kind = 'function'").select("path", "name", "spared")


# -- J: joins ------------------------------------------------------------------------------------------------------------


@query("j01_name_candidates", f"WITH {P}, {E}, {T} SELECT sf AS path, dfn AS name, 1::BIGINT AS candidates FROM e UNION ALL SELECT 'tests/test_b' || b || '.py', fn, 1 FROM s")
def j01(spark, d):
    """Definitions that share a call's name, counted without making pairs."""
    w = shop(spark, d)
    counts = w.tables.symbols.where("kind = 'function'").groupBy("name").agg(F.count("*").alias("candidates"))
    return w.tables.refs.where("kind = 'call'").join(counts, "name").select("path", "name", "candidates")


@query("j02_resolved_calls", f"""
WITH {P}, {E}, {T} SELECT sf AS path, dfn AS name, df AS target, CAST(c AS INTEGER) AS confidence FROM e
UNION ALL SELECT 'tests/test_b' || b || '.py', fn, f, 1 FROM s UNION ALL SELECT 'geo/r' || n_regionkey || '.py', 'code', 'geo/r' || n_regionkey || '.py', 0 FROM nation""")
def j02(spark, d):
    return shop(spark, d).resolved.where("kind = 'call' and target_id is not null").select("path", "name", F.split("target_id", ":")[0].alias("target"), "confidence")


@query("j05_enclosing_callable", f"WITH {P}, {E} SELECT sfn AS caller, dfn AS callee FROM e UNION ALL SELECT 'test_b' || s.b, s.fn FROM (SELECT p.* FROM p JOIN (SELECT b, min(k) AS k FROM p GROUP BY b) USING (b, k)) s UNION ALL SELECT 'name', 'code' FROM nation")
def j05(spark, d):
    w = shop(spark, d)
    inside = w.tables.symbols.select(F.col("symbol_id").alias("enclosing_id"), F.col("name").alias("caller"))
    return w.resolved.where("kind = 'call' and target_id is not null").join(inside, "enclosing_id").select("caller", F.col("name").alias("callee"))


@query("j09_import_bindings", f"WITH {P}, {E}, {T} SELECT DISTINCT sf AS path, dfn AS name, df AS target, 1 AS confidence FROM e WHERE c = 1 UNION ALL SELECT 'tests/test_b' || b || '.py', fn, f, 1 FROM s")
def j09(spark, d):
    return shop(spark, d).resolved.where("in_import").select("path", "name", F.split("target_id", ":")[0].alias("target"), "confidence")


@query("j17_names_a_type", "SELECT 'geo/r' || n_regionkey || '.py' AS path, 'Region_' || n_regionkey AS name FROM nation")
def j17(spark, d):
    w = shop(spark, d)
    return w.tables.refs.join(w.tables.symbols.where(F.col("kind").isin(TYPES)).select("name"), "name", "left_semi").select("path", "name")


@query("j18_references_to_entity", f"WITH {P}, {E}, {T}, w AS (SELECT 'tests/test_b' || b || '.py' AS path FROM s WHERE k % 4 = 3) SELECT sf AS path FROM e WHERE dst % 4 = 3 UNION ALL SELECT path FROM w UNION ALL SELECT * FROM (SELECT DISTINCT sf FROM e WHERE dst % 4 = 3 AND c = 1 UNION SELECT path FROM w)")
def j18(spark, d):
    """References of every third part of a chain: all calls, and the files that import one."""
    w = shop(spark, d)
    targets = w.tables.symbols.where("kind = 'function' and regexp_extract(name, 'make_([0-9]+)$', 1) <> '' and cast(regexp_extract(name, 'make_([0-9]+)$', 1) as bigint) % 4 = 3")
    refs = reports.references_to(w.resolved, targets)
    return refs.where("not in_import").select("path").unionAll(refs.where("in_import").select("path").distinct())


@query("j19_same_name_elsewhere", "SELECT 'geo/r' || n_regionkey || '.py' AS path, CASE WHEN n_regionkey = 1 THEN 'reference' ELSE 'same-name' END AS kind FROM nation")
def j19(spark, d):
    return shop(spark, d).usages("Region_1::code").select("path", "kind")


@query("j20_unaccounted_mentions", f"WITH {P} SELECT f AS path, count(*) AS n FROM p WHERE list_contains(string_split(p_name, ' '), 'widget') GROUP BY f")
def j20(spark, d):
    return shop(spark, d).mentions("widget").groupBy("path").agg(F.count("*").alias("n"))


@query("j23_declarations_and_readers", f"WITH {P} SELECT 'SIZE_' || p_size AS name, 's' || p_size AS value, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (k % 10 = 0), '') AS readers, count(*) FILTER (k % 10 = 0) = 0 AS orphan FROM p GROUP BY p_size")
def j23(spark, d):
    return shop(spark, d).stitch().select("name", "value", F.array_join("readers", ",").alias("readers"), "orphan")


@query("j28_position_join", f"WITH {P} SELECT f AS path, count(*) AS n FROM p GROUP BY f")
def j28(spark, d):
    """Initialisers that begin where a symbol is defined."""
    w = shop(spark, d)
    return w.tables.flows.where("path like 'parts/%'").join(w.tables.symbols.where("kind = 'variable'").select("symbol_id"), "symbol_id").groupBy("path").agg(F.count("*").alias("n"))


# -- E, A: entities and aggregates ---------------------------------------------------------------------------------------

_CALLABLES = f"""{P}, c AS (SELECT fn AS name, f AS path, fn || k AS entity FROM p UNION ALL SELECT DISTINCT 'shared', 'parts/b' || b || '/util.py', 'shared' || b FROM p UNION ALL SELECT DISTINCT 'test_b' || b, 'tests/test_b' || b || '.py', 'test' || b FROM p
UNION ALL SELECT 'code', 'geo/r' || n_regionkey || '.py', 'n' || n_nationkey FROM nation UNION ALL SELECT 'name', 'geo/r' || n_regionkey || '.py', 'm' || n_nationkey FROM nation UNION ALL SELECT 'code', 'geo/r' || r_regionkey || '.py', 'r' || r_regionkey FROM region)"""


@query("e01_definition_group", f"WITH {_CALLABLES} SELECT name, count(DISTINCT entity) AS entities, count(*) AS sites FROM c GROUP BY name")
def e01(spark, d):
    return with_entities(shop(spark, d).tables.symbols).where("kind in ('function', 'method')").groupBy("name").agg(F.count_distinct("entity").alias("entities"), F.count("*").alias("sites"))


@query("e02_count_entities", f"WITH {_CALLABLES} SELECT path, count(DISTINCT entity) AS entities FROM c GROUP BY path")
def e02(spark, d):
    return with_entities(shop(spark, d).tables.symbols).where("kind in ('function', 'method')").groupBy("path").agg(F.count_distinct("entity").alias("entities"))


@query("e03_one_entity", f"WITH {_CALLABLES} SELECT name FROM c GROUP BY name HAVING count(DISTINCT entity) = 1")
def e03(spark, d):
    return with_entities(shop(spark, d).tables.symbols).where("kind in ('function', 'method')").groupBy("name").agg(F.count_distinct("entity").alias("n")).where("n = 1").select("name")


@query("e07_implementations", "SELECT 'geo/r' || n_regionkey || '.py' AS path, 'Nation_' || n_nationkey || '::code' AS qualified_name FROM nation WHERE n_regionkey = 2")
def e07(spark, d):
    return shop(spark, d).implementations("Region_2::code").select("path", "qualified_name")


@query("e06_subtypes", "SELECT 'Nation_' || n_nationkey AS src, 'Region_' || n_regionkey AS dst FROM nation")
def e06(spark, d):
    from ..operators.calls import ancestors_of

    return ancestors_of(shop(spark, d).tables)


@query("e08_ambiguous_names", f"WITH {_CALLABLES} SELECT name, count(DISTINCT path) AS files FROM (SELECT name, path FROM c UNION ALL SELECT 'name', 'deploy/sizes.yaml' UNION ALL SELECT 'regions', 'deploy/r' || r_regionkey || '.yaml' FROM region) GROUP BY name HAVING count(DISTINCT path) > 1")
def e08(spark, d):
    return reports.ambiguous_names(shop(spark, d).tables)


_REFS = f"""{P}, {E}, {T}, r AS (SELECT 2 * (SELECT count(*) FROM p) + (SELECT count(*) FROM e) + 2 * (SELECT count(*) FILTER (k % 10 = 0) FROM p) + (SELECT count(*) FROM (SELECT DISTINCT sf, dfn FROM e WHERE c = 1))
 + 2 * (SELECT count(*) FROM s) + (SELECT count(DISTINCT b) FROM p) + 3 * (SELECT count(*) FROM nation) AS n, 2 * (SELECT count(*) FILTER (k % 10 = 0) FROM p) AS open)"""


@query("q02_stats", f"""
WITH {_REFS} SELECT 'python' AS language, (SELECT count(DISTINCT f) + 2 * count(DISTINCT b) FROM p) + (SELECT count(*) FROM region) AS files,
  3 * (SELECT count(*) FROM p) + 3 * (SELECT count(DISTINCT b) FROM p) + 5 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region) AS symbols, n AS "references", n - open AS resolved FROM r""")
def q02(spark, d):
    return shop(spark, d).stats().where("language = 'python'").select("language", "files", "symbols", "references", "resolved")


@query("a01_statistics", f"WITH {_REFS} SELECT 1 AS confidence, CAST((SELECT count(*) FILTER (c = 1) FROM e) + (SELECT count(*) FROM (SELECT DISTINCT sf, dfn FROM e WHERE c = 1)) + 2 * (SELECT count(*) FROM s) AS BIGINT) AS n FROM r")
def a01(spark, d):
    """References that an import decides."""
    return shop(spark, d).resolved.where("target_id is not null and confidence = 1").groupBy("confidence").agg(F.count("*").alias("n"))


@query("a02_parsed_files", f"WITH {P} SELECT 'python' AS language, (SELECT count(DISTINCT f) + 2 * count(DISTINCT b) FROM p) + (SELECT count(*) FROM region) AS files, 0::BIGINT AS with_errors UNION ALL SELECT 'yaml', (SELECT count(*) FROM region) + 1, 0 UNION ALL SELECT 'hcl', 2 * (SELECT count(*) FROM region), 0")
def a02(spark, d):
    return shop(spark, d).parse_tally().select("language", "files", "with_errors")


@query("a03_impact_by_kind", f"WITH {P}, {E}, {T} SELECT 'caller' AS kind, 3 + (SELECT count(*) FROM s WHERE k BETWEEN 2 AND 4) AS n UNION ALL SELECT 'reference', 1 + c + 2 * (SELECT count(*) FROM s WHERE k = 4) FROM e WHERE dst = 4")
def a03(spark, d):
    return shop(spark, d).impact("make_4").groupBy("kind").agg(F.count("*").alias("n"))


@query("a04_edges_by_tier", f"WITH {P}, {E}, {T}, x AS (SELECT c FROM e UNION ALL SELECT 1 FROM s UNION ALL SELECT 0 FROM nation) SELECT CASE c WHEN 0 THEN 'exact' ELSE 'import-qualified' END AS tier, 'resolved' AS origin, CAST(count(*) AS INTEGER) AS edges FROM x GROUP BY c")
def a04(spark, d):
    return reports.graph_summary(shop(spark, d).graph)


@query("a07_weakest_link", f"WITH {P}, {E} SELECT p.fn AS name, CAST(max(e.c) AS INTEGER) AS tier FROM p JOIN e ON e.src >= p.k AND e.dst <= ((p.k + 3) // 4) * 4 WHERE p.k % 4 <> 0 AND ((p.k + 3) // 4) * 4 IN (SELECT k FROM p) GROUP BY p.fn")
def a07(spark, d):
    w = shop(spark, d)
    ends = w.graph["nodes"].where("name rlike 'make_[0-9]+$'").where(F.regexp_extract("name", "([0-9]+)$", 1).cast("bigint") % 4 == 0)
    tainted = graphs.taint(w.graph["edges"], ends.select("node"), 3)
    return tainted.join(w.graph["nodes"].select("node", "name"), "node").where("name rlike 'make_'").select("name", "tier")


@query("a11_unused_summary", f"WITH {_UNUSED} SELECT coalesce(spared, 'unused') AS verdict, count(*) AS n FROM u GROUP BY 1")
def a11(spark, d):
    return shop(spark, d).unused().where("kind = 'function'").groupBy(F.coalesce("spared", F.lit("unused")).alias("verdict")).agg(F.count("*").alias("n"))


@query("a12_distinct_files", f"WITH {P}, {E} SELECT count(DISTINCT sf) AS files FROM e WHERE c = 1")
def a12(spark, d):
    """Files that call into others."""
    return shop(spark, d).graph["edges"].where("path like 'parts/%' and confidence = 1").agg(F.count_distinct("path").alias("files"))


# -- L, U, K, R, S, X ----------------------------------------------------------------------------------------------------


@query("l04_first_subjects", f"WITH {P} SELECT f AS path, fn AS name FROM p WHERE fn LIKE 'make%' AND b = '3' ORDER BY f, k LIMIT 20")
def l04(spark, d):
    return shop(spark, d).run("step a\n  select symbols\n  where kind=function in=parts/b3/ name~make*\n  limit 20\n  report\n")[0]["rows"].select("path", "name")


@query("l06_nearest_names", f"WITH {_CALLABLES}, n AS (SELECT name FROM c UNION SELECT 'Nation_' || n_nationkey FROM nation UNION SELECT 'Region_' || r_regionkey FROM region) SELECT name FROM n ORDER BY levenshtein(name, 'Nation_O1'), name LIMIT 3")
def l06(spark, d):
    try:
        shop(spark, d).target("Nation_O1")
    except NotFound as e:
        return spark.createDataFrame([(n,) for n in e.near], "name string")


@query("u01_union_of_kinds", f"WITH {P}, b AS (SELECT DISTINCT b FROM p) SELECT 'function' AS kind, (SELECT count(*) FROM p) + 2 * (SELECT count(*) FROM b) AS n UNION ALL SELECT 'method', 2 * (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'class', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def u01(spark, d):
    return shop(spark, d).symbols().where("kind in ('function', 'method', 'class') and language = 'python'").groupBy("kind").agg(F.count("*").alias("n"))


@query("u03_set_difference", f"WITH {P} SELECT f AS path, fn AS name FROM p WHERE b = '5' AND position('7' IN fn) <> length(fn)")
def u03(spark, d):
    return shop(spark, d).run("step a\n  select symbols\n  where kind=function in=parts/b5/ !name~*7 !name=shared\n  report\n")[0]["rows"].select("path", "name")


@query("u05_union_of_roots", f"WITH {P}, {T} SELECT 'test_b' || b AS name FROM s")
def u05(spark, d):
    """Entry points and what files call at their top, once each."""
    w = shop(spark, d)
    seeds = w.entries.select(F.col("symbol_id").alias("node")).union(w.graph["file_scope"].select(F.col("dst").alias("node"))).distinct()
    return w.graph["nodes"].join(seeds, "node").select("name")


@query("u08_conjunction_of_sets", f"WITH {P}, {E}, {T} SELECT sf AS path, sfn AS name FROM e WHERE dfn = 'make_11' UNION ALL SELECT 'tests/test_b' || b || '.py', 'test_b' || b FROM s WHERE k = 11")
def u08(spark, d):
    return shop(spark, d).run("step a\n  select symbols\n  where kind=function calls=make_11 !unused\n  allow-empty\n  report\n")[0]["rows"].select("path", "name")


@query("g07_reached_from_tests", f"WITH {P}, {T} SELECT p.fn AS name FROM p WHERE EXISTS (SELECT 1 FROM s WHERE p.k BETWEEN s.k AND ((s.k + 3) // 4) * 4) UNION ALL SELECT 'test_b' || b FROM s")
def g07(spark, d):
    w = shop(spark, d)
    reached = graphs.reach(w.graph["edges"], w.entries.select(F.col("symbol_id").alias("node")))
    return w.graph["nodes"].join(reached, "node").select("name")


@query("g08_call_roots", f"WITH {P}, {E}, {T} SELECT fn AS name FROM p WHERE k NOT IN (SELECT dst FROM e) AND k NOT IN (SELECT k FROM s) UNION ALL SELECT 'test_b' || b FROM s UNION ALL SELECT 'shared' FROM s UNION ALL SELECT 'name' FROM nation UNION ALL SELECT 'code' FROM region")
def g08(spark, d):
    w = shop(spark, d)
    return graphs.roots(w.graph["nodes"].select("node", "name"), w.graph["edges"]).select("name")


@query("g17_unreachable_parts", f"WITH {P}, {T} SELECT fn AS name FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE p.k BETWEEN s.k AND ((s.k + 3) // 4) * 4)")
def g17(spark, d):
    return shop(spark, d).unreachable().where("name rlike '^_?make_'").select("name")


@query("k06_cache_misses", f"WITH {P} SELECT DISTINCT f AS path FROM p WHERE NOT starts_with(f, 'parts/b1/')")
def k06(spark, d):
    """Files whose content a cache that holds one brand's facts doesn't have."""
    files = shop(spark, d).files.where("path like 'parts/%'")
    cached = files.where("path like 'parts/b1/%'").select(F.sha2(F.concat("language", F.lit("\0"), "text"), 256).alias("key"))
    return facts.missing_from_cache(files, cached).select("path")


@query("r02_join_segments", "SELECT n_name AS name, 'regions.' || r_name || '.' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def r02(spark, d):
    keys = shop(spark, d).symbols(kind="key").where("path like 'deploy/r%' and qualifier like 'regions.%'")
    return keys.select("name", F.concat_ws(".", "qualifier", "name").alias("path"))


@query("r03_json_rows", f"""WITH {P}, {E}, {T} SELECT '{{"callee":"' || dfn || '","caller":"' || sfn || '"}}' AS json FROM e WHERE c = 1""")
def r03(spark, d):
    w = shop(spark, d)
    name = lambda a, b: w.graph["nodes"].select(F.col("node").alias(a), F.col("name").alias(b))
    rows = w.graph["edges"].where("confidence = 1 and path like 'parts/%'").join(name("src", "caller"), "src").join(name("dst", "callee"), "dst")
    return graphs.as_json(rows.select("caller", "callee"))


@query("q15_terraform_defaults", "SELECT 'infra/r' || n_regionkey || '/n' || n_nationkey AS subject, n_nationkey::VARCHAR AS value, n_nationkey % 2 <> 0 AS wins FROM nation UNION ALL SELECT 'infra/r' || n_regionkey || '/n' || n_nationkey, (n_nationkey + 100)::VARCHAR, true FROM nation WHERE n_nationkey % 2 = 0")
def q15(spark, d):
    return shop(spark, d).terraform().select("subject", "value", "wins")


@query("s03_languages_of_files", f"WITH {P} SELECT 'python' AS language, (SELECT count(DISTINCT f) + 2 * count(DISTINCT b) FROM p) + (SELECT count(*) FROM region) AS files UNION ALL SELECT 'yaml', (SELECT count(*) FROM region) + 1 UNION ALL SELECT 'hcl', 2 * (SELECT count(*) FROM region)")
def s03(spark, d):
    return shop(spark, d).files.groupBy("language").agg(F.count("*").alias("files"))


@query("s05_size_rejects", "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 8192 THEN 'too-large' ELSE 'ok' END AS status FROM documents")
def s05(spark, d):
    """Rejects are rows with a status, never dropped silently."""
    kept, large = W.split_by_size(t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), 8192)
    return kept.select("doc_id", F.lit("ok").alias("status")).union(large.select("doc_id", F.lit("too-large").alias("status")))


@query("s07_census", r"SELECT coalesce(nullif(lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)), ''), 'no extension') AS ext, count(*) AS n FROM pages WHERE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) NOT IN ('html', 'htm', 'xml', 'css', 'js', 'md', 'sh') GROUP BY 1")
def s07(spark, d):
    return W.census(t(spark, d, "pages").select(F.col("url").alias("path")))



# -- a second workspace: types, flags, modules, charts and scripts from nations and regions -------------------------------

_kits: dict[tuple[str, str], Workspace] = {}


def kit(spark, d) -> Workspace:
    """A Python module for each nation; for each region a Terraform module, a subchart, a script, a stylesheet, a server action and a ConfigMap with its reader."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kits:
        for old in _kits.values():
            old.close()
            old.given.unpersist()
        _kits.clear()
        _kits[key] = Workspace(_kit_files(spark, d).persist())
    return _kits[key]


_MODULE = """FLAG_# = True


class Kind_#:
    size: int = 0


def build_#(x: str, y: int) -> Kind_#:
    a = #
    b = Kind_#()
    c = build_#("s", 1)
    d = b
    e = d
    f = x
    g = 1 + 2
    h = c.size
    return c


def use_#():
    if FLAG_# and not False:
        return build_#("t", #)
    else:
        return old_#()


def old_#():
    return None
"""
#: For each region: path and text; # is its key, + the next one's.
_OF_REGION = [
    ("stack/r#/main.tf", 'variable "size" {\n  default = 1\n}\n\nvariable "zone" {\n  default = "a"\n}\n\noutput "total" {\n  value = var.size\n}\n'),
    ("chart/charts/r#/Chart.yaml", "name: r#\n"),
    ("chart/charts/r#/values.yaml", "size: 0\nown: 1\n"),
    ("chart/charts/r#/templates/a.yaml", "x: {{ .Values.size }}\ny: {{ .Values.own }}\n"),
    ("run/r#.sh", 'source ./r+.sh\nstart_#() {\n  echo "#"\n}\n'),
    ("style/r#.css", '@import "r+.css";\n.c# { color: red; }\n#i .c# { color: blue; }\n'.replace("#i", "[id]")),
    ("base/r#.py", "class Base_#:\n    def code(self):\n        return #\n\n    def twice(self):\n        return self.code()\n\n\nclass Leaf_#(Base_#):\n    def code(self):\n        return 0\n"),
    ("web/act#.ts", '"use server";\n\nexport function act_#() {\n  return #;\n}\n'),
    ("k8s/r#.yaml", "kind: ConfigMap\nmetadata:\n  name: conf-#\ndata:\n  MODE: m#\n---\nkind: Pod\nmetadata:\n  name: pod-#\nenv:\n  - name: MODE\n    valueFrom:\n      configMapKeyRef:\n        name: conf-#\n        key: MODE\n"),
]


def _kit_files(spark, d) -> DataFrame:
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"))
    r = t(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("k"), (F.col("r_regionkey") + 1).cast("string").alias("after"))
    text = lambda x: F.replace(F.lit(x), F.lit("#"), F.col("k"))
    out = n.select(text("kit/n#.py").alias("path"), text(_MODULE).alias("text"))
    for path, body in _OF_REGION:
        out = out.union(r.select(text(path), F.replace(text(body), F.lit("+"), F.col("after"))))
    gathered = lambda df, x, sep="": F.array_join(F.array_sort(F.collect_list(x)), sep)
    root = r.groupBy().agg(gathered(r, text('module "r#" {\n  source = "./r#"\n  size = 10#\n}\n\noutput "r#" {\n  value = module.r#.total\n}\n\n')).alias("x"))  # one file names all regions
    chart = r.groupBy().agg(gathered(r, text("r#:\n  size: 2#\n")).alias("x"))
    scripts = n.groupBy().agg(gathered(n, text('n# = "kit.n#:use_#"\n')).alias("x"))
    out = out.union(root.select(F.lit("stack/main.tf"), "x")).union(chart.select(F.lit("chart/values.yaml"), "x")).union(scripts.select(F.lit("pyproject.toml"), F.concat(F.lit("[project.scripts]\n"), "x")))
    return out.union(spark.createDataFrame([("chart/Chart.yaml", "name: top\n")], "path string, text string"))


@query("q17_types", """
WITH n AS (SELECT n_nationkey AS k, 'kit/n' || n_nationkey || '.py' AS path, 'Kind_' || n_nationkey AS made FROM nation)
SELECT path, name, type, basis FROM n, LATERAL (VALUES ('FLAG_' || k, 'bool', 'literal'), ('size', 'int', 'declared'), ('build_' || k, made, 'declared'), ('x', 'str', 'declared'), ('y', 'int', 'declared'), ('a', 'int', 'literal'), ('b', made, 'construction'),
  ('c', made, 'return-of-call'), ('d', made, 'construction'), ('e', made, 'construction'), ('f', 'str', 'declared'), ('g', 'int', 'both-operands'), ('h', 'int', 'field')) AS v(name, type, basis)""")
def q17(spark, d):
    w = kit(spark, d)
    return w.types.join(w.tables.symbols.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "type", "basis")


@query("s13_packaged_commands", "SELECT 'kit/n' || n_nationkey || '.py' AS path, 'use_' || n_nationkey AS name, 'main' AS kind, 'python-console-script' AS rule FROM nation")
def s13(spark, d):
    w = kit(spark, d)
    return w.entry_points().where("rule = 'python-console-script'").join(w.tables.symbols.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "kind", "rule")


@query("f19_directives", "SELECT 'web/act' || r_regionkey || '.ts' AS path, 'act_' || r_regionkey AS name, 'next-server-action' AS rule FROM region")
def f19(spark, d):
    w = kit(spark, d)
    return w.entry_points().where("kind = 'http'").join(w.tables.symbols.select("symbol_id", "path", "name"), "symbol_id").select("path", "name", "rule")


@query("j13_module_outputs", "SELECT 'stack/main.tf' AS path, 'total' AS name, 'stack/r' || r_regionkey || '/main.tf' AS target, 0 AS confidence FROM region")
def j13(spark, d):
    return kit(spark, d).resolved.where("receiver like 'module.%'").select("path", "name", F.split("target_id", ":")[0].alias("target"), "confidence")


@query("j29_module_callers", "SELECT 'stack/r' || r_regionkey AS child, 'r' || r_regionkey AS label, variable, CASE WHEN variable = 'size' THEN '10' || r_regionkey END AS value FROM region, (VALUES ('size'), ('zone')) AS v(variable)")
def j29(spark, d):
    return kit(spark, d).module_callers().select("child", "label", "variable", "value")


@query("j14_object_keys", "SELECT 'k8s/r' || r_regionkey || '.yaml' AS path, 'ConfigMap/conf-' || r_regionkey AS receiver, 'k8s/r' || r_regionkey || '.yaml' AS target FROM region")
def j14(spark, d):
    return kit(spark, d).resolved.where("receiver like 'ConfigMap/%'").select("path", "receiver", F.split("target_id", ":")[0].alias("target"))


@query("j15_chart_keys", "SELECT 'chart/charts/r' || r_regionkey || '/templates/a.yaml' AS path, name, 'chart/charts/r' || r_regionkey || '/values.yaml' AS target FROM region, (VALUES ('size'), ('own')) AS v(name)")
def j15(spark, d):
    return kit(spark, d).resolved.where("language = 'helm' and kind = 'string-ref'").select("path", "name", F.split("target_id", ":")[0].alias("target"))


@query("j30_chart_levels", """
SELECT 'chart/charts/r' || r_regionkey || '/' || k AS key, source, v AS value, source = 'enclosing' OR k = 'own' AS wins FROM region, LATERAL (VALUES ('size', 'chart', '0'), ('own', 'chart', '1'), ('size', 'enclosing', '2' || r_regionkey)) AS x(k, source, v)
UNION ALL SELECT 'chart/r' || r_regionkey || '.size', 'chart', '2' || r_regionkey, true FROM region""")
def j30(spark, d):
    return kit(spark, d).helm().select("key", "source", "value", "wins")


@query("g13_visible_scripts", "SELECT 'run/r' || a.r_regionkey || '.sh' AS path, 'start_' || b.r_regionkey AS name FROM region a JOIN region b ON b.r_regionkey >= a.r_regionkey")
def g13(spark, d):
    return kit(spark, d).visible_scripts().select("path", "name")


@query("g14_style_imports", "SELECT 'style/r' || a.r_regionkey || '.css' AS src, 'style/r' || b.r_regionkey || '.css' AS dst FROM region a JOIN region b ON b.r_regionkey > a.r_regionkey")
def g14(spark, d):
    from ..operators.provenance import file_edges
    from ..operators.references import import_files

    w = kit(spark, d)
    return graphs.closure(file_edges(w.tables, import_files(w.tables), ["css", "scss"]))


@query("l05_first_definition", "SELECT min('kit/n' || n_nationkey || '.py') AS path, 'h' AS name FROM nation")
def l05(spark, d):
    return kit(spark, d).first_definition("h").select("path", "name")


@query("m05_inline", "SELECT 'kit/n' || n_nationkey || '.py' AS path, replacement FROM nation, (VALUES ('b'), ('')) AS v(replacement) WHERE n_nationkey = 5")
def m05(spark, d):
    w = kit(spark, d)
    place = w.tables.symbols.where("path = 'kit/n5.py' and name = 'd'").first()["symbol_id"]
    return w.inline_variable(place).select("path", "replacement")


@query("m06_signature", "SELECT 'kit/n' || n_nationkey || '.py' AS path, replacement FROM nation, LATERAL (VALUES ('y: int, x: str'), ('1, \"s\"'), (n_nationkey || ', \"t\"')) AS v(replacement) WHERE n_nationkey = 3")
def m06(spark, d):
    return kit(spark, d).change_signature("build_3", "move:1:0").select("path", "replacement")


@query("m09_remove_flag", "SELECT * FROM (VALUES (1, 'substitute', 1), (2, 'fold', 1), (3, 'remove-symbols', 2)) AS v(round, action, edits) WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 7)")
def m09(spark, d):
    """The rounds of a cascade."""
    _, rounds = kit(spark, d).remove_flag("FLAG_7", True)
    return spark.createDataFrame([(x["round"], x["action"], x["edits"]) for x in rounds], "round int, action string, edits int")


@query("a17_cache_counters", "SELECT count(*) AS files, count(*) FILTER (n_nationkey < 10) AS hits, count(*) FILTER (n_nationkey >= 10) AS misses, count(*) FILTER (n_nationkey < 10) AS entries FROM nation")
def a17(spark, d):
    files = kit(spark, d).files.where("path like 'kit/%'")
    cached = files.where("path rlike 'kit/n[0-9][.]py'").select(F.sha2(F.concat("language", F.lit("\0"), "text"), 256).alias("key"))
    return facts.cache_counters(files, cached)


@query("g02_dispatch_edges", "SELECT 'Base_' || r_regionkey || '::twice' AS caller, 'Leaf_' || r_regionkey || '::code' AS callee, 2 AS confidence FROM region")
def g02(spark, d):
    w = kit(spark, d)
    name = lambda a, b: w.tables.symbols.select(F.col("symbol_id").alias(a), F.col("qualified_name").alias(b))
    edges = w.graph["edges"].where("origin = 'hierarchy'")
    return edges.join(name("src", "caller"), "src").join(name("dst", "callee"), "dst").select("caller", "callee", "confidence")


@query("e04_method_families", "SELECT 'Base_' || r_regionkey || '::code' AS abstract, 'Leaf_' || r_regionkey || '::code' AS concrete FROM region")
def e04(spark, d):
    from ..operators.calls import families

    w = kit(spark, d)
    name = lambda a, b: w.tables.symbols.select(F.col("symbol_id").alias(a), F.col("qualified_name").alias(b))
    return families(w.tables).join(name("abstract_id", "abstract"), "abstract_id").join(name("concrete_id", "concrete"), "concrete_id").select("abstract", "concrete")


@query("w06_css_winners", "SELECT '.c' || r_regionkey || '|color|' AS subject, value, value = 'blue' AS wins FROM region, (VALUES ('red'), ('blue')) AS v(value)")
def w06(spark, d):
    return kit(spark, d).css().select("subject", "value", "wins")


@query("q14_flow_forward", "SELECT name, depth FROM nation, (VALUES ('b', 0), ('d', 1), ('e', 2)) AS v(name, depth) WHERE n_nationkey = 5")
def q14(spark, d):
    w = kit(spark, d)
    place = w.tables.symbols.where("path = 'kit/n5.py' and name = 'b'").first()["symbol_id"]
    return w.flow(place, forward=True).join(w.tables.symbols.select(F.col("symbol_id").alias("node"), "name"), "node").select("name", "depth")


@query("m08_imports_by_status", f"WITH {P}, {E}, {T} SELECT 'live' AS status, (SELECT count(*) FROM (SELECT DISTINCT sf, dfn FROM e WHERE c = 1)) + (SELECT count(*) FROM s) AS n")
def m08(spark, d):
    from ..operators.edits import organized_imports

    w = shop(spark, d)
    return organized_imports(w.tables, w.resolved).groupBy("status").agg(F.count("*").alias("n"))


# -- facts and plans of the first workspace ------------------------------------------------------------------------------


@query("x06_scopes", f"WITH {P} SELECT f AS path, count(*) + 1 AS scopes FROM p GROUP BY f")
def x06(spark, d):
    return shop(spark, d).tables.scopes.where("path like 'parts/%/m%'").groupBy("path").agg(F.count("*").alias("scopes"))


@query("x07_references_in_function_scopes", f"WITH {P}, {E} SELECT p.f AS path, CAST(sum(2 + CASE WHEN e.dst IS NULL THEN 0 ELSE 1 END + CASE WHEN p.k % 10 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS n FROM p LEFT JOIN e ON e.src = p.k GROUP BY p.f")
def x07(spark, d):
    """References whose innermost scope holds them and isn't the file's."""
    w = shop(spark, d)
    scopes = w.tables.scopes.select("path", "scope_id", F.col("start").alias("a"), F.col("end").alias("b"))
    inside = w.tables.refs.join(scopes, ["path", "scope_id"]).where("scope_id > 0 and a <= start and start < b and path like 'parts/%/m%'")
    return inside.groupBy("path").agg(F.count("*").alias("n"))


@query("x09_containers", "SELECT 'code' AS name, 'method' AS kind, 'Region_' || r_regionkey AS holder FROM region UNION ALL SELECT m, 'method', 'Nation_' || n_nationkey FROM nation, (VALUES ('code'), ('name')) AS v(m)")
def x09(spark, d):
    """Functions in a class are its methods."""
    s = shop(spark, d).tables.symbols
    holder = s.select(F.col("symbol_id").alias("container_id"), F.col("name").alias("holder"), F.col("kind").alias("h_kind"))
    return s.where("path like 'geo/%'").join(holder, "container_id").where("h_kind = 'class'").select("name", "kind", "holder")


@query("x10_qualified_names", "SELECT 'Region_' || r_regionkey || '::code' AS qualified_name FROM region UNION ALL SELECT 'Nation_' || n_nationkey || '::' || m FROM nation, (VALUES ('code'), ('name')) AS v(m)")
def x10(spark, d):
    return shop(spark, d).symbols(kind="method").select("qualified_name")


@query("x17_receivers", f"WITH {P} SELECT 'self' AS receiver, 'code' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'os', 'getenv', count(*) FROM p WHERE k % 10 = 0")
def x17(spark, d):
    return shop(spark, d).tables.refs.where("receiver is not null and language = 'python'").groupBy("receiver", "name").agg(F.count("*").alias("n"))


@query("x24_imports", f"WITH {P}, {E}, {T} SELECT DISTINCT sf AS path, dfn AS name, replace(replace(df, '.py', ''), '/', '.') AS module FROM e WHERE c = 1 UNION ALL SELECT 'tests/test_b' || b || '.py', fn, replace(replace(f, '.py', ''), '/', '.') FROM s")
def x24(spark, d):
    return shop(spark, d).tables.bindings.where("language = 'python'").select("path", "name", "module")


@query("x26_text_spans", f"WITH {P} SELECT f AS path, CAST(sum(1 + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM p GROUP BY f")
def x26(spark, d):
    return shop(spark, d).tables.texts.where("path like 'parts/%'").groupBy("path").agg(F.count("*").alias("n"))


@query("x30_env_reads", f"WITH {P} SELECT DISTINCT f AS path, 'SIZE_' || p_size AS name FROM p WHERE k % 10 = 0")
def x30(spark, d):
    return reports.env_reads(shop(spark, d).tables).select("path", "name")


@query("x31_env_declarations", f"WITH {P} SELECT DISTINCT 'deploy/sizes.yaml' AS path, 'SIZE_' || p_size AS name, 's' || p_size AS value FROM p")
def x31(spark, d):
    return reports.env_declarations(shop(spark, d).tables)


@query("s04_language_filter", f"WITH {P} SELECT 'yaml' AS language, (SELECT count(*) FROM region) + 1 AS files")
def s04(spark, d):
    return Workspace(shop(spark, d).given, only=["yaml"]).files.groupBy("language").agg(F.count("*").alias("files"))


@query("f04_exact_name", f"WITH {P} SELECT f AS path, fn AS name FROM p WHERE fn = 'make_6'")
def f04(spark, d):
    return shop(spark, d).target("make_6").select("path", "name")


@query("f08_callables", f"WITH {_CALLABLES} SELECT CASE WHEN name IN ('code', 'name') THEN 'method' ELSE 'function' END AS kind, count(*) AS n FROM c GROUP BY 1")
def f08(spark, d):
    return shop(spark, d).graph["nodes"].groupBy("kind").agg(F.count("*").alias("n"))


@query("f12_in_path", f"WITH {P} SELECT f AS path, count(*) AS n FROM p WHERE contains(f, 'parts/b1') GROUP BY f")
def f12(spark, d):
    rows = shop(spark, d).run("step a\n  select symbols\n  where kind=function in=parts/b1 !name=shared\n  report\n")[0]["rows"]
    return rows.groupBy("path").agg(F.count("*").alias("n"))


@query("f22_safe_references", f"WITH {P}, {E}, {T} SELECT 'call' AS kind, (SELECT count(*) FROM e) + (SELECT count(*) FROM s) + (SELECT count(*) FROM nation) AS n")
def f22(spark, d):
    """Calls that an edit may rewrite."""
    return shop(spark, d).resolved.where("kind = 'call' and target_id is not null and confidence < 2").groupBy("kind").agg(F.count("*").alias("n"))


@query("j08_import_files", f"WITH {P}, {E}, {T} SELECT DISTINCT sf AS path, df AS file FROM e WHERE c = 1 UNION SELECT 'tests/test_b' || b || '.py', f FROM s")
def j08(spark, d):
    from ..operators.references import import_files

    return import_files(shop(spark, d).tables).where("path like '%.py'").select("path", "file").distinct()


@query("j27_next_siblings", f"WITH {P} SELECT f AS path, count(*) - 1 AS n FROM p GROUP BY f HAVING count(*) > 1")
def j27(spark, d):
    from ..operators.ranking import next_sibling

    rows = next_sibling(shop(spark, d).tables.symbols.where("kind = 'function' and path like 'parts/%/m%'").select("path", "full_start"), ["path"], "full_start")
    return rows.where("next_at is not null").groupBy("path").agg(F.count("*").alias("n"))


@query("a05_edges_by_origin", f"WITH {P}, {E}, {T} SELECT 'resolved' AS origin, (SELECT count(*) FROM e) + (SELECT count(*) FROM s) + (SELECT count(*) FROM nation) AS edges")
def a05(spark, d):
    return shop(spark, d).graph["edges"].groupBy("origin").agg(F.count("*").alias("edges"))


@query("a06_graph_counts", f"WITH {_CALLABLES} SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM p WHERE k % 10 = 0) AS unresolved")
def a06(spark, d):
    w = shop(spark, d)
    return spark.createDataFrame([(w.graph["nodes"].count(), w.graph["unresolved"].count())], "nodes bigint, unresolved bigint")


@query("q01_symbols", f"WITH {P} SELECT f AS path, fn AS name, 'function' AS kind FROM p WHERE b = '7' UNION ALL SELECT f, v, CASE v WHEN 'x' THEN 'parameter' ELSE 'variable' END FROM p, (VALUES ('x'), ('y')) AS t(v) WHERE b = '7' UNION ALL SELECT DISTINCT 'parts/b7/util.py', v, k2 FROM p, (VALUES ('shared', 'function'), ('x', 'parameter')) AS t(v, k2) WHERE b = '7'")
def q01(spark, d):
    return shop(spark, d).symbols(roots=["parts/b7"]).select("path", "name", "kind")


@query("q05_references", f"WITH {P}, {E}, {T}, r AS (SELECT sf AS path, c FROM e WHERE dfn = 'make_8' UNION ALL SELECT 'tests/test_b' || b || '.py', 1 FROM s WHERE fn = 'make_8') SELECT path, 'call' AS kind FROM r UNION ALL SELECT path, 'identifier' FROM r WHERE c = 1")
def q05(spark, d):
    return shop(spark, d).references("make_8").select("path", "kind")


@query("m02_rewritable_spans", f"WITH {P}, {E}, {T}, r AS (SELECT sf AS path, c FROM e WHERE dfn = 'make_8' UNION ALL SELECT 'tests/test_b' || b || '.py', 1 FROM s WHERE fn = 'make_8') SELECT path, replacement FROM (SELECT f AS path FROM p WHERE fn = 'make_8' UNION ALL SELECT path FROM r UNION ALL SELECT path FROM r WHERE c = 1), (VALUES ('make_eight')) AS v(replacement)")
def m02(spark, d):
    return shop(spark, d).rename("make_8", "make_eight")[0].select("path", "replacement")


@query("m16_diffs", f"""
WITH {P}, {E}, {T}, r AS (SELECT sf AS path, c FROM e WHERE dfn = 'make_8' UNION ALL SELECT 'tests/test_b' || b || '.py', 1 FROM s WHERE fn = 'make_8')
SELECT path, CAST(count(*) AS INTEGER) AS added, CAST(NULL AS VARCHAR) AS refused FROM (SELECT f AS path FROM p WHERE fn = 'make_8' UNION ALL SELECT path FROM r UNION ALL SELECT path FROM r WHERE c = 1) GROUP BY path""")
def m16(spark, d):
    """Edits applied and checked, with the lines that each file's diff adds."""
    w = shop(spark, d)
    done = w.apply(w.rename("make_8", "make_eight")[0])
    return done.select("path", F.regexp_count("diff", F.lit(r"(?m)^\+(?!\+\+)")).alias("added"), "refused")
