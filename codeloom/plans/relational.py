"""The engine's relational operators on the driver's tables: the same plans that serve code facts, over other keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs as G
from ..operators import ranking as W
from ..operators import resolving as R
from .registry import query, t

# -- F: filters and predicates ------------------------------------------------------------------------------------------


@query("f03_path_prefix", r"""
SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1), '/$', '') AS path FROM pages)
WHERE path = 'en' OR starts_with(path, 'en/') OR path = 'de' OR starts_with(path, 'de/')""")
def f03(spark, d):
    path = F.regexp_replace(F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1), "/$", "")
    return t(spark, d, "pages").select("page_id", path.alias("path")).where(S.under(F.col("path"), ["en", "de"]))


@query("f23_whole_word_mentions", r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')) > 0, false) AS hit FROM documents")
def f23(spark, d):
    return t(spark, d, "documents").select("doc_id", F.coalesce(S.whole_word(F.col("text"), "the"), F.lit(False)).alias("hit"))


# -- J: joins ------------------------------------------------------------------------------------------------------------


_CASCADE = """
WITH refs AS (SELECT c_custkey AS ref, c_nationkey AS k, c_mktsegment AS seg FROM customer),
r1 AS (SELECT ref, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN min(s_suppkey) END AS target, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN 0 ELSE 2 END AS confidence, 1 AS rule
       FROM refs JOIN supplier ON s_nationkey = k AND s_acctbal > 8000 GROUP BY ref),
r2 AS (SELECT ref, min(s_suppkey) AS target, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN 1 ELSE 2 END AS confidence, 2 AS rule
       FROM refs JOIN supplier ON s_nationkey = k AND s_acctbal > 4000 GROUP BY ref),
u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2),
w AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY rule) AS n FROM u)
SELECT refs.ref, refs.k, refs.seg, w.target, CAST(coalesce(w.confidence, 3) AS INTEGER) AS confidence, CAST(coalesce(w.rule, 99) AS INTEGER) AS rule
FROM refs LEFT JOIN w ON w.ref = refs.ref AND w.n = 1"""


def _cascade(spark, d):
    refs = t(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    supplier = t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("target"), "s_acctbal")
    one = R.answers_by(refs, "ref", "k", supplier.where("s_acctbal > 8000"), "target", 1, R.EXACT, R.FIELD)
    two = R.answers_by(refs, "ref", "k", supplier.where("s_acctbal > 4000"), "target", 2, R.IMPORTED, R.FIELD, keep_first=True)
    return R.first_answer(refs, "ref", "target", [one, two])


query("j02_prioritized_cascade", _CASCADE)(_cascade)


@query("j03_confidence_cap", f"SELECT ref, CASE WHEN seg = 'BUILDING' THEN greatest(confidence, 2) ELSE confidence END AS confidence FROM ({_CASCADE})")
def j03(spark, d):
    return R.cap(_cascade(spark, d), F.col("seg") == "BUILDING").select("ref", "confidence")



@query("j04_innermost_interval", """
WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS s, epoch_us(o_orderdate) // 1000000 + 86400 * (30 + 200 * (o_orderkey % 3)) AS e FROM orders),
m AS (SELECT i.o_orderkey AS point, i.o_custkey, o.o_orderkey AS holder, row_number() OVER (PARTITION BY i.o_orderkey ORDER BY o.o_orderkey IS NULL, o.e - o.s, o.o_orderkey) AS n FROM o i LEFT JOIN o ON o.o_custkey = i.o_custkey AND o.s < i.s AND i.s < o.e)
SELECT point, o_custkey, holder FROM m WHERE n = 1""")
def j04(spark, d):
    begun = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")
    spans = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("holder"), begun.alias("s")).withColumn("e", F.col("s") + 86400 * (30 + 200 * (F.col("holder") % 3)))
    points = spans.select("o_custkey", F.col("holder").alias("point"), F.col("s").alias("p"))
    return R.innermost(points, spans, ["o_custkey"], "point", "s", "e", "holder", "p", strict=True).select("point", "o_custkey", "holder")


@query("j10_longest_suffix_folder", """
WITH f(folder) AS (VALUES ('src/a/util'), ('lib/util'), ('src/b/net/http'), ('x/http')), w(path) AS (VALUES ('m/a/util'), ('q/util'), ('z/net/http'), ('none')),
s AS (SELECT path, k, array_to_string(list_slice(string_split(path, '/'), len(string_split(path, '/')) - k + 1, len(string_split(path, '/'))), '/') AS suffix FROM w, range(1, 5) AS r(k) WHERE k <= len(string_split(path, '/'))),
h AS (SELECT path, k, min(folder) AS folder, count(DISTINCT folder) AS n FROM s JOIN f ON folder = suffix OR ends_with(folder, '/' || suffix) GROUP BY path, k),
b AS (SELECT path, CASE WHEN n = 1 THEN folder END AS folder FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY k DESC) = 1)
SELECT w.path, b.folder FROM w LEFT JOIN b USING (path)""")
def j10(spark, d):
    wanted = spark.createDataFrame([("m/a/util",), ("q/util",), ("z/net/http",), ("none",)], "path string")
    folders = spark.createDataFrame([("src/a/util",), ("lib/util",), ("src/b/net/http",), ("x/http",)], "folder string")
    return R.longest_suffix_folder(wanted, "path", folders, "folder")


@query("j22_division", """
WITH have AS (SELECT DISTINCT o_custkey AS owner, o_orderstatus AS status, o_orderstatus || ' ' || o_orderpriority AS item FROM orders), need AS (SELECT DISTINCT status, item FROM have)
SELECT owner, status FROM have GROUP BY owner, status HAVING count(*) = (SELECT count(*) FROM need n WHERE n.status = have.status)""")
def j22(spark, d):
    """Customers with orders of every priority that a status has."""
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("item"))
    return R.divide(rows.select("owner", "item"), rows.select("status", "item"), "owner", "item", "status")


@query("j23_left_join_orphans", """
SELECT c_custkey, list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus IS NOT NULL))::VARCHAR AS statuses, count(o_orderkey) = 0 AS orphan
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""".replace("list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus IS NOT NULL))::VARCHAR", "coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '')"))
def j23(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return R.with_orphans(c, o, "c_custkey", "o_orderstatus", "all").select("c_custkey", F.array_join("all", ",").alias("statuses"), "orphan")


@query("j24_nearest_ancestor_folder", """
WITH f(folder, v) AS (VALUES ('', 'root'), ('a/b', 'deep'), ('a', 'mid')), p(path) AS (VALUES ('a/b/c/x.yaml'), ('a/q/x.yaml'), ('z/x.yaml'), ('a/bb/x.yaml')),
m AS (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY length(folder) DESC) AS n FROM p JOIN f ON folder = '' OR starts_with(path, folder || '/'))
SELECT path, v FROM m WHERE n = 1""")
def j24(spark, d):
    paths = spark.createDataFrame([("a/b/c/x.yaml",), ("a/q/x.yaml",), ("z/x.yaml",), ("a/bb/x.yaml",)], "path string")
    folders = spark.createDataFrame([("", "root"), ("a/b", "deep"), ("a", "mid")], "folder string, v string")
    return R.nearest_folder(paths, "path", folders, "folder", "v")


@query("j25_nearest_preceding", """
WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT p.event_id, prev_event_id, prev_value FROM p LEFT JOIN LATERAL (SELECT v.event_id AS prev_event_id, v.value AS prev_value FROM v WHERE v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) ON true""")
def j25(spark, d):
    e = t(spark, d, "events")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return R.nearest_preceding(left, right, ["user_id"], "ts", "ts", ["event_id", "value"], "event_id").select("event_id", "prev_event_id", "prev_value")


@query("j26_nearest_candidate", """
SELECT a.s_suppkey AS ref, arg_min(b.s_suppkey, (abs(a.s_acctbal - b.s_acctbal), b.s_suppkey)) AS target FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_suppkey""")
def j26(spark, d):
    return R.nearest_within(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", "s_acctbal", "target").withColumnRenamed("s_suppkey", "ref")


# -- E, A: grouping and aggregation --------------------------------------------------------------------------------------


_LINES = "SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(line) >= 40"


def _lines(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.where(F.length("line") >= 40).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "line")


@query("a09_clone_classes", f"SELECT md5(line) AS hash, count(*) AS instances, length(any_value(line)) * (count(*) - 1) AS redundant FROM ({_LINES}) GROUP BY line HAVING count(*) > 1")
def a09(spark, d):
    """A8 and A9; the hash alone is shuffled, not the lines."""
    lines = _lines(spark, d).select(F.md5(F.col("line").cast("binary")).alias("hash"), F.length("line").cast("bigint").alias("tokens"))
    return lines.groupBy("hash").agg(F.count("*").alias("instances"), F.max("tokens").alias("tokens")).where("instances > 1").select("hash", "instances", (F.col("tokens") * (F.col("instances") - 1)).alias("redundant"))


@query("a13_uniqueness", "SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN 'hit' ELSE 'ambiguous' END AS answer FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey")
def a13(spark, d):
    out = R.answers(t(spark, d, "customer").where("c_acctbal > 9000"), "c_nationkey", "c_mktsegment", 1, R.EXACT)
    return out.select("c_nationkey", F.when(F.col("confidence") == 0, "hit").otherwise("ambiguous").alias("answer"))


# -- W: ranking ----------------------------------------------------------------------------------------------------------


@query("w02_first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def w02(spark, d):
    return W.first_per(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("w04_competition", "SELECT l_partkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS INTEGER) AS place, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1 AS wins FROM lineitem")
def w04(spark, d):
    rows = t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return W.competition(rows, "l_partkey", [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_shipdate")


@query("w07_next_sibling", "SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) AS next_us FROM (SELECT DISTINCT ON (user_id, event_type, ts) * FROM events ORDER BY user_id, event_type, ts, event_id)")
def w07(spark, d):
    e = W.first_per(t(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type", "ts"], ["event_id"])
    return W.next_sibling(e, ["user_id", "event_type"], "ts").select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', next_at)").alias("next_us"))


@query("w08_overlapping_spans", """
SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, max(o_orderdate + INTERVAL 40 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM orders) WHERE o_orderdate < e""")
def w08(spark, d):
    spans = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("from"), F.expr("o_orderdate + interval 40 day").alias("until"))
    return W.overlapping(spans, ["o_custkey"], "from", "until", ["o_orderkey"]).select("o_orderkey")


@query("w09_contiguous_runs", """
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey // 20 AS line FROM lineitem), b AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY l_orderkey ORDER BY line) IS NULL OR line - lag(line) OVER (PARTITION BY l_orderkey ORDER BY line) > 5 THEN 1 ELSE 0 END AS brk FROM l)
SELECT l_orderkey, line, CAST(sum(brk) OVER (PARTITION BY l_orderkey ORDER BY line) AS BIGINT) AS run FROM b""")
def w09(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.expr("l_partkey div 20").alias("line")).distinct()
    return W.runs(rows, ["l_orderkey"], "line", F.col("line") - F.col("previous") > 5)


# -- L, U: sorts, limits, sets -------------------------------------------------------------------------------------------


@query("l07_capped_lists", "SELECT o_custkey, count(*) AS total, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 4), ',') AS first_four FROM orders GROUP BY o_custkey")
def l07(spark, d):
    out = W.capped(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4, "o_orderkey")
    return out.select("o_custkey", "total", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first_four"))


# -- G: graphs -----------------------------------------------------------------------------------------------------------

_EDGES = "(SELECT DISTINCT user_id AS src, nxt AS dst, tier AS confidence FROM (SELECT user_id, lead(user_id) OVER (ORDER BY event_id) AS nxt, event_id % 4 AS tier FROM (SELECT * FROM events WHERE event_type = 'purchase')) WHERE nxt IS NOT NULL AND nxt <> user_id)"


def _edges(spark, d):
    """Each purchase points to the buyer of the purchase after it: a directed graph with cycles. The order is total by event_id, dealt by ranges of it."""
    e = t(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id")
    # lead() over the whole table without one partition for all: numbers within ranges of ids, shifted by the counts before.
    from ..functions.ordered import with_next

    nxt = with_next(e, "event_id", "user_id")
    return nxt.where("next_user_id is not null and next_user_id <> user_id").select(F.col("user_id").alias("src"), F.col("next_user_id").alias("dst"), (F.col("event_id") % 4).cast("int").alias("confidence")).distinct()


@query("g01_edges", f"SELECT src, dst, CAST(confidence AS INTEGER) AS confidence FROM {_EDGES}")
def g01(spark, d):
    return _edges(spark, d)


@query("g03_neighbours", f"SELECT src, dst, CAST(min(confidence) AS INTEGER) AS confidence FROM {_EDGES} GROUP BY src, dst")
def g03(spark, d):
    return G.first_neighbours(_edges(spark, d), "confidence")


@query("g04_bounded_walk", f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), s AS (SELECT min(src) AS node FROM e),
w AS (SELECT node, 0 AS depth FROM s UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def g04(spark, d):
    e = _edges(spark, d)
    return G.trace(e, e.agg(F.min("src").alias("node")), 3).select("node", "depth")


@query("g05_neighbourhood", f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES}), s AS (SELECT min(src) AS node FROM e),
w AS (SELECT node, 0 AS depth FROM s UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 2),
b AS (SELECT node, 0 AS depth FROM s UNION SELECT src, depth + 1 FROM b JOIN e ON dst = node WHERE depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS rank FROM w GROUP BY node UNION ALL SELECT node, CAST(-min(depth) AS INTEGER) FROM b GROUP BY node HAVING min(depth) > 0""")
def g05(spark, d):
    e = _edges(spark, d)
    return G.neighbourhood(e, e.agg(F.min("src").alias("node")), 2).select("node", "rank")


@query("g06_taint", f"""
WITH RECURSIVE e AS (SELECT src, dst, min(confidence) AS c FROM {_EDGES} GROUP BY src, dst), s AS (SELECT min(dst) AS node FROM e),
w AS (SELECT node, -1 AS tier, 0 AS depth FROM s UNION SELECT src, greatest(tier, c), depth + 1 FROM w JOIN e ON dst = node WHERE depth < 3)
SELECT node, CAST(min(tier) AS INTEGER) AS tier FROM w WHERE depth > 0 AND node NOT IN (SELECT node FROM s) GROUP BY node""")
def g06(spark, d):
    e = _edges(spark, d)
    return G.taint(e, e.agg(F.min("dst").alias("node")), 3).select("node", "tier")


_REACHED = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE confidence = 0), s AS (SELECT min(src) AS node FROM e),
w AS (SELECT node FROM s UNION SELECT dst FROM w JOIN e ON src = node)"""


@query("g07_reachability", f"{_REACHED} SELECT DISTINCT node FROM w")
def g07(spark, d):
    e = _edges(spark, d).where("confidence = 0")
    return G.reach(e, e.agg(F.min("src").alias("node")))


@query("g08_roots", f"SELECT DISTINCT src AS node FROM {_EDGES} WHERE confidence = 0 AND src NOT IN (SELECT dst FROM {_EDGES} WHERE confidence = 0)")
def g08(spark, d):
    e = _edges(spark, d).where("confidence = 0")
    return G.roots(e.select(F.col("src").alias("node")).distinct(), e)


@query("g10_components", f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE confidence <= 1), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src)
SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def g10(spark, d):
    return G.strong_components(_edges(spark, d).where("confidence <= 1"))


@query("g12_closure", f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE confidence = 0), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON w.dst = e.src) SELECT src, dst FROM w""")
def g12(spark, d):
    return G.closure(_edges(spark, d).where("confidence = 0"))


@query("g15_dot_export", f"""SELECT '  "' || src || '" -> "' || dst || '"' || CASE WHEN confidence > 1 THEN ' [style=dashed]' ELSE '' END || ';' AS line FROM {_EDGES}""")
def g15(spark, d):
    return G.dot(_edges(spark, d))


@query("g16_json_export", f"""SELECT '{{"confidence":' || confidence || ',"dst":' || dst || ',"src":' || src || '}}' AS json FROM {_EDGES}""")
def g16(spark, d):
    return G.as_json(_edges(spark, d))


@query("g17_unreachable", f"{_REACHED} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT node FROM w)")
def g17(spark, d):
    e = _edges(spark, d).where("confidence = 0")
    return e.select(F.col("src").alias("node")).distinct().join(G.reach(e, e.agg(F.min("src").alias("node"))), "node", "left_anti")


# -- N, P, H, R, X: scalars and extraction that SQL can say --------------------------------------------------------------


@query("n01_qualified_name", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '::' || p_name ELSE p_name END AS name FROM part")
def n01(spark, d):
    return t(spark, d, "part").select("p_partkey", S.qualified_name(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_name")).alias("name"))


@query("n02_anchor_slug", r"SELECT p_partkey, lower(replace(regexp_replace(trim(p_name || ' (' || p_type || ')!'), '[^A-Za-z0-9 _-]', '', 'g'), ' ', '-')) AS slug FROM part")
def n02(spark, d):
    return t(spark, d, "part").select("p_partkey", S.anchor_slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")!"))).alias("slug"))


@query("n03_loose_spelling", "SELECT o_orderkey, lower(replace(replace(o_orderpriority, '-', ''), '_', '')) AS loose FROM orders")
def n03(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.loose(F.col("o_orderpriority")).alias("loose"))


@query("n04_bean_property", "SELECT * FROM (VALUES ('getUserName', 'userName'), ('isOpen', 'open'), ('get', NULL), ('gettysburg', NULL), ('setX', 'x')) AS v(method, property)")
def n04(spark, d):
    names = spark.createDataFrame([("getUserName",), ("isOpen",), ("get",), ("gettysburg",), ("setX",)], "method string")
    return names.select("method", S.bean_property(F.col("method")).alias("property"))


@query("n05_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def n05(spark, d):
    n = t(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").select("a", "b", S.edit_distance(F.col("a"), F.col("b")).alias("distance"))


@query("n09_path_parts", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^:]*://([^?#]*)', 1) AS path FROM pages)
SELECT page_id, string_split(path, '/')[-1] AS file_name, lower(regexp_extract(string_split(path, '/')[-1], '\.([^.]+)$', 1)) AS extension, regexp_replace(path, '/?[^/]*$', '') AS parent FROM p""")
def n09(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    return t(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", S.file_name(F.col("path")).alias("file_name"), S.extension(F.col("path")).alias("extension"), S.parent(F.col("path")).alias("parent"))


@query("n11_route_for_path", "SELECT * FROM (VALUES ('app/pets/[id]/route.ts', '/pets/{id}'), ('src/app/(shop)/cart/page.tsx', '/cart'), ('app/route.ts', '/'), ('app/[[...all]]/page.tsx', '/{all}')) AS v(path, route)")
def n11(spark, d):
    paths = spark.createDataFrame([("app/pets/[id]/route.ts",), ("src/app/(shop)/cart/page.tsx",), ("app/route.ts",), ("app/[[...all]]/page.tsx",)], "path string")
    return paths.select("path", S.route_for(F.col("path")).alias("route"))


@query("p01_span_math", "SELECT l_orderkey, l_linenumber, l_linenumber <= 3 AND 3 < l_linenumber + 2 AS holds, l_linenumber < 5 AND 3 < l_linenumber + 2 AS overlap FROM lineitem")
def p01(spark, d):
    s, e = F.col("l_linenumber"), F.col("l_linenumber") + 2
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.contains_offset(s, e, F.lit(3)).alias("holds"), S.overlaps(s, e, F.lit(3), F.lit(5)).alias("overlap"))


@query("h02_cache_key", "SELECT doc_id, sha256(lang || chr(0) || text) AS key FROM documents")
def h02(spark, d):
    return t(spark, d, "documents").select("doc_id", S.cache_key(F.col("lang"), F.col("text")).alias("key"))


@query("r01_explode", "SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents WHERE length(text) > 0")
def r01(spark, d):
    """Distinct space-separated values."""
    return t(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))


@query("x05_html_facts", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '\sclass=')) AS BIGINT) AS classes FROM pages")
def x05(spark, d):
    h = F.col("html")
    return t(spark, d, "pages").select("page_id", F.regexp_count(h, F.lit(r"<a\s[^>]*href=")).cast("bigint").alias("links"), F.regexp_count(h, F.lit(r"\sclass=")).cast("bigint").alias("classes"))


@query("x12_duplicate_definitions", "SELECT p_brand, p_size, arg_min(p_type, (length(p_type), p_type)) AS kind, max(p_retailprice) AS widest, bool_or(p_name LIKE '%a%') AS exported FROM part GROUP BY p_brand, p_size")
def x12(spark, d):
    return t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.min(F.struct(F.length("p_type").alias("l"), "p_type"))["p_type"].alias("kind"), F.max("p_retailprice").alias("widest"), F.bool_or(F.col("p_name").like("%a%")).alias("exported"))


@query("x13_reference_dedup", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1""")
def x13(spark, d):
    names = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return W.first_per(t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(names, "l_orderkey", "left_anti"), ["l_orderkey", "l_partkey"], ["l_linenumber"])