import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as S
from codeloom.functions.ordered import with_next
from codeloom.operators import graphs as G
from codeloom.operators import ranking as W
from codeloom.operators import resolving as R
from codeloom.operators.api import chart_inputs, split_unescaped
from codeloom.operators.recipes import RecipeError, glob_match, parse
from codeloom.operators.reports import helm_values


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src int, dst int")


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n] |= {b}
    out = {}
    for n in nodes:
        group = {m for m in reach[n] if n in reach[m]}
        if len(group) > 1:
            out[n] = min(group)
    return out


def test_strong_components(spark):
    rng = random.Random(4)
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)] + [(rng.randint(20, 34), rng.randint(20, 34)) for _ in range(22)]
    got = {r.node: r.component for r in G.strong_components(edges_of(spark, pairs)).collect()}
    want = brute_components(pairs)
    assert set(got) == set(want)
    for a, b in itertools.combinations(want, 2):
        assert (got[a] == got[b]) == (want[a] == want[b])


def test_dead_cycles_need_no_outside_holder(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (None, 3), (5, 6), (6, 5)], "src int, dst int")
    reached = spark.createDataFrame([(5,)], "node int")
    assert sorted(r.node for r in G.dead_cycles(e, reached).collect()) == [1, 2]


def test_trace_reports_cycles_and_bounds(spark):
    e = edges_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)])
    t = G.trace(e, spark.createDataFrame([(1,)], "node int"), 2)
    assert {(r.node, r.depth, r.unexplored) for r in t.collect()} == {(1, 0, False), (2, 1, False), (3, 2, True)}
    assert [tuple(r) for r in G.cycle_edges(e, t).collect()] == [(3, 1)]


def test_taint_takes_the_best_route(spark):
    e = spark.createDataFrame([(2, 1, 3), (3, 2, 0), (3, 4, 0), (4, 1, 0), (5, 3, 1)], "src int, dst int, confidence int")
    out = {r.node: (r.tier, r.depth) for r in G.taint(e, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert out == {2: (3, 1), 4: (0, 1), 3: (0, 2), 5: (1, 3)}


def test_reach_and_closure_end_on_cycles(spark):
    e = edges_of(spark, [(1, 2), (2, 1), (2, 3)])
    assert sorted(r.node for r in G.reach(e, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]
    assert sorted(tuple(r) for r in G.closure(e).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_ambiguity_stops_the_cascade(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = R.answers(spark.createDataFrame([("a", 1), ("a", 2)], "k string, t int"), "k", "t", 1, R.EXACT, R.FIELD)
    two = R.answers(spark.createDataFrame([("a", 9), ("b", 7)], "k string, t int"), "k", "t", 2, R.IMPORTED)
    assert sorted(map(tuple, R.first_answer(keys, "k", "t", [one, two]).collect()), key=str) == [("a", None, 2, 1), ("b", 7, 1, 2), ("c", None, 3, 99)]


def test_nearest_preceding_has_no_future(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 3)], "k string, at int")
    right = spark.createDataFrame([("u", 1, 10), ("u", 4, 11), ("u", 9, 12)], "k string, at int, x int")
    out = {(r.k, r["at"]): r.prev_x for r in R.nearest_preceding(left, right, ["k"], "at", "at", ["x"], "x").collect()}
    assert out == {("u", 5): 11, ("u", 1): 10, ("v", 3): None}


def test_with_next_crosses_ranges(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(50)], "i bigint, v bigint")
    assert {r.i: r.next_v for r in with_next(rows, "i", "v", 7).collect()} == {i: (i + 1) * 2 if i < 49 else None for i in range(50)}


def test_competition_keeps_losers(spark):
    rows = [("image.tag", "chart/values.yaml", "chart", 0, "a"), ("image.tag", "prod.yaml", "file", 0, "b"), ("image.tag", "--set", "set", 1, "c"), ("image.tag", "other.yaml", "unpassed", 0, "d"), ("x", "other.yaml", "unpassed", 0, "e")]
    out = helm_values(spark.createDataFrame(rows, "key string, path string, source string, position int, value string")).collect()
    assert len(out) == 5 and [r.value for r in out if r.wins] == ["c"]


def test_css_cascade_is_undecided_across_files(spark):
    schema = "subject string, path string, start int, important boolean, layer int, specificity struct<ids:int,classes:int,elements:int>"
    rows = [("s", "a.css", 1, False, 9, (0, 1, 0)), ("s", "b.css", 1, False, 9, (0, 1, 0)), ("t", "a.css", 1, True, 0, (0, 0, 1)), ("t", "a.css", 5, True, 1, (1, 0, 0)), ("u", "a.css", 1, False, 9, (0, 1, 0)), ("u", "a.css", 4, False, 9, (0, 1, 0))]
    out = [(r.subject, r.start, r.decided, r.wins) for r in W.css_cascade(spark.createDataFrame(rows, schema), "subject").collect()]
    assert all(not d for s, _, d, _ in out if s == "s") and not any(w for s, _, _, w in out if s == "s")
    assert [x[1] for x in out if x[0] == "t" and x[3]] == [1] and [x[1] for x in out if x[0] == "u" and x[3]] == [4]


@pytest.mark.parametrize("pattern,text,want", [("*a", "aba", False), ("*a", "ba", True), ("a*", "abc", True), ("*", "", True), ("a*c", "abc", True), ("abc", "abc", True), ("a*b*c", "axxbyyc", True), ("a*b", "a", False)])
def test_glob_takes_the_leftmost_match(pattern, text, want):
    assert glob_match(pattern, text) is want


def test_recipes_refuse_unknown_words():
    (step,) = parse("step one\n  select symbols\n  where kind=function !exported name~get*\n  limit 3\n  report")
    assert step.where[1] == (True, "exported", "flag", "") and step.limit == 3
    with pytest.raises(RecipeError, match="did you mean 'function'"):
        parse("step x\n where kind=functoin")
    with pytest.raises(RecipeError, match="unknown predicate"):
        parse("step x\n where colour=red")


def test_scalars(spark):
    df = spark.createDataFrame([("src/a/B.test.TS", "Größe & Maß (v2)", "a.b#frag")], "p string, h string, l string")
    out = df.select(S.file_name(F.col("p")), S.extension(F.col("p")), S.parent(F.col("p")), S.stem(F.col("p")), S.anchor_slug(F.col("h")), S.link_fragment(F.col("l")), S.under(F.col("p"), ["src/a"]), S.under(F.col("p"), ["src/"]), S.under(F.col("p"), ["sr"])).first()
    assert tuple(out) == ("B.test.TS", "ts", "src/a", "B.test", "größe--maß-v2", "frag", True, True, False)


def test_chart_inputs():
    assert split_unescaped(r"a=1,b={x,y},c=2\,3", ",") == ["a=1", "b={x,y}", r"c=2\,3"]
    assert [(x["source"], x["key"], x["value"]) for x in chart_inputs(["-f", "a.yaml", "--set", r"k=1,m=2\,3"])] == [("file", None, None), ("set", "k", "1"), ("set", "m", "2,3")]


def test_positions_and_names():
    from codeloom.functions import python_scalars as P

    text = "aé\nbc\n"
    assert [P.line_col(text, i) for i in (0, 1, 3, 4, 99)] == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    assert (P.offset_of(text, 2, 2), P.offset_of(text, 1, 99), P.offset_of(text, 9, 1)) == (5, 3, None)
    assert P.parse_range("a:1:2-3:4") == ("a", 1, 2, 3, 4)
    with pytest.raises(ValueError):
        P.parse_range("a:3:1-2:1")
    assert P.full_line_span("ab\ncd\nef", 4, 5) == (3, 6) and P.reindent("  a\n    b", "\t") == "\ta\n\t  b"
    assert P.relative_link("docs/a.md", "docs/b.md") == "./b.md" and P.relative_link("a/b/c.md", "x.md") == "../../x.md"
    assert (P.snake("HTTPServerName"), P.pascal("a_b-c"), P.suggest_name("order.getTotal(x)")) == ("http_server_name", "ABC", "total")


def _largest_share(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


@pytest.fixture
def shuffled(spark):
    """Joins as of large tables, whose rows are dealt by key."""
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_without_a_chart_are_not_dealt_to_one_task(spark, shuffled):
    from codeloom.sources import workspace

    files = spark.range(400).selectExpr("concat('a/m', id, '.py') as path", "'x = 1' as text").repartition(4)
    files = files.union(spark.createDataFrame([("c/Chart.yaml", ""), ("c/templates/a.yaml", ""), ("d/templates/a.yaml", "")], "path string, text string"))
    out = workspace.with_languages(files)
    assert _largest_share(out) < 0.5
    assert {r["path"]: r["language"] for r in out.where("language <> 'python'").collect()} == {"c/Chart.yaml": "yaml", "c/templates/a.yaml": "helm", "d/templates/a.yaml": "yaml"}


def test_rows_without_a_key_are_not_dealt_to_one_task(spark, shuffled):
    rows = spark.range(400).selectExpr("cast(id as string) as ref_id", "if(id < 5, cast(id as string), null) as k")
    out = R.with_key(rows, "k", spark.createDataFrame([("1", 10), ("7", 70)], "k string, v int"), "ref_id")
    assert _largest_share(out) < 0.5 and out.count() == 400
    assert [(r["k"], r["v"]) for r in out.where("v is not null").collect()] == [("1", 10)]


def test_closure_of_graphs_with_cycles_equals_all_walks(spark):
    rng = random.Random(3)
    for n, m in ((14, 14), (6, 0)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(20 + i, 21 + i) for i in range(9)} | {(40, 40)}
        want = set(pairs)
        while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
            want |= more
        got = [(r["src"], r["dst"]) for r in G.closure(edges_of(spark, pairs)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_closure_of_a_large_cycle_is_not_walked_pair_by_pair(spark):
    """Paths that double on a cycle of 300 join all pairs with all pairs: 300 times the result."""
    ring = [(i, j) for i in range(300) for j in ((i + 1) % 300, (i * 37 + 11) % 300)]
    joined = []
    cut = G.cut
    G.cut = lambda df: joined.append(out := cut(df)) or out
    try:
        assert G.closure(edges_of(spark, ring)).count() == 300 * 300
    finally:
        G.cut = cut
    assert max(df.count() for df in joined) <= 300 * 2


def test_closure_through_large_components_equals_all_walks(spark):
    rng = random.Random(7)
    rings = {(b + i, b + (i + 1) % 4) for b in (0, 10, 20, 30) for i in range(4)} | {(3, 10), (1, 20), (22, 30), (12, 31), (40, 41), (41, 40)}
    pairs = rings | {(rng.randrange(50, 70), rng.choice([0, 11, 40, 51, 60])) for _ in range(12)} | {(rng.choice([2, 33, 41, 52, 61]), rng.randrange(70, 80)) for _ in range(12)} | {(52, 53), (53, 71), (90, 90)}
    want = set(pairs)
    while more := {(a, d) for a, b in want for c, d in pairs if b == c} - want:
        want |= more
    for hub in (2, 4):
        got = [(r["src"], r["dst"]) for r in G.closure(edges_of(spark, pairs), hub=hub).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_paths_through_a_large_component_are_not_written_before_the_result(spark):
    """300 nodes lead into a cycle of 1,000 and it leads to 300: their 90,000 pairs were written and shuffled."""
    pairs = [(i, (i + 1) % 1000) for i in range(1000)] + [(i, j) for i in range(1000) for j in ((i * 37 + 11) % 1000, (i * 91 + 5) % 1000)]
    pairs += [(2000 + i, i) for i in range(300)] + [(i, 3000 + i) for i in range(300)]
    joined = []
    cut = G.cut
    G.cut = lambda df: joined.append(out := cut(df)) or out
    try:
        assert G.closure(edges_of(spark, pairs)).count() == 1300 * 1300
    finally:
        G.cut = cut
    assert max(df.count() for df in joined) <= 2 * len(pairs)


def test_equal_spans_are_ordered_by_their_ties(spark):
    rows = [("a", 1, 5, i) for i in (3, 1, 2)] + [("b", 1, 5, None), ("b", 1, 5, 4)]
    for again in itertools.permutations(rows[:3]):
        out = W.overlapping(spark.createDataFrame([*again, *rows[3:]], "k string, s int, e int, id int").coalesce(1), ["k"], "s", "e", ["id"])
        assert sorted((r["k"], r["id"] or 0) for r in out.collect()) == [("a", 2), ("a", 3), ("b", 0)]


def test_answers_by_a_shared_value_equal_those_of_pairs_and_make_none(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "a"), (6, "b"), (7, "b"), (7, None), (8, "d"), (8, "a")], "ref int, k string")
    candidates = spark.createDataFrame([("a", 10), ("a", 11), ("b", 20), ("b", 20), ("d", 10), (None, 1)], "k string, target int")
    for first in (False, True):
        got = R.answers_by(keys, "ref", "k", candidates, "target", 1, R.EXACT, R.FIELD, first)
        want = R.answers(keys.join(candidates, "k"), "ref", "target", 1, R.EXACT, R.FIELD, first)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_candidates_that_many_keys_share_are_not_paired_with_them(spark):
    """2,000 keys and 2,000 candidates of one value: one answer, not 4,000,000 pairs."""
    keys, candidates = spark.range(2000).selectExpr("id as ref", "0 as k"), spark.range(2000).selectExpr("0 as k", "id as target")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plain = R.answers
    R.answers = lambda rows, *a, **b: plain(rows.mapInArrow(counted, rows.schema), *a, **b)
    try:
        assert R.answers_by(keys, "ref", "k", candidates, "target", 1, R.EXACT).count() == 2000
    finally:
        R.answers = plain
    assert seen.value <= 4000


def test_the_nearest_of_a_group_is_found_without_pairs(spark):
    rng = random.Random(2)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3, *range(10, 30)]), rng.choice(odd + [round(rng.uniform(-2, 2), 1) for _ in range(20)])) for _ in range(150)]

    def order(a, b):  # as SQL orders distances: NaN after numbers, null last
        d = None if a is None or b is None else abs(a - b)
        return (2, 0.0) if d is None else (1, 0.0) if d != d else (0, d)

    want = {}
    for key, on, x in rows:
        other = [(order(x, y), k) for k, o, y in rows if None not in (key, on, k) and o == on and k != key]
        if other:
            want[key] = min([min(other), *([want[key]] if key in want else [])])
    got = R.nearest_within(spark.createDataFrame(rows, "k int, g int, x double"), "g", "k", "x", "target").collect()
    assert sorted(map(tuple, got)) == sorted((k, v[1]) for k, v in want.items())


def test_suppliers_of_a_nation_are_not_paired(spark, tmp_path):
    """4,000 suppliers of one nation: 16,000,000 pairs before."""
    from codeloom.plans import catalog

    n = 4000
    spark.range(n).selectExpr("id as s_suppkey", "1 as s_nationkey", "cast(id * 7919 % 4001 as double) as s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    df = catalog.QUERIES["j26_nearest_candidate"](spark, str(tmp_path))
    assert df.count() == n
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"NOT \((ref|s_suppkey)#\d+L? = (target|s_suppkey)#", plan)
