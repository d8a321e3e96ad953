import os

import pytest

from codeloom.functions.extractors import EXTRACTORS, extract
from codeloom.functions.extractors.configs import mask_actions
from codeloom.functions.extractors.markup import declarations, specificity
from codeloom.operators import api, edits, facts
from codeloom.operators.patterns import find
from codeloom.sources import catalogs, workspace
from codeloom.streaming import incremental
from codeloom.workspace import NotFound, Workspace


def names(language, path, text):
    row = extract(language, path, text)
    return {(s["name"], s["kind"], s["qualifier"]) for s in row["symbols"]}, row


@pytest.mark.parametrize(
    "language,path,text,want",
    [
        ("python", "a.py", "class A:\n    x = 1\n    def f(self, n):\n        y = n\n", {("A", "class", None), ("x", "field", "A"), ("f", "method", "A"), ("n", "parameter", None), ("y", "variable", None)}),
        ("go", "a.go", "package p\ntype T struct {\n  N int\n}\nfunc (t *T) Do(k int) int { return k }\n", {("T", "struct", None), ("N", "field", "T"), ("Do", "method", "T"), ("k", "parameter", None)}),
        ("rust", "a.rs", "pub struct P { pub x: i32 }\nimpl P { fn go(&self, n: i32) -> i32 { n } }\n", {("P", "struct", None), ("x", "field", "P"), ("go", "method", "P"), ("n", "parameter", None)}),
        ("java", "A.java", "public class A extends B {\n  private int n = 1;\n  public int got(int k) { return n; }\n}\n", {("A", "class", None), ("n", "field", "A"), ("got", "method", "A"), ("k", "parameter", None)}),
        ("typescript", "a.ts", "export class A {\n  x: number;\n  put(y: string): void { }\n}\nexport const f = (a: number) => { return a };\n", {("A", "class", None), ("x", "field", "A"), ("put", "method", "A"), ("y", "parameter", None), ("f", "function", None)}),
        ("zig", "a.zig", "pub const P = struct { x: i32, };\npub fn go(a: i32) i32 { return a; }\n", {("P", "struct", None), ("x", "field", "P"), ("go", "function", None), ("a", "parameter", None)}),
        ("html", "a.html", "<p id='x' data-k=1>", {("x", "element-id", None), ("data-k", "data-attribute", None)}),
        ("css", "a.css", ".a, #b { --c: 1; }", {("a", "selector", None), ("b", "selector", None), ("--c", "property", None)}),
        ("markdown", "a.md", "# Top ##\n\n[r]: x\n```\n# no\n```\n", {("Top", "heading", None), ("r", "link-def", None)}),
        ("yaml", "a.yaml", "a:\n  b: 1\n", {("a", "key", None), ("b", "key", "a")}),
        ("hcl", "a.tf", 'variable "v" {\n}\nlocals {\n  m = var.v\n}\n', {("v", "variable", "var"), ("m", "variable", "local")}),
        ("bash", "a.sh", "N=1\ngo() {\n echo $N\n}\n", {("N", "variable", None), ("go", "function", None)}),
    ],
)
def test_extractors_find(language, path, text, want):
    got, row = names(language, path, text)
    assert want <= got and row["errors"] == []


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
@pytest.mark.parametrize("text", ["", "\x00", "{{{", "}}}", '"', "def f(", "<a", "é" * 50, ": : :\n - x\n\t?", "a" * 2000])
def test_extractors_never_raise(language, text):
    row = extract(language, f"x.{language}", text)
    size = len(text.encode())
    assert all(0 <= s["name_start"] <= s["name_end"] <= size for s in row["symbols"])


def test_spans_are_bytes():
    text = "é = 1\nnäme = é\n"
    row = extract("python", "a.py", text)
    raw = text.encode()
    assert [raw[s["name_start"] : s["name_end"]].decode() for s in row["symbols"]] == ["é", "näme"]
    assert [raw[r["start"] : r["end"]].decode() for r in row["refs"]] == ["é"]


def test_css_and_template_helpers():
    assert specificity("#a .b:hover > li:not(.x, #y) ::before") == (2, 2, 2) and specificity(":where(#a) p") == (0, 0, 1)
    d = declarations("@layer t { .a { x: 1 !important } } @media (w) { .a { x: 2; } }")
    assert [(x["important"], x["layer"], x["conditions"]) for x in d] == [(True, 0, []), (False, 1_000_000, ["@media (w)"])]
    assert mask_actions("{{ if x }}\na: {{ y }}b") == "          \na: xxxxxxxb"


def test_patterns_bind_consistently():
    assert [f[2] for f in find("f(a, a); f(a, b); // f(c, c)", "go", "f($X, $X)")] == [{"$X": "a"}]
    assert [f[2] for f in find("g(h(1, 2), [3])", "go", "g($A, $B)")] == [{"$A": "h(1, 2)", "$B": "[3]"}]


def test_scan_reports_rejects(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    for name, text in {"pkg/__init__.py": "", "pkg/_x.py": "a = 1\n", "b.txt": "", "skip.py": "", "big.py": "x = 1\n" * 100, ".hidden.py": "", ".gitignore": "skip.py\n"}.items():
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "pkg/_x.py", tmp_path / "link.py")
    out = {r.path: r.status for r in workspace.scan(spark, str(tmp_path), maxBytes=300).collect()}
    assert out == {"pkg/__init__.py": "ok", "pkg/_x.py": "ok", "b.txt": "unsupported", "big.py": "too-large", "link.py": "symlink"}
    assert "skip.py" in {r.path for r in workspace.scan(spark, str(tmp_path), noIgnore=True).collect()}
    assert {r.path: r.status for r in workspace.scan(spark, str(tmp_path), maxBytes=300, folders=1).collect()} == out  # walked in tasks


@pytest.fixture(scope="module")
def shop(spark):
    from codeloom.plans.sample import FILES

    return Workspace.of(spark, FILES)


def test_names_resolve_across_files_and_languages(shop):
    got = {(r.path, r.name, r.start): (r.target_id, r.confidence) for r in shop.resolved.collect()}
    find_ = lambda path, name: {v for (p, n, _), v in got.items() if p == path and n == name}
    assert find_("app.py", "price") == {("shop/core.py:000000237", 1)}
    assert find_("run.sh", "help_me") == {("lib.sh:000000000", 1)}
    assert find_("web/page.html", "top") == {("web/page.html:000000009", 0)}
    assert {c for _, c in find_("web/page.html", "card")} == {0}
    assert find_("docs/guide.md", "big-guide") == {("docs/guide.md:000000002", 0)}
    assert find_("geo/shape.go", "scale") == {("geo/shape.go:000000166", 0)}
    assert {c for _, c in find_("geo/shape.go", "Side")} == {2}
    assert find_("infra/main.tf", "size") == {("infra/main.tf:000000010", 0)}


def test_unknown_names_suggest(shop):
    with pytest.raises(NotFound) as e:
        shop.references("clmap")
    assert "clamp" in e.value.near


def test_delete_refuses_while_referenced(shop):
    with pytest.raises(edits.Refusal) as e:
        shop.delete("clamp")
    assert e.value.kind == "still-referenced" and len(e.value.rows) == 2


def test_names_are_followed_through_eight_barrels(spark):
    files = {f"b{i}.py": f"from b{i + 1} import width_{i + 1} as width_{i}\n" for i in range(9)} | {"b9.py": "def width_9():\n    return 1\n"}
    files |= {f"use{i}.py": f"from b{i} import width_{i}\n\n\ndef run_{i}():\n    return width_{i}()\n" for i in (0, 1, 8)}
    files |= {"loop_a.py": "from loop_b import spin\n", "loop_b.py": "from loop_a import spin\n", "use_loop.py": "from loop_a import spin\n\nspin()\n"}
    calls = {r.path: (r.target_id, r.rule) for r in Workspace.of(spark, files).resolved.where("kind = 'call'").collect()}
    assert calls["use8.py"][0] is not None and calls["use1.py"] == calls["use8.py"] and calls["use1.py"][1] == 9
    assert calls["use0.py"][0] is None and calls["use_loop.py"][0] is None  # nine hops, and a circle


def test_recipe_deletes_every_selected_name(spark):
    w = Workspace.of(spark, {f"m{k}.py": "".join(f"def gone_{k}_{i}():\n    return {i}\n\n\n" for i in range(401)) for k in range(3)})
    (out,) = w.run("step old\n  select symbols\n  where kind=function name~gone_*\n  delete\n")
    assert out["edits"].select("path", "start").distinct().count() == out["edits"].count() == 1203


def test_edits_are_checked_and_gated(spark, shop):
    make = lambda *rows: spark.createDataFrame(list(rows), edits.EDIT)
    with pytest.raises(edits.Refusal):
        shop.apply(make(("shop/util.py", 0, 5, "x"), ("shop/util.py", 3, 8, "y")))
    with pytest.raises(edits.Refusal):
        shop.apply(make(("shop/util.py", 0, 10_000, "x")))
    out = shop.apply(make(("shop/util.py", 0, 5, "def ("))).collect()
    assert [(r.refused, r.diff) for r in out] == [("new-syntax-errors", "")]


def test_duplicates_ignore_names(spark):
    body = "def {f}({a}):\n    out = []\n    for x in {a}:\n        if x > 1:\n            out.append(x * 2 + len({a}))\n        else:\n            out.append(x - 1)\n    return sorted(out)\n"
    w = Workspace.of(spark, {"a.py": body.format(f="f", a="p"), "b.py": body.format(f="g", a="q"), "c.py": "x = 1\n"})
    out = w.duplicates(30).collect()
    assert [(r.instances, [p.path for p in r.places]) for r in out] == [(2, ["a.py", "b.py"])]


def test_go_types_implement_structurally(shop):
    from codeloom.operators.calls import subtypes

    assert ("Square", "Shape") in {tuple(r) for r in subtypes(shop.tables).collect()}


def test_routes_become_openapi(spark):
    w = Workspace.of(spark, {"api.py": "@app.get('/pets/{pet_id}')\ndef one(pet_id, q):\n    return 1\n", "app/pets/[id]/route.ts": "export function GET(r: Request) {\n  return 1;\n}\n"})
    assert [tuple(r) for r in api.openapi(api.fastapi_routes(w.tables)).collect()] == [("/pets/{pet_id}", '{"get":{"operationId":"one","parameters":[{"name":"pet_id","in":"path"},{"name":"q","in":"query"}]}}')]
    assert [(r.route, r.verb, r.params) for r in api.next_routes(w.tables).collect()] == [("/pets/{id}", "get", ["id"])]
    assert api.capabilities(spark).count() == len(api.CAPABILITIES) * 16


def test_catalog_refuses_unknown_fields(spark):
    assert catalogs.rules(spark).count() > 10
    with pytest.raises(ValueError):
        catalogs.parse("- {rule: x, kind: y, colour: red}")


def test_incremental_index_is_idempotent(spark, tmp_path):
    manifest, store = str(tmp_path / "m"), str(tmp_path / "s")
    rows = [("a.py", "python", "x = 1\n"), ("copy.py", "python", "x = 1\n"), ("b.css", "css", ".a { }")]
    spark.createDataFrame(rows, incremental.MANIFEST).write.parquet(manifest)
    incremental.start(spark, manifest, store, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{store}/facts").count() == 2 and incremental.stored(spark, store).count() == 3
    spark.createDataFrame(rows[:1] + [("c.md", "markdown", "# T\n")], incremental.MANIFEST).write.mode("append").parquet(manifest)
    incremental.start(spark, manifest, store, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{store}/facts").count() == 3
    assert facts.missing_from_cache(spark.createDataFrame(rows, incremental.MANIFEST), spark.read.parquet(f"{store}/facts")).count() == 0
    spark.createDataFrame([("d.md", "markdown", "# T\n")], incremental.MANIFEST).write.mode("append").parquet(manifest)
    incremental.start(spark, manifest, store, str(tmp_path / "c")).awaitTermination()
    assert {r.path for r in incremental.stored(spark, store).collect()} >= {"c.md", "d.md"}  # equal content, both paths


def test_mentions_take_any_word(shop):
    assert shop.mentions("it's \\E.* 'x'").count() == 0 and shop.mentions("total").count() == 1


def test_go_types_need_arity_and_signature(spark):
    from codeloom.operators.calls import go_implementations

    method = "func (t {0}) Area({1}) {2} {{\n\treturn nil\n}}\n"
    rows = {"Same": ("a int, b int", "error"), "Arity": ("a int", "error"), "Result": ("a, b int", "string"), "Grouped": ("a, b int", "(err error)"), "Qualified": ("a int, b int", "pkg.error"), "Unreadable": ("a int, b int", "func() error"), "Kind": ("a int, b string", "error")}
    types = "".join(f"type {n} struct {{\n\tx int\n}}\n" + method.format(n, *r) for n, r in rows.items())
    w = Workspace.of(spark, {"a.go": "package p\ntype Shape interface {\n\tArea(x, y int) error\n}\ntype Loose interface {\n\tArea(x int, y func(int) bool) error\n}\ntype Empty interface {\n}\n" + types})
    got = {tuple(r) for r in go_implementations(w.tables).collect()}
    assert {a for a, b in got if b == "Shape"} == {"Same", "Grouped", "Qualified", "Unreadable"}
    assert {a for a, b in got if b == "Loose"} == {"Same", "Grouped", "Qualified", "Unreadable", "Result", "Kind"} and not any(b == "Empty" for _, b in got)


def test_function_literals_of_go_declare_nothing(spark):
    w = Workspace.of(spark, {"a.go": "package p\n\nfunc run() {\n\tf := func(a int) error {\n\t\treturn nil\n\t}\n\tf(1)\n}\n\nfunc (s *Set[T]) Add(x T) {\n}\n"})
    assert {(r.name, r.kind, r.qualifier) for r in w.tables.symbols.where("kind in ('function', 'method')").collect()} == {("run", "function", None), ("Add", "method", "Set")}


def test_dispatch_is_factored_and_walks_agree_with_pairs(spark):
    from codeloom.operators.graphs import Factored, flipped, one_step, reach, taint, trace

    types = "".join(f"type T{i} struct {{\n\tn int\n}}\nfunc (t T{i}) Go() error {{\n\treturn stop{i}()\n}}\nfunc stop{i}() error {{\n\treturn nil\n}}\n" for i in range(12))
    calls = "".join(f"func call{i}(x Runner) error {{\n\treturn x.Go()\n}}\n" for i in range(15))
    java = "class A {\n  void go() { }\n}\nclass B extends A {\n  void go() { }\n}\nclass C {\n  void run(A a) { a.go(); }\n}\n"
    py = "class P:\n    def go(self):\n        return 1\n\n\nclass Q(P):\n    def go(self):\n        return 2\n\n\nclass R:\n    def go(self):\n        return 3\n\n\ndef use(x):\n    return x.go()\n"
    w = Workspace.of(spark, {"a.go": "package p\ntype Runner interface {\n\tGo() error\n}\n" + types + calls, "A.java": java, "p.py": py})
    g, short = w.graph, {r.symbol_id: r.qualified_name for r in w.tables.symbols.collect()}
    pairs = {(short[r.src], short[r.dst], r.basis) for r in g["edges"].where("origin = 'hierarchy'").collect()}
    assert {p for p in pairs if p[0].startswith("call")} == {(f"call{i}", d, "interface-method-set") for i in range(15) for d in ["Runner::Go", *[f"T{j}::Go" for j in range(12)]]}
    assert {p[1:] for p in pairs if p[0] == "use"} == {("P::go", "declared-supertype"), ("Q::go", "declared-supertype")}
    assert {p[1:] for p in pairs if p[0] == "C::run"} == {("A::go", "method-name"), ("B::go", "declared-supertype")}
    assert g["sites"].count() == 17 and g["sets"].count() == 13 + 2 + 2
    plain, f = g["edges"], w.walkable
    starts = g["nodes"].where("name in ('call3', 'use')").select("node")
    rows = lambda df: sorted(map(repr, df.collect()))
    for depth in (1, 2, 3):
        assert rows(trace(f, starts, depth)) == rows(trace(plain, starts, depth))
    ends = g["nodes"].where("name in ('stop4', 'go')").select("node")
    assert rows(trace(f.flipped(), ends, 2)) == rows(trace(flipped(plain), ends, 2))
    assert rows(reach(f, starts)) == rows(reach(plain, starts)) and rows(taint(f, ends, 3)) == rows(taint(plain, ends, 3))
    assert rows(one_step(f, starts)) == rows(one_step(plain, starts)) and isinstance(f.flipped(), Factored)
    tally = {(r.tier, r.origin): r.edges for r in __import__("codeloom.operators.reports", fromlist=["x"]).graph_summary(g).collect()}
    assert sum(tally.values()) == plain.count() and tally["field-based", "hierarchy"] == len(pairs)


def test_attribute_families_climb_and_then_descend(spark):
    one = "class {0}({1}):\n    def set(self):\n        self.{2} = 1\n\n\n"
    text = "".join(one.format(*x) for x in [("Top", "", "size"), ("Left", "Top", "size"), ("Right", "Top", "size"), ("Low", "Left, Right", "size"), ("Mixin", "", "size"), ("Mixed", "Low, Mixin", "size"), ("Far", "Mixin", "size"), ("Apart", "", "size"), ("Left2", "Left", "other")])
    w = Workspace.of(spark, {"a.py": text.replace("()", "")})
    of = lambda name: sorted(short[r.member_id] for r in w.attribute_family(name).collect())
    short = {r.symbol_id: r.qualifier for r in w.tables.symbols.collect()}
    assert of("Left::size") == ["Left", "Low", "Mixed", "Right", "Top"]
    assert of("Mixin::size") == ["Far", "Mixed", "Mixin"]
    assert of("Mixed::size") == ["Far", "Left", "Low", "Mixed", "Mixin", "Right", "Top"]
    assert of("Apart::size") == ["Apart"] and of("Left2::other") == ["Left2"]
    assert w.rename("Left::size", "width")[0].count() == 5


def _covered(members):
    """The greedy cover, one class after another."""
    classes = {}
    for m in sorted(members, key=lambda m: (m[1], m[2])):
        classes.setdefault(m[0], []).append(m)
    order = sorted((c for c in classes.values() if len(c) > 1), key=lambda c: (-c[0][4], c[0][5], c[0][1], c[0][2]))
    taken = []
    for c in order:
        free = [m for m in c if not any(x[1] == m[1] and x[2] <= m[2] and m[3] <= x[3] for x in taken)]
        if len(free) > 1:
            taken += free
    return sorted((m[0], m[1], m[2], m[3], m[4]) for m in taken)


@pytest.mark.parametrize("seed", range(4))
def test_clone_cover_is_the_greedy_one(spark, seed):
    """Random forests of spans with few different shapes: copies nest, are covered in part, and classes fall to one copy."""
    import random

    from codeloom.operators.clones import greedy_cover

    rng, members = random.Random(seed), []

    def grow(path, start, room, depth):
        """A span of `room` tokens, and spans in it; its class is named by its size and a coin."""
        members.append((f"{room}{rng.choice('ab')}", path, start, start + room, room, depth))
        at = start + 1
        while at < start + room - 2:
            size = rng.randint(1, max(1, min(12, room // 2)))
            if at + size < start + room and rng.random() < 0.7:
                grow(path, at, size, depth + 1)
            at += size + rng.randint(0, 2)

    for f in range(12):
        for k in range(3):
            grow(f"f{f}", 100 * k, rng.randint(10, 40), 1)
    counts = {}
    for m in members:
        counts[m[0]] = counts.get(m[0], 0) + 1
    rows = spark.createDataFrame([m for m in members if counts[m[0]] > 1], "class string, path string, start bigint, end bigint, tokens int, depth int")
    assert sorted(tuple(r) for r in greedy_cover(rows).collect()) == _covered(members)


def test_innermost_sweeps_any_intervals(spark):
    import random

    from codeloom.operators.resolving import innermost

    rng = random.Random(8)
    spans = [(k, f"s{n}", a := rng.randint(0, 60), a + rng.randint(0, 30)) for k in range(3) for n in range(40)] + [(None, "none", 0, 99)]
    points = [(k, f"{k}-{p}", p) for k in range(4) for p in range(-2, 95)] + [(0, "null", None), (None, "no key", 5)]
    outer, inner = spark.createDataFrame(spans, "k int, name string, a bigint, b bigint"), spark.createDataFrame(points, "k int, id string, p bigint")
    for strict in (False, True):
        holds = lambda s, k, p: s[0] == k and p is not None and (s[2] < p if strict else s[2] <= p) and p < s[3]
        want = {i: min(((s[3] - s[2], s[1]) for s in spans if k is not None and holds(s, k, p)), default=(0, None))[1] for k, i, p in points}
        got = innermost(inner, outer, ["k"], "id", "a", "b", "name", "p", strict=strict).collect()
        assert {r.id: r.name for r in got} == want and len(got) == len(points)


def test_consumers_follow_typed_edges(spark):
    from codeloom.operators.graphs import regular_walk

    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "a", "x"), ("a", "d", "y"), ("c", "e", "x"), ("e", "f", "x")], "src string, dst string, label string")
    starts = spark.createDataFrame([("a", "s")], "node string, state string")
    got = {(r.node, r.state, r.depth, r.stop) for r in regular_walk(edges, starts, [("s", "x", "t"), ("t", "y", "s")], 4).collect()}
    assert got == {("a", "s", 0, None), ("b", "t", 1, None), ("c", "s", 2, None), ("a", "t", 3, None), ("e", "t", 3, "end"), ("d", "s", 4, "end")}
    assert {(r.node, r.stop) for r in regular_walk(edges, starts, [("s", "x", "s"), ("s", "y", "s")], 2).collect()} == {("a", None), ("b", None), ("d", "end"), ("c", "depth-limit")}

    w = Workspace.of(spark, {
        "k.yaml": "kind: ConfigMap\nmetadata:\n  name: conf\ndata:\n  MODE: fast\n", "pod.yaml": "kind: Pod\nmetadata:\n  name: pod\nenv:\n  - name: APP_MODE\n    valueFrom:\n      configMapKeyRef:\n        name: conf\n        key: MODE\n",
        "a.go": 'package a\n\nimport "os"\n\nfunc mode() string {\n\treturn os.Getenv("APP_MODE")\n}\n', "m/main.tf": 'variable "size" {\n  default = 1\n}\n\nlocals {\n  twice = var.size\n}\n\noutput "all" {\n  value = local.twice\n}\n',
        "main.tf": 'variable "top" {\n  default = 2\n}\n\nmodule "m" {\n  source = "./m"\n  size = var.top\n}\n\noutput "end" {\n  value = module.m.all\n}\n', "s.css": ":root { --ink: red; }\n.a { color: var(--ink); }\n",
    })
    named = {r.symbol_id: r.name for r in w.tables.symbols.collect()}
    chain = lambda name: [(r.state, named.get(r.node.split(":", 1)[1], r.node.split(":", 1)[0])) for r in sorted(w.consumers(name).collect(), key=lambda r: r.depth)]
    assert chain("data::MODE") == [("value", "value"), ("use", "use"), ("environment", "environment"), ("reader", "mode")]
    assert chain("var::top") == [("variable", "top"), ("variable", "size"), ("variable", "twice"), ("variable", "all"), ("variable", "end")]
    assert [x[0] for x in chain("--ink")] == ["property", "use"]


def test_declarations_name_the_values_file_of_their_chart(spark):
    w = Workspace.of(spark, {p: t for c in ("a", "b") for p, t in {f"{c}/Chart.yaml": "name: x\n", f"{c}/values.yaml": "mode: one\n", f"{c}/values-prod.yaml": "mode: two\n", f"{c}/templates/t.yaml": "env:\n  - name: MODE\n    value: {{ .Values.mode }}\n"}.items()})
    assert {(r.path, r.values_key, r.values_path) for r in w.stitch().collect()} == {(f"{c}/templates/t.yaml", "mode", f"{c}/values.yaml") for c in "ab"}


def test_directives_stand_behind_comments_of_any_length(spark):
    long = "/* " + "x" * 5000 + " */\n  // y\n"
    w = Workspace.of(spark, {"a.ts": "export async function act() {\n  " + long + "  'use server';\n  return 1;\n}\nexport function other() {\n  call();\n  'use server';\n}\n", "b.ts": long + "'use server';\nexport function whole() {\n  return 2;\n}\n"})
    found = {r.name for r in w.entry_points("http").join(w.tables.symbols.select("symbol_id", "name"), "symbol_id").collect()}
    assert found == {"act", "whole"}


def test_charts_nest_without_a_bound(spark):
    depth, files, body = 11, {}, "size: 1\n"
    for i in reversed(range(depth)):
        body = f"c{i}:\n" + "".join(f"  {x}\n" for x in body.splitlines())
    for i in range(depth + 1):
        folder = "top/" + "".join(f"charts/c{j}/" for j in range(i))
        files |= {f"{folder}Chart.yaml": "name: x\n", f"{folder}values.yaml": body if i == 0 else "size: 0\n" if i == depth else "own: 1\n"}
    w = Workspace.of(spark, files)
    last = "top/" + "/".join(f"charts/c{j}" for j in range(depth)) + "/size"
    assert {(r.path, r.value, r.wins) for r in w.helm().where(f"key = '{last}'").collect()} == {("top/values.yaml", "1", True), (f"{last[:-5]}/values.yaml", "0", False)}


def test_path_receivers_and_shared_member_names(spark):
    w = Workspace.of(spark, {
        "src/model/mod.rs": "pub fn slug() -> i32 {\n    1\n}\n", "src/model/parts.rs": "pub fn part() -> i32 {\n    super::slug()\n}\npub fn near() -> i32 {\n    self::part()\n}\n", "src/text.rs": "pub fn slug() -> i32 {\n    2\n}\n",
        "src/main.rs": "fn main() {\n    crate::model::slug();\n    lib::text::slug();\n    other::slug();\n}\n",
        "a.ts": "class Order {\n  name: string;\n  title: string;\n}\nclass Named {\n  name(): string { return 'x'; }\n}\nfunction use(o: Order, n: Named) {\n  o.name;\n  n.name();\n  o.title;\n}\n",
        "a.md": "# Top\n\n[x](#top) [y](b.md#top)\n", "b.md": "# Top\n",
    })
    at = {r.symbol_id: (r.path, r.kind) for r in w.tables.symbols.collect()}
    rows = w.resolved.collect()
    rust = {(r.path.rpartition("/")[2], r.receiver, r.name): (at[r.target_id][0] if r.target_id else None, r.confidence, r.rule) for r in rows if r.language == "rust" and r.receiver}
    assert rust[("parts.rs", "super", "slug")] == ("src/model/mod.rs", 0, 102) and rust[("parts.rs", "self", "part")] == ("src/model/parts.rs", 0, 102)
    assert rust[("main.rs", "model", "slug")] == ("src/model/mod.rs", 1, 103) and rust[("main.rs", "text", "slug")] == ("src/text.rs", 1, 103)
    assert rust[("main.rs", "other", "slug")][2] not in (102, 103)
    members = {(r.receiver, r.name, r.kind): at[r.target_id][1] for r in rows if r.language == "typescript" and r.receiver in ("o", "n") and r.target_id}
    assert members == {("o", "name", "field"): "field", ("n", "name", "call"): "method", ("o", "title", "field"): "field"}
    assert {(r.path, at[r.target_id][0]) for r in rows if r.language == "markdown" and r.target_id} >= {("a.md", "a.md")}


RECIPE = "requires language python\nrequires symbol lead\nexpect no-new unused\nexpect no-new duplicates\nexpect changed > 0 files\nexpect refusals = 0\nstep drop\n  select symbols\n  where name={0} kind=function\n  {1}\n"


def test_recipes_hold_what_they_leave_against_expectations(spark):
    from codeloom.operators.recipes import RecipeError, read

    w = Workspace.of(spark, {"a.py": "def follow():\n    return 1\n\n\ndef lead():\n    return follow()\n\n\ndef alone():\n    return 2\n"})
    bad, good = w.verify(RECIPE.format("lead", "delete")), w.verify(RECIPE.format("alone", "delete"))
    said = lambda out: {r.expectation: (r.actual, r.held) for r in out["expectations"].collect()}
    assert said(bad) == {"no-new unused": (1, False), "no-new duplicates": (0, True), "changed > 0 files": (1, True), "refusals = 0": (0, True)} and not bad["ok"]
    assert said(good)["no-new unused"] == (0, True) and good["ok"] and good["changed"].first().path == "a.py"
    skipped = w.verify(RECIPE.format("follow", "on-refusal skip\n  delete"))
    assert said(skipped)["refusals = 0"] == (1, False) and said(skipped)["changed > 0 files"] == (0, False)
    for text in ("expect no-new bugs", "expect changed 3", "expect changed > x", "requires planet mars", "requires language klingon"):
        with pytest.raises(RecipeError):
            read(text)
    with pytest.raises(edits.Refusal):
        w.run("requires path nowhere/\n" + RECIPE.format("alone", "delete"))


def test_facts_of_other_extractors_are_not_served(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    rows = spark.createDataFrame([("a.py", "python", "x = 1\n"), ("b.py", "python", "y = 1\n"), ("c.py", "python", "x = 1\n")], incremental.MANIFEST)
    incremental.index_batch(rows, store)
    now = incremental.fingerprint()
    monkeypatch.setattr(incremental, "fingerprint", lambda: "later")
    assert incremental.stored(spark, store).count() == 0 and incremental.stale(spark, store).count() == 3
    incremental.index_batch(rows.where("path = 'a.py'"), store, 1)
    assert {r.path for r in incremental.stored(spark, store).collect()} == {"a.py", "c.py"} and [r.path for r in incremental.stale(spark, store).collect()] == ["b.py"]
    incremental.index_batch(spark.createDataFrame([("a.py", "python", "old = 1\n")], incremental.MANIFEST), store, 0)  # comes late
    incremental.index_batch(rows, store, 2)
    incremental.compact(spark, store)
    assert {r.version for r in spark.read.parquet(f"{store}/facts").select("version").distinct().collect()} == {"later"} and now != "later"
    assert {(r.path, r.symbols[0].name) for r in incremental.stored(spark, store).collect()} == {("a.py", "x"), ("b.py", "y"), ("c.py", "x")}
    incremental.index_batch(rows, store, 3)
    assert spark.read.parquet(f"{store}/facts").count() == 3


def test_schemas_of_script_types_close_over_references(spark):
    import json

    from codeloom.operators.api import script_schemas

    w = Workspace.of(spark, {
        "types.ts": "export interface Pet {\n  id: number;\n  name?: string;\n  mother: Pet | null;\n  tags: Tag[];\n  kind: 'cat' | 'dog';\n  owner: Owner;\n}\nexport interface Tag {\n  text: string\n  count: Record<string, number>\n}\nexport interface Unused {\n  x: Owner;\n}\n",
        "people.ts": "export interface Owner {\n  pets: Array<Pet>;\n  born: Date;\n  note: string | undefined;\n  odd: Elsewhere;\n}\n",
        "app/api/pets/route.ts": "import { Pet } from '../../../types';\nexport async function POST(req: Request) {\n  const body: Pet = await req.json();\n  return body;\n}\n",
    })
    out = {r.name: json.loads(r.json) for r in script_schemas(w.tables, w.resolved).collect()}
    pet = {"$ref": "#/components/schemas/Pet"}
    assert set(out) == {"Pet", "Tag", "Owner"}
    assert out["Pet"] == {"type": "object", "properties": {"id": {"type": "number"}, "name": {"type": "string"}, "mother": {"anyOf": [pet, {"type": "null"}]}, "tags": {"type": "array", "items": {"$ref": "#/components/schemas/Tag"}}, "kind": {"type": "string", "enum": ["cat", "dog"]}, "owner": {"$ref": "#/components/schemas/Owner"}}, "required": ["id", "mother", "tags", "kind", "owner"]}
    assert out["Tag"]["properties"] == {"text": {"type": "string"}, "count": {"type": "object", "additionalProperties": {"type": "number"}}}
    assert out["Owner"] == {"type": "object", "properties": {"pets": {"type": "array", "items": pet}, "born": {"type": "string", "format": "date-time"}, "note": {"type": "string"}, "odd": {}}, "required": ["pets", "born", "odd"]}


CHANGES = {
    "renamed definition": ("shop/util.py", "def clamp(", "def squeeze("),
    "new definition of a known name": ("app.py", "def main():", "def total():\n    pass\n\n\ndef main():"),
    "shifted places": ("shop/core.py", "import os\n", "import os\n\nX = 1\n"),
    "other import": ("web/cart.ts", "import { add as plus } from './sum';\n", ""),
    "other heading": ("docs/guide.md", "# Big Guide", "# Small Guide"),
    "barrel": ("shop/__init__.py", "total as price", "settings as price"),
    "other key": ("chart/values.yaml", "mode: fast", "mood: fast"),
    "variable": ("infra/main.tf", 'variable "zone"', 'variable "place"'),
}


def test_edited_workspaces_resolve_as_whole_ones_do(spark):
    """Facts and answers after each kind of change, against a run over all files; what is resolved again is counted."""
    from codeloom.plans.sample import FILES

    now, files = Workspace.of(spark, FILES), dict(FILES)
    total = now.resolved.count()
    say = lambda w: sorted(map(repr, w.resolved.select(sorted(w.resolved.columns)).collect()))
    again = []
    for names in (["shifted places", "other key", "other import"], [n for n in CHANGES if n not in ("shifted places", "other key", "other import")]):
        for name in names:
            path, old, new = CHANGES[name]
            assert old in files[path], name
            files[path] = files[path].replace(old, new)
        done = spark.createDataFrame([(CHANGES[n][0], files[CHANGES[n][0]]) for n in names], "path string, after string")
        now = now.with_texts(done)
        again.append(now.resolved_again.count())
        whole = Workspace.of(spark, files)
        assert say(now) == say(whole), names
        assert sorted(r.symbol_id for r in now.tables.symbols.collect()) == sorted(r.symbol_id for r in whole.tables.symbols.collect())
    assert again[0] < total


def test_flows_hold_every_reference_of_an_initialiser(spark):
    from codeloom.operators.resolving import containing

    outer = spark.createDataFrame([("f", "a", 0, 10), ("f", "b", 2, 5), ("f", "c", 4, 9), ("g", "d", 0, 3)], "path string, name string, s int, e int")
    inner = spark.createDataFrame([(1, "f", 4), (2, "f", 9), (3, "f", 10), (4, "g", 2), (5, "h", 1)], "id int, path string, at int")
    assert sorted(tuple(r) for r in containing(inner, outer, ["path"], "id", "s", "e", "name", "at").collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (4, "d")]


def test_targets_by_place_and_candidates(spark):
    w = Workspace.of(spark, {"a.py": "# ñ\ndef one():\n    ñ = two(); return ñ\n\n\ndef two():\n    return 1\n", "b.py": "def two():\n    return 2\n"})
    name = lambda place: w.target(place).first().qualified_name
    assert name("a.py:2:5") == "one" and name("a.py:3:9") == "two" and name("a.py:3:23") == "ñ"
    assert {(r.place, r.kind) for r in w.candidates("two").collect()} == {("a.py:6:5", "function"), ("b.py:1:5", "function")}
    for nowhere in ("a.py:99:1", "none.py:1:1", "a.py:1:1"):
        with pytest.raises(NotFound):
            w.target(nowhere)
