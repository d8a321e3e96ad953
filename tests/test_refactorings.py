import pytest

from codeloom.operators import facts, refactorings
from codeloom.operators.edits import Refusal
from codeloom.operators.patterns import unbound
from codeloom.operators.types import held
from codeloom.workspace import Workspace

CODE = '''import os
from math import floor, ceil

MODE = False


def area(w, h, scale=1):
    total = w * h
    if total > 3:
        twice = total * 2
        print(twice)
    else:
        print(total)
    return floor(total * scale)


def call():
    if MODE:
        return ceil(area(1, 2))
    return area(3, 4, 5)


def late(x):
    k = x
    k = 1
    if not (x and k):
        print(x)
'''


@pytest.fixture(scope="module")
def w(spark):
    return Workspace.of(spark, {"m.py": CODE, "b.go": "package b\n\nfunc f(a int, b int) int {\n\treturn a\n}\n\nfunc g() int {\n\treturn f(1, h(2, 3))\n}\n"})


def at(text, size=None):
    i = CODE.index(text)
    return i if size is None else (i, i + size)


def applied(w, planned):
    return {r.path: r.after for r in w.apply(planned).collect()}


def test_extract_variable(w):
    a, b = at("w * h", 5)
    out = applied(w, w.extract_variable("m.py", a, b, "product"))["m.py"]
    assert "    product = w * h\n    total = product\n" in out
    for place, name, kind in ((at("w * h", 5), "total", "name-taken"), (at("w * h", 4), "q", "not-an-expression")):
        with pytest.raises(Refusal) as e:
            w.extract_variable("m.py", *place, name)
        assert e.value.kind == kind


def test_extract_function(w):
    a = at("    total = w * h\n") + 4
    b = CODE.index("    return floor") - 1
    out = applied(w, w.extract_function("m.py", a, b, "measure"))["m.py"]
    assert "def measure(w, h):\n    total = w * h\n" in out and "    total = measure(w, h)\n    return floor(" in out and "    return total\n" in out
    with pytest.raises(Refusal) as e:
        w.extract_function("m.py", at("return ceil"), at("return ceil") + len("return ceil(area(1, 2))"), "q")
    assert e.value.kind == "control-flow"


def test_inline_and_its_refusals(w):
    ids = {(r.name, r.name_start): r.symbol_id for r in w.tables.symbols.where("path = 'm.py'").collect()}
    place = next(v for (n, _), v in ids.items() if n == "twice")
    assert "        print(total * 2)\n" in applied(w, w.inline_variable(place))["m.py"].replace("print((total * 2))", "print(total * 2)")
    with pytest.raises(Refusal) as e:
        w.inline_variable(next(v for (n, _), v in ids.items() if n == "k"))
    assert e.value.kind == "assigned-again"


def test_signatures(w):
    with pytest.raises(Refusal) as e:
        w.change_signature("area", "remove:2")
    assert e.value.kind == "no-such-parameter"
    out = applied(w, w.change_signature("area", "add:0:unit:None"))["m.py"]
    assert "def area(unit, w, h, scale=1):" in out and "area(None, 1, 2)" in out and "area(None, 3, 4, 5)" in out
    out = applied(w, w.change_signature("f", "move:0:1"))["b.go"]
    assert "func f(b int, a int) int" in out and "f(h(2, 3), 1)" in out
    with pytest.raises(Refusal):
        w.change_signature("area", "swap:1")


def test_micro_rewrites(w):
    out = applied(w, w.rewrite("m.py", at("if total"), "invert-if"))["m.py"]
    assert "    if total <= 3:\n        print(total)\n    else:\n        twice = total * 2\n        print(twice)\n" in out
    out = applied(w, w.rewrite("m.py", at("not (x"), "de-morgan"))["m.py"]
    assert "if not x or not k:" in out
    out = applied(w, w.rewrite("m.py", at("if not (x"), "guard-clause"))["m.py"]
    assert out.endswith("    if x and k:\n        return\n    print(x)\n")


def test_flag_removal_drops_what_it_orphans(w):
    planned, rounds = w.remove_flag("MODE", False)
    out = applied(w, planned)["m.py"]
    assert "MODE" not in out and "ceil" not in out and "import os" in out and "    return area(3, 4, 5)" in out
    assert [x["action"] for x in rounds] == ["substitute", "fold", "remove-symbols", "remove-imports"]


@pytest.mark.parametrize(
    "before,after",
    [
        ("x = a if True else b\n", "x = a\n"), ("if False:\n    a()\nelif q:\n    b()\n", "if q:\n    b()\n"), ("if q:\n    a()\nelif True:\n    b()\nelse:\n    c()\n", "if q:\n    a()\nelse:\n    b()\n"),
        ("def f():\n    if False:\n        a()\n", "def f():\n    pass\n"), ("x = p and True and q\n", "x = p and q\n"), ("x = p or True or q\n", "x = p or True\n"), ("if not False:\n    a()\n    b()\nc()\n", "a()\nb()\nc()\n"),
    ],
)
def test_folding(before, after):
    assert refactorings.fold(before) == after


def test_orphaned_imports(w):
    a = at("        return ceil(area(1, 2))\n")
    planned = w.spark.createDataFrame([("m.py", a, a + len("        return ceil(area(1, 2))"), "        return 1")], "path string, start bigint, end bigint, replacement string")
    assert [r.name for r in w.orphaned_imports(planned).collect()] == ["ceil"]


def test_commit_checks_its_basis(w, tmp_path):
    for path, text in (("m.py", CODE),):
        (tmp_path / path).write_text(text)
    done = w.apply(w.change_signature("area", "add:0:unit:None"))
    assert refactorings.commit(done, str(tmp_path)) == 1 and "def area(unit" in (tmp_path / "m.py").read_text()
    with pytest.raises(Refusal) as e:
        refactorings.commit(done, str(tmp_path))
    assert e.value.kind == "basis-changed" and [p.name for p in tmp_path.iterdir()] == ["m.py"]


def test_values_that_disagree_are_not_settled(spark):
    w = Workspace.of(spark, {"a.py": "def f():\n    x = 1\n    x = 's'\n    y = 2\n    y = 3\n    for z in [1, 2]:\n        pass\n"})
    out = {r.name: (r.types, r.settled) for r in held(w.tables, w.types).collect()}
    assert out == {"x": (["int", "str"], False), "y": (["int"], True), "z": (["int"], True)}


def test_keys_and_snapshots(spark, tmp_path):
    files = {"a.py": "x = 1\n", "b.py": "from a import x\ny = x\n"}
    one = Workspace.of(spark, files, store=str(tmp_path))
    other = Workspace.of(spark, dict(reversed(files.items())), store=str(tmp_path))
    assert facts.workspace_key(one.files) == facts.workspace_key(other.files) != facts.workspace_key(Workspace.of(spark, {"a.py": "x = 2\n"}).files)
    assert one.resolved.count() == other.resolved.count() > 0 and len(list(tmp_path.iterdir())) == 1
    assert unbound("f($X)", "g($X, $Y)") == ["$Y"]


def test_reasons_that_spare_unused_symbols(spark):
    w = Workspace.of(spark, {
        "a.py": "__all__ = ['listed']\n\n\nclass Suite:\n    def test_one(self):\n        pass\n\n\ndef listed():\n    pass\n\n\ndef gone():\n    pass\n\n\ndef _meant():\n    pass\n",
        "test_b.py": "class Case:\n    def test_two(self):\n        pass\n", "doc.md": "# Alone\n", "p.go": "package p\n", "m.tf": 'provider "aws" {\n  region = "x"\n}\n',
        "Bean.java": "class Bean { String getOwnerName() { return s; } }\n", "t.html": "<p>${x.ownerName}</p>\n", "u.py": "T = 'ownerName'\n",
    })
    out = {(r.path, r.name): r.spared for r in w.unused().collect()}
    assert out[("a.py", "gone")] is None and out[("a.py", "_meant")] == "underscore" and out[("a.py", "listed")] == "named-in-text"
    assert out[("test_b.py", "Case")] == "holds-an-entry-point" and out[("doc.md", "Alone")] == "structures-prose"
    assert out[("m.tf", "aws")] == "no-address" and out.get(("Bean.java", "getOwnerName")) == "reached-by-its-property"


def test_imports_say_what_becomes_of_them(spark):
    from codeloom.operators.edits import organized_imports

    w = Workspace.of(spark, {"a.py": "from __future__ import annotations\nimport os.path\nimport sys\nfrom b import x, y\n__all__ = ['y']\n\n\nprint(sys)\n", "b.py": "x = 1\ny = 2\n", "c.py": "from z import q\nimport b\nimport a\n\nprint(q, a, b)\n"})
    out = {(r.path, r.name): (r.status, r.reason) for r in organized_imports(w.tables, w.resolved).collect()}
    assert out == {("a.py", "annotations"): ("kept", "future"), ("a.py", "os"): ("kept", "submodule"), ("a.py", "sys"): ("live", None), ("a.py", "x"): ("removed", None), ("a.py", "y"): ("kept", "listed-in-all"), ("c.py", "q"): ("live", None), ("c.py", "a"): ("live", None), ("c.py", "b"): ("live", None)}
    assert applied(w, refactorings.sorted_imports(w.files).where("path = 'c.py'"))["c.py"].startswith("import a\nimport b\nfrom z import q\n\n")
    dead = organized_imports(w.tables, w.resolved).where("status = 'removed'")
    assert "from b import y\n" in applied(w, refactorings.import_edits(w.files, dead))["a.py"]


def test_packages_name_their_commands(spark):
    from codeloom.operators.reports import packaging_scripts

    files = [("pyproject.toml", '[project]\nname = "x"\n\n[project.scripts]\nrun = "pkg.cli:main"\n\n[tool.z]\na = "b:c"\n'), ("setup.py", "setup(entry_points={'console_scripts': ['go = pkg.go:start', 'two=pkg.two:f']})\n"), ("setup.cfg", "[options.entry_points]\nconsole_scripts =\n    cfg = pkg.cfg:run\n")]
    out = sorted((r.script, r.module, r.function) for r in packaging_scripts(spark.createDataFrame(files, "path string, text string")).collect())
    assert out == [("cfg", "pkg.cfg", "run"), ("go", "pkg.go", "start"), ("run", "pkg.cli", "main"), ("two", "pkg.two", "f")]
    w = Workspace.of(spark, {"pkg/__main__.py": "from .cli import main\n\nmain()\n", "pkg/cli.py": "def main():\n    pass\n\n\ndef other():\n    pass\n", "pkg/__init__.py": ""})
    assert [(r.rule, r.symbol_id.split(":")[0]) for r in w.entry_points("main").collect()] == [("python-package-main", "pkg/cli.py")]


def test_common_names_make_no_pairs(spark):
    """A name that many files define is resolved by counts: plan rows stay in proportion to references and definitions."""
    files = {f"m{i}.py": f"def same():\n    return {i}\n\n\ndef use_{i}():\n    return same()\n" for i in range(60)} | {"far.py": "def go():\n    return same()\n", "one.py": "def only():\n    return 1\n", "two.py": "def go2():\n    return only()\n"}
    w = Workspace.of(spark, files)
    out = {r.path: (r.target_id, r.confidence, r.rule) for r in w.resolved.where("kind = 'call'").collect()}
    assert all(out[f"m{i}.py"] == (f"m{i}.py:000000004", 0, 5) for i in range(60))
    assert out["far.py"] == (None, 3, 15) and out["two.py"] == ("one.py:000000004", 3, 15)


def test_schemas_of_models(spark):
    import json

    from codeloom.operators.api import schemas

    w = Workspace.of(spark, {"m.py": "from pydantic import BaseModel\n\n\nclass Base(BaseModel):\n    id: int\n\n\nclass Pet(Base):\n    name: str\n    tag: str | None = None\n    home: Base\n\n\nclass Other:\n    x: int\n"})
    out = {r.name: json.loads(r.json) for r in schemas(w.tables).collect()}
    assert out == {
        "Base": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]},
        "Pet": {"type": "object", "properties": {"name": {"type": "string"}, "tag": {"type": "string"}, "home": {"$ref": "#/components/schemas/Base"}}, "required": ["name", "home"]},
    }


def test_moving_a_function(spark):
    files = {
        "pkg/a.py": '"""Doc."""\nimport math\nfrom b import other\n\nSIZE = 3\n\n\ndef area(x):\n    return math.pi * x * SIZE\n\n\ndef rest():\n    return other()\n',
        "pkg/c.py": "import os\n\n\ndef here():\n    return os.sep\n", "b.py": "def other():\n    return 1\n",
        "user.py": "from pkg.a import rest, area as size\n\nprint(size(2), rest())\n", "far.py": "import pkg.a\n",
    }
    w = Workspace.of(spark, files)
    out = applied(w, w.move("area", "pkg/c.py"))
    assert "def area" not in out["pkg/a.py"] and "def rest():" in out["pkg/a.py"]
    assert out["pkg/c.py"] == "import os\nimport math\nfrom pkg.a import SIZE\n\n\ndef here():\n    return os.sep\n\n\ndef area(x):\n    return math.pi * x * SIZE\n"
    assert out["user.py"].startswith("from pkg.a import rest\nfrom pkg.c import area as size\n")
    after = Workspace.of(spark, files | out)
    assert after.resolved.where("path = 'user.py' and kind = 'call' and name = 'size'").first()["target_id"].startswith("pkg/c.py:")
    with pytest.raises(Refusal) as e:
        w.move("nothing", "pkg/c.py")
    assert e.value.kind == "not-found"


def test_edits_are_planned_once_however_often_they_are_checked_and_applied(spark):
    w = Workspace.of(spark, {"a.py": "x = 1\n", "b.py": "y = 2\n"})
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a.py", 0, 1, "z"), ("b.py", 0, 1, "v")], "path string, start bigint, end bigint, replacement string")
    assert sorted(r["after"] for r in w.apply(rows.mapInArrow(counted, rows.schema)).collect()) == ["v = 2\n", "z = 1\n"]
    assert seen.value == 2
