"""Refactorings that rewrite code, each as rows of edits (path, start, end, replacement) or a refusal.

Gates are plans: every row must satisfy a condition, or the failing rows come back with the refusal. What needs a syntax
tree works on one named file on the driver, or on all touched files in Arrow batches. Bodies are rewritten for Python;
signatures for every language with parenthesised arguments.
"""

from __future__ import annotations

import ast
import os
import tempfile
import textwrap

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schemas import CALLABLE
from .calls import families
from .edits import EDIT, Refusal, apply, safe_deletes, unused_imports
from .facts import Tables
from .resolving import EXACT, FIELD

#: Fixed value: rounds after which a cascade stops.
MAX_ROUNDS = 12


class _Source:
    """A Python file with byte spans of its nodes."""

    def __init__(self, text: str) -> None:
        self.raw = text.encode()
        self.tree = ast.parse(text)
        self.starts = [0]
        for line in self.raw.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.parent = {child: node for node in ast.walk(self.tree) for child in ast.iter_child_nodes(node)}

    def span(self, n) -> tuple[int, int]:
        first = n.decorator_list[0] if getattr(n, "decorator_list", None) else n
        return self.starts[first.lineno - 1] + (first.col_offset if first is n else n.col_offset), self.starts[n.end_lineno - 1] + n.end_col_offset

    def text(self, n) -> str:
        a, b = self.span(n)
        return self.raw[a:b].decode()

    def line(self, n) -> int:
        return self.starts[n.lineno - 1 - (n.lineno - n.decorator_list[0].lineno if getattr(n, "decorator_list", None) else 0)]

    def block(self, body: list) -> str:
        """Whole lines of some neighbouring statements."""
        return self.raw[self.line(body[0]) : self.span(body[-1])[1]].decode()

    def up(self, n, kinds):
        while n is not None and not isinstance(n, kinds):
            n = self.parent.get(n)
        return n

    def innermost(self, at: int, kinds):
        found = [n for n in ast.walk(self.tree) if isinstance(n, kinds) and self.span(n)[0] <= at < self.span(n)[1]]
        return min(found, key=lambda n: self.span(n)[1] - self.span(n)[0], default=None)


def _python(files: DataFrame, path: str) -> _Source:
    row = files.where(F.col("path") == path).select("language", "text").first()
    if row is None:
        raise Refusal("no-such-file", path)
    if row["language"] != "python":
        raise Refusal("unsupported-language", row["language"])
    return _Source(row["text"])


def _edits(files: DataFrame, rows: list[tuple]) -> DataFrame:
    return files.sparkSession.createDataFrame(rows, EDIT)


_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Module)
_names = lambda nodes, kind: [x for n in nodes for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)]


# -- extract (M4) --------------------------------------------------------------------------------------------------------


def extract_variable(files: DataFrame, path: str, start: int, end: int, name: str) -> DataFrame:
    """M4: names the expression at a byte range before the statement that holds it."""
    s = _python(files, path)
    found = [n for n in ast.walk(s.tree) if isinstance(n, ast.expr) and s.span(n) == (start, end)]
    if not found:
        raise Refusal("not-an-expression", f"{path}:{start}-{end}")
    node = found[0]
    at, stmt = node, s.up(node, ast.stmt)
    while at is not stmt:
        at = s.parent[at]
        if isinstance(at, (ast.Lambda, ast.comprehension, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
            raise Refusal("bound-inside", "the expression may use names of a comprehension or lambda")
    if isinstance(stmt, ast.While) or s.raw[s.line(stmt) : s.span(stmt)[0]].strip():
        raise Refusal("evaluated-again", "no place before the statement runs once for it")
    scope = s.up(stmt, _SCOPES)
    if any(x.id == name for x in _names([scope], (ast.Store, ast.Load))) or any(a.arg == name for a in ast.walk(scope) if isinstance(a, ast.arg)):
        raise Refusal("name-taken", name)
    line = s.line(stmt)
    indent = s.raw[line : s.span(stmt)[0]].decode()
    return _edits(files, [(path, line, line, f"{indent}{name} = {s.text(node)}\n"), (path, start, end, name)])


def extract_function(files: DataFrame, path: str, start: int, end: int, name: str) -> DataFrame:
    """M4: moves the statements in a byte range to a function of their own. Its inputs are names bound in the enclosing function outside the range, its outputs names bound in the range and read after it."""
    s = _python(files, path)
    chosen = None
    for n in ast.walk(s.tree):
        for body in (getattr(n, k, None) for k in ("body", "orelse", "finalbody")):
            if isinstance(body, list):
                inside = [x for x in body if isinstance(x, ast.stmt) and start <= s.span(x)[0] and s.span(x)[1] <= end]
                if inside and (chosen is None or len(s.block(inside)) > len(s.block(chosen))):
                    chosen = inside
    if not chosen or s.raw[start : s.span(chosen[0])[0]].strip() or s.raw[s.span(chosen[-1])[1] : end].strip():
        raise Refusal("straddles-blocks", f"{path}:{start}-{end}")
    inner = [x for n in chosen for x in ast.walk(n)]
    if any(isinstance(x, (ast.Yield, ast.YieldFrom, ast.Await)) for x in inner):
        raise Refusal("yields", path)
    loops = {y for x in inner if isinstance(x, (ast.For, ast.While)) for y in ast.walk(x)}
    if any(isinstance(x, ast.Return) or isinstance(x, (ast.Break, ast.Continue)) and x not in loops for x in inner):
        raise Refusal("control-flow", path)
    scope = s.up(s.parent[chosen[0]], _SCOPES)
    region, own = set(inner), [x for x in ast.walk(scope) if x is not scope]
    if any(isinstance(x, (ast.FunctionDef, ast.ClassDef)) and x.name == name for x in ast.walk(s.tree)):
        raise Refusal("name-taken", name)
    if isinstance(scope, ast.Module):
        raise Refusal("module-level", path)
    params = {a.arg for a in ast.walk(scope.args) if isinstance(a, ast.arg)}
    stored_out = params | {x.id for x in own if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store) and x not in region}
    inputs = list(dict.fromkeys(x.id for x in sorted((x for x in inner if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)), key=s.span) if x.id in stored_out))
    again = s.up(s.parent[chosen[0]], (ast.For, ast.While)) is not None
    after = {x.id for x in own if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x not in region and (again or s.span(x)[0] >= end)}
    outputs = list(dict.fromkeys(x.id for x in inner if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store) and x.id in after))
    home = scope
    while not isinstance(s.parent.get(home), ast.Module):
        home = s.parent[home]
    body = textwrap.indent(textwrap.dedent(s.block(chosen)), "    ")
    back = f"\n    return {', '.join(outputs)}" if outputs else ""
    call = f"{', '.join(outputs)} = " * bool(outputs) + f"{name}({', '.join(inputs)})"
    at = s.line(home)
    return _edits(files, [(path, at, at, f"def {name}({', '.join(inputs)}):\n{body}{back}\n\n\n"), (path, s.span(chosen[0])[0], s.span(chosen[-1])[1], call)])


# -- inline and signature (M5, M6) ---------------------------------------------------------------------------------------


def inline_variable(t: Tables, resolved: DataFrame, symbol_id: str) -> DataFrame:
    """M5: puts a variable's value in place of its uses and removes it. It must be assigned once, every use must be proven, code must not run more often, and no name in the value may be bound again."""
    own = t.symbols.where(F.col("symbol_id") == symbol_id)
    row = own.first()
    if row is None or row["kind"] not in ("variable", "constant"):
        raise Refusal("not-a-variable", symbol_id)
    if t.symbols.join(own.select("path", "scope_id", "name"), ["path", "scope_id", "name"], "left_semi").count() > 1:
        raise Refusal("assigned-again", row["name"])
    flow = t.flows.where(F.col("symbol_id") == symbol_id).first()
    if flow is None:
        raise Refusal("no-value", row["name"])
    uses = resolved.where(F.col("target_id") == symbol_id)
    number, weak = uses.agg(F.count("*"), F.count_if((F.col("confidence") != EXACT) | F.col("in_import"))).first()
    if not number or weak:
        raise Refusal("no-use" if not number else "unproven-reference", row["name"], uses.limit(20).collect())
    a, b = flow["source_start"], flow["source_end"]
    inside = resolved.where((F.col("path") == row["path"]) & (F.col("start") >= a) & (F.col("start") < b))
    if number > 1 and not inside.where("kind = 'call'").isEmpty():
        raise Refusal("runs-more-than-once", row["name"])
    means = inside.where("target_id is not null").select(F.col("target_id").alias("symbol_id")).distinct()
    again = t.symbols.join(t.symbols.join(means, "symbol_id", "left_semi").select("path", "scope_id", "name"), ["path", "scope_id", "name"], "left_semi").groupBy("path", "scope_id", "name").count().where("count > 1")
    if rows := again.limit(5).collect():
        raise Refusal("captured-name", rows[0]["name"], rows)
    raw = t.files.where(F.col("path") == row["path"]).first()["text"].encode()
    value = raw[a:b].decode()
    value = value if value.isidentifier() or value.replace(".", "").isalnum() or value[0] in "\"'([{" else f"({value})"
    first = raw.rfind(b"\n", 0, row["full_start"]) + 1
    last = raw.find(b"\n", row["full_end"])
    edits = uses.select("path", "start", "end", F.lit(value).alias("replacement"))
    return edits.unionByName(_edits(t.files, [(row["path"], first, len(raw) if last < 0 else last + 1, "")]))


def _arguments(text: str, at: int) -> tuple[int, int, list[str]] | None:
    """(start, end, parts) inside the parentheses that open at or after a place."""
    at = text.find("(", at)
    if at < 0:
        return None
    depth, quote, parts, last, i = 0, "", [], at + 1, at
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                parts.append(text[last:i])
                return at + 1, i, [p.strip() for p in parts] if any(p.strip() for p in parts) else []
        elif c == "," and depth == 1:
            parts.append(text[last:i])
            last = i + 1
        i += 1
    return None


def parse_change(change: str) -> tuple[str, int, str, str]:
    """remove:i, move:i:j or add:i:declaration:argument."""
    kind, *rest = change.split(":", 3)
    if kind not in ("remove", "move", "add") or len(rest) != {"remove": 1, "move": 2, "add": 3}.get(kind) or not rest[0].isdigit() or kind == "move" and not rest[1].isdigit():
        raise Refusal("unknown-change", change)
    return kind, int(rest[0]), rest[1] if len(rest) > 1 else "", rest[2] if len(rest) > 2 else ""


def changed(parts: list[str], kind: str, i: int, a: str, b: str, definition: bool) -> list[str]:
    if kind != "add" and i >= len(parts) or kind == "move" and int(a) >= len(parts) or kind == "add" and i > len(parts):
        raise IndexError
    out = list(parts)
    if kind == "add":
        out.insert(i, a if definition else b)
    else:
        taken = out.pop(i)
        if kind == "move":
            out.insert(int(a), taken)
    return out


def change_signature(t: Tables, resolved: DataFrame, name: str, change: str) -> DataFrame:
    """M6: changes the parameters of a callable, of its dispatch family and of all calls; refuses unless every reference is a proven call or an import."""
    kind, i, a, b = parse_change(change)
    hit = t.symbols.where(F.col("kind").isin(CALLABLE) & ((F.col("qualified_name") == name) | (F.col("name") == name)))
    kin = families(t)
    both = kin.union(kin.select("concrete_id", "abstract_id")).toDF("a", "b")
    ids = cut(hit.select("symbol_id").union(both.join(hit.select(F.col("symbol_id").alias("a")), "a").select("b")).distinct())
    if ids.isEmpty():
        raise Refusal("not-found", name)
    leaf = name.rpartition("::")[2]
    refs = resolved.join(ids.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi").where("not in_import")
    bad = refs.where((F.col("kind") != "call") | (F.col("confidence") >= FIELD)).unionByName(resolved.where((F.col("name") == leaf) & F.col("target_id").isNull() & (F.col("kind") == "call") & F.col("member")))
    if rows := bad.select("path", "start", "kind").limit(20).collect():
        raise Refusal("unproven-call-site", name, rows)
    defined = t.symbols.join(ids, "symbol_id").select("path", F.col("name_end").alias("at"), F.lit(True).alias("definition"), (F.col("kind") == "method").alias("method"))
    places = defined.unionByName(refs.select("path", F.col("end").alias("at"), F.lit(False).alias("definition"), F.lit(False).alias("method")))
    lists = places.groupBy("path").agg(F.collect_list(F.struct("at", "definition", "method")).alias("places"))

    def run(batches):
        for batch in batches:
            out = []
            for path, lang, text, spots in zip(batch["path"], batch["language"], batch["text"], batch["places"]):
                raw = text.encode()
                for p in spots:
                    found = _arguments(text, len(raw[: p["at"]].decode()))
                    if found is None:
                        out.append((path, p["at"], p["at"], "", "no-arguments"))
                        continue
                    start, end, parts = found
                    bound = int(lang == "python" and p["method"] and bool(parts) and parts[0] in ("self", "cls"))
                    held, rest = parts[:bound], parts[bound:]
                    place = [len(text[:x].encode()) for x in (start, end)]
                    if not p["definition"] and any(x.startswith(("*", "...")) or lang == "python" and x.partition("=")[1] and x.partition("=")[0].strip().isidentifier() and not x.partition("=")[2].startswith("=") for x in rest):
                        out.append((path, *place, "", "keyword-or-spread-arguments"))
                        continue
                    try:
                        out.append((path, *place, ", ".join(held + changed(rest, kind, i, a, b, p["definition"])), None))
                    except IndexError:
                        out.append((path, *place, "", "no-such-parameter"))
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement", "refused"])

    planned = cut(t.files.join(lists, "path").select("path", "language", "text", "places").mapInPandas(run, EDIT + ", refused string"))
    if rows := planned.where("refused is not null").limit(20).collect():
        raise Refusal(rows[0]["refused"], name, rows)
    return planned.drop("refused").distinct()


# -- move (M7) -----------------------------------------------------------------------------------------------------------


def _module(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def _imports_of(s: _Source) -> dict[str, str]:
    """Name -> the statement that imports it alone, of a file's top level."""
    out = {}
    for n in s.tree.body:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            for x in n.names:
                alone = ast.Import([x]) if isinstance(n, ast.Import) else ast.ImportFrom(n.module, [x], n.level)
                out[x.asname or x.name.partition(".")[0]] = ast.unparse(alone)
    return out


def _after_imports(s: _Source) -> int:
    """Where a further import goes: after the last import of the top, or after the docstring."""
    body, last = s.tree.body, None
    for i, n in enumerate(body):
        if isinstance(n, (ast.Import, ast.ImportFrom)) or i == 0 and isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant):
            last = n
    return 0 if last is None else min(len(s.raw), s.span(last)[1] + 1)


def move_symbol(t: Tables, resolved: DataFrame, name: str, destination: str) -> DataFrame:
    """M7: moves a top-level function or class of a Python file to another file. Imports that it needs go with it; files that import it, and its old file where that still uses it, import it from its new place."""
    rows = t.symbols.where((F.col("qualified_name") == name) & F.col("kind").isin("function", "class") & F.col("container_id").isNull() & (F.col("language") == "python")).limit(2).collect()
    if len(rows) != 1:
        raise Refusal("not-found" if not rows else "ambiguous", name, rows)
    origin = rows[0]["path"]
    if origin == destination:
        raise Refusal("nothing-to-do", destination)
    a, b = _python(t.files, origin), _python(t.files, destination)
    if not t.symbols.where((F.col("path") == destination) & (F.col("name") == name) & F.col("container_id").isNull()).isEmpty():
        raise Refusal("name-taken", name)
    uses = resolved.where(F.col("target_id") == rows[0]["symbol_id"]).where("not in_import")
    if bad := uses.where(((F.col("path") != origin) & F.col("receiver").isNotNull()) | (F.col("confidence") >= FIELD)).select("path", "start").limit(20).collect():
        raise Refusal("unproven-reference", name, bad)
    node = next(n for n in a.tree.body if getattr(n, "name", None) == name)
    mine, known, tops = {x.id for x in _names([node], ast.Load)}, _imports_of(a), {getattr(n, "name", None) for n in a.tree.body} | {x.id for n in a.tree.body if isinstance(n, (ast.Assign, ast.AnnAssign)) for x in _names([n], ast.Store)}
    there = _imports_of(b)
    needed = sorted({known[x] for x in mine if x in known and there.get(x) != known[x]})
    own = sorted(x for x in mine if x in tops and x != name and x is not None)
    still = any(x.id == name for n in a.tree.body if n is not node for x in _names([n], ast.Load))
    if own and still:
        raise Refusal("circular-import", ", ".join(own))
    if any(line.startswith("from .") for line in needed):
        raise Refusal("relative-import", needed[0])
    if own:
        needed.append(f"from {_module(origin)} import {', '.join(own)}")
    start, end = a.line(node), a.span(node)[1]
    while end < len(a.raw) and a.raw[end : end + 1] == b"\n":
        end += 1
    edits = [(origin, start, end, "")]
    new = f"from {_module(destination)} import {name}"
    if still:
        edits.append((origin, _after_imports(a), _after_imports(a), new + "\n"))
    if needed:
        edits.append((destination, _after_imports(b), _after_imports(b), "\n".join(needed) + "\n"))
    gap = "" if not b.raw.strip() else "\n\n" if b.raw.endswith(b"\n") else "\n\n\n"
    edits.append((destination, len(b.raw), len(b.raw), f"{gap}{a.block([node])}\n"))
    from .references import import_files

    named = t.bindings.where((F.col("original") == name) & (F.col("language") == "python")).join(import_files(t).where(F.col("file") == origin).select("path", "import_pos"), ["path", "import_pos"])
    statements = named.join(t.imports.select("path", "import_pos", "start"), ["path", "import_pos"]).groupBy("path").agg(F.collect_set("start").alias("starts"))

    def run(batches):
        for batch in batches:
            out = []
            for path, text, starts in zip(batch["path"], batch["text"], batch["starts"]):
                s = _Source(text)
                for n in ast.walk(s.tree):
                    if isinstance(n, ast.ImportFrom) and s.span(n)[0] in set(starts):
                        moved = [x for x in n.names if x.name == name]
                        kept = [x for x in n.names if x.name != name]
                        lines = [ast.unparse(ast.ImportFrom(n.module, kept, n.level))] * bool(kept) + [ast.unparse(ast.ImportFrom(_module(destination), moved, 0))] * (path != destination)
                        at, to = s.span(n)
                        out.append((path, at, to if lines else min(len(s.raw), to + 1), "\n".join(lines)))
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement"])

    importers = t.files.join(statements, "path").select("path", "text", "starts").mapInPandas(run, EDIT)
    return _edits(t.files, edits).union(importers)


# -- micro-rewrites (M10) ------------------------------------------------------------------------------------------------

_OPPOSITE = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE, ast.GtE: ast.Lt, ast.Gt: ast.LtE, ast.LtE: ast.Gt, ast.Is: ast.IsNot, ast.IsNot: ast.Is, ast.In: ast.NotIn, ast.NotIn: ast.In}


def negated(test: ast.expr) -> str:
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        return ast.unparse(test.operand)
    if isinstance(test, ast.Compare) and len(test.ops) == 1:
        return ast.unparse(ast.Compare(test.left, [_OPPOSITE[type(test.ops[0])]()], test.comparators))
    return ast.unparse(ast.UnaryOp(ast.Not(), test))


def rewrite(files: DataFrame, path: str, at: int, kind: str) -> DataFrame:
    """Invert-if, de-morgan or guard-clause at a byte offset."""
    s = _python(files, path)
    if kind == "de-morgan":
        n = s.innermost(at, ast.UnaryOp)
        if n is None or not isinstance(n.op, ast.Not) or not isinstance(n.operand, ast.BoolOp):
            raise Refusal("nothing-to-rewrite", kind)
        other = " or " if isinstance(n.operand.op, ast.And) else " and "
        new = other.join(f"({x})" if " and " in x or " or " in x else x for x in map(negated, n.operand.values))
        return _edits(files, [(path, *s.span(n), f"({new})" if isinstance(s.parent[n], ast.expr) else new)])
    n = s.innermost(at, ast.If)
    if n is None:
        raise Refusal("nothing-to-rewrite", kind)
    a, b = s.span(n)
    indent = " " * n.col_offset
    if kind == "invert-if":
        if not n.orelse or isinstance(n.orelse[0], ast.If) and s.raw[s.span(n.orelse[0])[0] :].startswith(b"elif"):
            raise Refusal("nothing-to-rewrite", "an if with an else, without elif")
        return _edits(files, [(path, a, b, f"if {negated(n.test)}:\n{s.block(n.orelse)}\n{indent}else:\n{s.block(n.body)}")])
    if kind == "guard-clause":
        f = s.parent[n]
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) or f.body[-1] is not n or n.orelse:
            raise Refusal("nothing-to-rewrite", "the last statement of a function, without else")
        body = textwrap.indent(textwrap.dedent(s.block(n.body)), indent)
        return _edits(files, [(path, a, b, f"if {negated(n.test)}:\n{indent}    return\n{body}")])
    raise Refusal("unknown-rewrite", kind)


# -- imports that edits leave unused (M12) -------------------------------------------------------------------------------


def edited(files: DataFrame, planned: DataFrame) -> DataFrame:
    """files with the edits applied."""
    after = apply(planned, files).select("path", "after")
    return cut(files.join(after, "path", "left").withColumn("text", F.coalesce("after", "text")).drop("after"))


def import_edits(files: DataFrame, dead: DataFrame) -> DataFrame:
    """M8: whole-file replacements of Python files without the names (path, name)."""
    lists = dead.where("language = 'python'").groupBy("path").agg(F.collect_set("name").alias("names"))

    def run(batches):
        for batch in batches:
            out = []
            for path, text, names in zip(batch["path"], batch["text"], batch["names"]):
                s, gone, new = _Source(text), set(names), text.encode()
                for n in sorted((x for x in ast.walk(s.tree) if isinstance(x, (ast.Import, ast.ImportFrom))), key=s.span, reverse=True):
                    if getattr(n, "module", None) == "__future__":
                        continue
                    kept = [x for x in n.names if (x.asname or x.name.partition(".")[0] if isinstance(n, ast.Import) else x.asname or x.name) not in gone]
                    if len(kept) == len(n.names):
                        continue
                    a, b = s.span(n)
                    only = isinstance(s.parent[n], ast.Module) or len(s.parent[n].body) > 1
                    n.names = kept
                    if kept or not only:
                        new = new[:a] + (ast.unparse(n) if kept else "pass").encode() + new[b:]
                    else:
                        new = new[: s.line(n)] + new[min(len(new), b + 1) :]
                out.append((path, 0, len(text.encode()), new.decode()))
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement"])

    return files.join(lists, "path").select("path", "text", "names").mapInPandas(run, EDIT)


def sorted_imports(files: DataFrame) -> DataFrame:
    """M8: edits that put each run of neighbouring top-level imports of Python files in order: whole modules first, then by module name."""

    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    s = _Source(text)
                except SyntaxError:
                    continue
                group: list = []
                for n in [*s.tree.body, None]:
                    if isinstance(n, (ast.Import, ast.ImportFrom)) and (not group or n.lineno == group[-1].end_lineno + 1):
                        group.append(n)
                        continue
                    order = sorted(group, key=lambda x: (getattr(x, "module", None) != "__future__", isinstance(x, ast.ImportFrom), s.text(x)))
                    if order != group:
                        out.append((path, s.span(group[0])[0], s.span(group[-1])[1], "\n".join(map(s.text, order))))
                    group = [n] if isinstance(n, (ast.Import, ast.ImportFrom)) else []
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement"])

    return files.where("language = 'python' and text like '%import %'").select("path", "text").mapInPandas(run, EDIT)


def orphaned_imports(workspace, planned: DataFrame) -> DataFrame:
    """Imports (path, language, import_pos, name, module) that are unused after the edits and were used before."""
    after = type(workspace)(edited(workspace.files, planned).select("path", "text"))
    before = unused_imports(workspace.tables, workspace.resolved).select("path", "name", "module")
    return after.unused_imports().select("path", "language", "import_pos", "name", "module").join(before, ["path", "name", "module"], "left_anti")


# -- flags (M9, A16) -----------------------------------------------------------------------------------------------------


def fold(text: str) -> str:
    """Constant conditions folded and branches that can't run removed, one after the other, until nothing changes."""
    for _ in range(10_000):
        s = _Source(text)
        change = _fold_one(s)
        if change is None:
            return text
        a, b, new = change
        text = (s.raw[:a] + new.encode() + s.raw[b:]).decode()
    return text


def _truth(n) -> bool | None:
    return n.value if isinstance(n, ast.Constant) and isinstance(n.value, bool) else None


def _fold_one(s: _Source) -> tuple[int, int, str] | None:
    for n in ast.walk(s.tree):
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not) and (v := _truth(n.operand)) is not None:
            return *s.span(n), str(not v)
        if isinstance(n, ast.BoolOp):
            ends = isinstance(n.op, ast.Or)
            for k, x in enumerate(n.values):
                if (v := _truth(x)) is None:
                    continue
                if v == ends:  # what comes after can't run; what comes before may have effects and stays
                    if k == 0:
                        return *s.span(n), str(v)
                    if k + 1 < len(n.values):
                        return s.span(x)[1], s.span(n.values[-1])[1], ""
                elif k + 1 < len(n.values):
                    return s.span(x)[0], s.span(n.values[k + 1])[0], ""
        if isinstance(n, ast.IfExp) and (v := _truth(n.test)) is not None:
            return *s.span(n), s.text(n.body if v else n.orelse)
        if isinstance(n, ast.If) and (v := _truth(n.test)) is not None:
            a, b = s.span(n)
            taken, indent = n.body if v else n.orelse, " " * n.col_offset
            if s.raw[a : a + 4] == b"elif":
                if v:
                    return a, b, "else:\n" + s.block(n.body)
                if n.orelse and s.raw[s.span(n.orelse[0])[0] :].startswith(b"elif"):
                    return a, s.span(n.orelse[0])[0], ""
                if n.orelse:
                    return a, b, "else:\n" + s.block(n.orelse)
                begin = s.raw.rfind(b"\n", 0, a)
                return begin, b, ""
            if taken and s.raw[s.span(taken[0])[0] :].startswith(b"elif"):
                return a, s.span(taken[0])[0] + 2, ""
            if taken:
                return a, b, textwrap.indent(textwrap.dedent(s.block(taken)), indent)[len(indent) :]
            holder = s.parent[n]
            alone = any(getattr(holder, k, None) == [n] for k in ("body", "orelse", "finalbody")) and not isinstance(holder, ast.Module)
            return (a, b, "pass") if alone else (s.line(n), min(len(s.raw), b + 1), "")
    return None


def _folded(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    new = fold(text)
                except SyntaxError:
                    new = text
                if new != text:
                    out.append((path, 0, len(text.encode()), new))
            yield pd.DataFrame(out, columns=["path", "start", "end", "replacement"])

    return files.where("language = 'python' and (text like '%True%' or text like '%False%')").select("path", "text").mapInPandas(run, EDIT)


def remove_flag(workspace, flag: str, value: bool) -> tuple[DataFrame, list[dict]]:
    """M9: (whole-file edits, a summary of each round, with the number of references that it resolved). Each round does the first that applies: substitute the flag, fold constants, remove symbols that had uses before the cascade and have none now, remove imports that it orphaned."""
    first = workspace
    t = first.tables
    hit = t.symbols.where((F.col("name") == flag) & F.col("kind").isin("constant", "variable") & (F.col("language") == "python"))
    if hit.isEmpty():
        raise Refusal("not-found", flag)
    used = cut(first.resolved.where("target_id is not null and not in_import").select(F.col("target_id").alias("symbol_id")).distinct().join(t.symbols, "symbol_id").select("path", "qualified_name").distinct())
    dead_before = cut(first.unused_imports().select("path", "name", "module"))
    w, rounds = first, []
    for number in range(1, MAX_ROUNDS + 1):
        flags = w.tables.symbols.where((F.col("name") == flag) & F.col("kind").isin("constant", "variable")).select(F.col("symbol_id").alias("target_id"))
        refs = w.resolved.join(flags, "target_id", "left_semi").where("not in_import").where(F.col("confidence") < FIELD)
        held = w.resolved.where("target_id is not null and not in_import").join(w.tables.symbols.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("t_path"), "full_start", "full_end"), "target_id")
        held = held.where("path <> t_path or start < full_start or start >= full_end").select(F.col("target_id").alias("symbol_id")).distinct()
        idle = w.tables.symbols.where("kind in ('function', 'constant', 'variable') and container_id is null and qualifier is null and language = 'python'").join(used, ["path", "qualified_name"], "left_semi").join(held, "symbol_id", "left_anti")
        dead = w.unused_imports().join(dead_before, ["path", "name", "module"], "left_anti")
        steps = [
            ("substitute", lambda: refs.select("path", "start", "end", F.lit(str(value)).alias("replacement"))),
            ("fold", lambda: _folded(w.files.join(first.files.select("path", F.col("text").alias("old")), "path").where("text <> old").drop("old"))),
            ("remove-symbols", lambda: _lines_of(w, idle)),
            ("remove-imports", lambda: import_edits(w.files, dead)),
        ]
        for name, plan in steps:
            planned = cut(plan())
            if not planned.isEmpty():
                break
        else:
            break
        rounds.append({"round": number, "action": name, "edits": planned.count(), "files": planned.select("path").distinct().count(), "resolved": first.resolved.count() if w is first else w.resolved_again.count()})
        # What the round leaves is read and resolved only where it can differ.
        w = w.with_texts(edited(w.files.join(planned.select("path").distinct(), "path", "left_semi"), planned).select("path", F.col("text").alias("after")))
    if not rounds:
        raise Refusal("nothing-to-do", flag)
    before = first.files.select("path", F.col("text").alias("old"))
    out = w.files.join(before, "path").where("text <> old").select("path", F.lit(0).cast("bigint").alias("start"), F.octet_length("old").cast("bigint").alias("end"), F.col("text").alias("replacement"))
    return out, rounds


def _lines_of(w, symbols: DataFrame) -> DataFrame:
    """Edits that remove symbols with the rest of their lines."""
    rows = symbols.join(w.files.select("path", F.col("text").cast("binary").alias("raw")), "path")
    tail = F.decode(F.expr("substring(raw, int(full_end + 1), 3)"), "utf-8")
    return rows.select("path", F.col("full_start").alias("start"), (F.col("full_end") + F.length(F.regexp_extract(tail, r"\A(\n*)", 1))).alias("end"), F.lit("").alias("replacement"))


# -- commit (M15) --------------------------------------------------------------------------------------------------------


def commit(applied: DataFrame, root: str) -> int:
    """Writes the changed files of apply() under a folder of the driver: all are checked against what the plan was made from, then staged beside their places, then renamed."""
    staged, changed_files = [], applied.where("refused is null and before <> after").select("path", "before", "after")
    try:
        for r in changed_files.toLocalIterator():
            at = os.path.join(root, r["path"])
            with open(at, encoding="utf-8", newline="") as f:
                if f.read() != r["before"]:
                    raise Refusal("basis-changed", r["path"])
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(at) or ".", prefix=".codeloom-")
            staged.append((temporary, at))
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
                f.write(r["after"])
            os.chmod(temporary, os.stat(at).st_mode)
    except BaseException:
        for temporary, _ in staged:
            os.unlink(temporary)
        raise
    for temporary, at in staged:
        os.replace(temporary, at)
    return len(staged)


__all__ = ["change_signature", "commit", "edited", "extract_function", "extract_variable", "fold", "import_edits", "inline_variable", "move_symbol", "orphaned_imports", "remove_flag", "rewrite", "safe_deletes"]
