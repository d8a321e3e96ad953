"""Python facts, from the standard library's own parser."""

from __future__ import annotations

import ast
import io
import tokenize

from .base import Facts


def extract(f: Facts) -> None:
    lines = f.text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    raw = [line.encode("utf-8") for line in lines]

    def at(line: int, col: int) -> int:
        if line > len(lines):
            return len(f.text)
        return starts[line - 1] + (col if lines[line - 1].isascii() else len(raw[line - 1][:col].decode("utf-8", "ignore")))

    def span(n) -> tuple[int, int]:
        return at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)

    _texts(f, starts)
    tree = ast.parse(f.text)

    def named(n, name: str, after: int) -> int:
        return f.text.find(name, after)

    def typed(place: int, value) -> None:
        if (said := _value(value)) is not None:
            f.note(place, "@value", said)

    def bind(target, kind: str, stmt, value=None) -> None:
        for x in ast.walk(target):
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                a, b = span(stmt)
                place = span(x)[0]
                f.define(x.id, kind, place, a, b, kind != "variable" and not x.id.startswith("_"))
                if value is not None:
                    f.flow(place, *span(value))
                if isinstance(stmt, ast.AnnAssign):
                    f.note(place, "@declares", ast.unparse(stmt.annotation))
                if value is not None and x is target:
                    typed(place, value if stmt is not target else _element(value))

    def visit(n, inside: str | None, top: bool, guard: bool = False) -> None:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a, b = span(n)
            first = at(n.decorator_list[0].lineno, n.decorator_list[0].col_offset) - 1 if n.decorator_list else a
            place = named(n, n.name, a + len("async def" if isinstance(n, ast.AsyncFunctionDef) else "def"))
            f.define(n.name, "method" if inside else "function", place, first, b, not n.name.startswith("_"))
            for d in n.decorator_list:
                call = d.func if isinstance(d, ast.Call) else d
                arg = d.args[0].value if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) else None
                f.note(place, ast.unparse(call), arg)
                visit(d, None, top)
            f.scope(place + len(n.name), b)
            if n.returns:
                f.note(place, "@declares", ast.unparse(n.returns))
            for p in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))]:
                f.define(p.arg, "parameter", *(span(p)[0], *span(p)))
                if p.annotation:
                    f.note(span(p)[0], "@declares", ast.unparse(p.annotation))
                    visit(p.annotation, None, False)
            for x in [*n.args.defaults, *filter(None, n.args.kw_defaults), *([n.returns] if n.returns else [])]:
                visit(x, None, False)
            for x in n.body:
                visit(x, None, False)
            return
        if isinstance(n, ast.ClassDef):
            a, b = span(n)
            place = named(n, n.name, a + 5)
            f.define(n.name, "class", place, a, b, not n.name.startswith("_"))
            for d in n.decorator_list:
                f.note(place, ast.unparse(d.func if isinstance(d, ast.Call) else d))
                visit(d, None, top)
            for x in n.bases:
                if isinstance(x, (ast.Name, ast.Attribute)):
                    f.supertypes.append((n.name, ast.unparse(x).rpartition(".")[2]))
                visit(x, None, top)
            f.scope(place + len(n.name), b, n.name)
            for x in n.body:
                if isinstance(x, (ast.Assign, ast.AnnAssign)):
                    for target in x.targets if isinstance(x, ast.Assign) else [x.target]:
                        if isinstance(target, ast.Name):
                            f.define(target.id, "field", span(target)[0], *span(x), not target.id.startswith("_"))
                            if isinstance(x, ast.AnnAssign):
                                f.note(span(target)[0], "@declares", ast.unparse(x.annotation))
                            if x.value is not None:
                                typed(span(target)[0], x.value)
                    for y in filter(None, (x.value, getattr(x, "annotation", None))):
                        visit(y, None, False)
                else:
                    visit(x, n.name, False)
            return
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            a, b = span(n)
            if isinstance(n, ast.Import):
                for x in n.names:
                    p = span(x)[0]
                    f.import_(x.name, a, b, [(x.name, x.asname or x.name.partition(".")[0], p)], x.asname)
            else:
                module = "." * n.level + (n.module or "")
                glob = any(x.name == "*" for x in n.names)
                f.import_(module, a, b, [(x.name, x.asname or x.name, span(x)[0]) for x in n.names if x.name != "*"], None, glob)
                for x in n.names:
                    if x.name != "*":
                        f.refer(x.name, "identifier", span(x)[0], in_import=True)
            return
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if not isinstance(n, ast.AugAssign):
                    bind(target, "constant" if top and isinstance(target, ast.Name) and target.id.isupper() else "variable", n, n.value)
                for x in ast.walk(target):
                    if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self":
                        f.define(x.attr, "field", span(x)[1] - len(x.attr), *span(n), not x.attr.startswith("_"))
                        f.definitions[-1]["own_qualifier"] = owner[-1] if owner else None
                    elif isinstance(x, (ast.Attribute, ast.Subscript)) or isinstance(n, ast.AugAssign):
                        visit(x, None, top)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
            bind(n.target, "variable", n.target, n.iter)
        elif isinstance(n, ast.withitem) and n.optional_vars is not None:
            bind(n.optional_vars, "variable", n.optional_vars, n.context_expr)
        elif isinstance(n, ast.ExceptHandler) and n.name:
            f.define(n.name, "variable", named(n, n.name, span(n)[0] + 6))
        elif isinstance(n, ast.Lambda):
            f.scope(*span(n))
            for p in n.args.args:
                f.define(p.arg, "parameter", span(p)[0])
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            _name(f, n.func, "call", span)
            for x in [n.func.value] if isinstance(n.func, ast.Attribute) else []:
                visit(x, None, top)
            for x in [*n.args, *(k.value for k in n.keywords)]:
                visit(x, None, top)
            return
        elif isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load):
            _name(f, n, "field", span)
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
            f.refer(n.id, "identifier", span(n)[0])
        if isinstance(n, ast.If) and top and ast.unparse(n.test).replace('"', "'") == "__name__ == '__main__'":
            for x in ast.walk(n):
                if isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                    f.note(-1, "main-guard", x.func.id)
        for x in ast.iter_child_nodes(n):
            visit(x, None, top and isinstance(n, (ast.If, ast.Try, ast.Module, ast.ExceptHandler)))

    owner: list[str] = []

    def walk(body, inside):
        for x in body:
            if isinstance(x, ast.ClassDef):
                owner.append(x.name)
                visit(x, inside, True)
                owner.pop()
            else:
                visit(x, inside, True)

    walk(tree.body, None)
    _subtrees(f, tree, span, 0)


def _literal(v) -> str | None:
    if isinstance(v, ast.Constant):
        return type(v.value).__name__ if v.value is not None else "None"
    if isinstance(v, ast.UnaryOp) and isinstance(v.op, (ast.USub, ast.UAdd)):
        return _literal(v.operand)
    kinds = {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Tuple: "tuple", ast.ListComp: "list", ast.DictComp: "dict", ast.SetComp: "set", ast.JoinedStr: "str"}
    return kinds.get(type(v))


def _value(v) -> str | None:
    """What an expression says of its type: literal|t, both|t, call|name, name|name or member|name."""
    if (t := _literal(v)) is not None:
        return f"literal|{t}"
    if isinstance(v, ast.BinOp) and (t := _literal(v.left)) is not None and t == _literal(v.right):
        return f"both|{t}"
    if isinstance(v, ast.Call):
        return f"call|{ast.unparse(v.func).rpartition('.')[2]}" if isinstance(v.func, (ast.Name, ast.Attribute)) else None
    if isinstance(v, ast.Name):
        return f"name|{v.id}"
    return f"member|{v.attr}" if isinstance(v, ast.Attribute) else None


def _element(v):
    """An element that stands for all of a literal sequence, if they have one type."""
    if isinstance(v, (ast.List, ast.Tuple, ast.Set)) and v.elts and len({_literal(x) for x in v.elts}) == 1:
        return v.elts[0]
    return ast.Yield()


def _name(f: Facts, n, kind: str, span) -> None:
    if isinstance(n, ast.Name):
        f.refer(n.id, kind, span(n)[0])
    else:
        receiver = n.value.id if isinstance(n.value, ast.Name) else ast.unparse(n.value).rpartition(".")[2] if isinstance(n.value, ast.Attribute) else "()"
        f.refer(n.attr, kind, span(n)[1] - len(n.attr), receiver)


def _subtrees(f: Facts, n, span, depth: int) -> tuple[str, int]:
    """Names and literals don't count, so renamed copies have equal hashes."""
    children = [_subtrees(f, x, span, depth + 1) for x in ast.iter_child_nodes(n) if not isinstance(x, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]
    tokens = 1 + sum(c[1] for c in children)
    parts = [type(n).__name__, *(type(getattr(n, k)).__name__ for k in ("op",) if hasattr(n, k)), *(c[0] for c in children)]
    if hasattr(n, "lineno") and tokens >= 20:
        return f.subtree(parts, tokens, depth, *span(n)), tokens
    import hashlib

    return hashlib.blake2b("\0".join(parts).encode(), digest_size=12).hexdigest(), tokens


def _texts(f: Facts, starts: list[int]) -> None:
    try:
        for tok in tokenize.generate_tokens(io.StringIO(f.text).readline):
            if tok.type in (tokenize.STRING, tokenize.COMMENT, getattr(tokenize, "FSTRING_MIDDLE", -1)):
                f.say(starts[tok.start[0] - 1] + tok.start[1], starts[tok.end[0] - 1] + tok.end[1])
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
