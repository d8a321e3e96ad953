"""Facts of brace languages from one tokenizer: declarations, parameters, blocks, calls, members, imports.

Partial by design: without a grammar, types inside expressions and generics are read as names only. Unbalanced braces
are reported as syntax errors.
"""

from __future__ import annotations

import hashlib
import re

from .base import Facts, tokens_of

_TOKEN = re.compile(r"(?P<text>//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>\d[\w.]*)|(?P<op>::|->|=>|:=|\?\.|[{}()\[\];,.=:<>@#!&|*+/%^~?-])", re.S)
#: Words that declare, by language, as word -> kind.
DECLARE = {
    "go": {"func": "function", "type": "type", "var": "variable", "const": "constant"},
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "let": "variable", "const": "constant", "static": "constant", "mod": "module"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "let": "variable", "var": "variable", "const": "constant", "namespace": "module"},
    "zig": {"fn": "function", "const": "constant", "var": "variable"},
}
DECLARE["tsx"] = DECLARE["typescript"]
#: Words that are never names.
RESERVED = set("if else for while do switch case break continue return new throw try catch finally in instanceof typeof void delete yield await async public private protected static final abstract override export default import package use pub mut self this super impl match loop where as dyn ref move unsafe extern crate defer fallthrough interface struct func var const type let fn enum trait class extends implements true false null nil undefined None Some and or orelse comptime inline errdefer usingnamespace readonly declare namespace function".split())


def extract(f: Facts) -> None:
    tokens = tokens_of(f.text, _TOKEN)
    for kind, _, a, b in tokens:
        if kind == "text":
            f.say(a, b)
    code = [x for x in tokens if x[0] != "text" or x[1][0] in "\"'`"]
    words = DECLARE[f.language]
    close = _pairs(f, code)
    _imports(f)
    taken: set[int] = set()
    for i, (kind, text, a, b) in enumerate(code):
        if kind != "name" or any(m["start"] <= a < m["end"] for m in f.import_rows):
            continue
        before = code[i - 1][1] if i else ""
        after = code[i + 1][1] if i + 1 < len(code) else ""
        if after == ":=" and text not in RESERVED and before not in (".",):
            stop = next((k for k in range(i, len(code) - 1) if "\n" in f.text[code[k][3] : code[k + 1][2]]), len(code) - 1)
            f.define(text, "variable", a, a, code[stop][3])
            taken.add(i)
            if i + 2 < len(code):
                f.flow(a, code[i + 2][2], code[stop][3])
        elif text in words and i + 1 < len(code) and before not in (".", "::") and not (text == "func" and i and "\n" not in f.text[code[i - 1][3] : a] and before != ";"):  # Go also writes func for literals and types
            _declare(f, code, close, i, words[text], taken)
        elif f.language == "rust" and text == "impl":
            _impl(f, code, close, i)
        elif after == "(" and text not in RESERVED and i not in taken and close.get(i + 1) is not None:
            end = close[i + 1]
            follows = code[end + 1][1] if end + 1 < len(code) else ""
            body = _body(code, end + 1)
            member = f.language in ("java", "typescript", "tsx") and (follows == "{" or follows == ":" and body is not None or follows == "throws") and before not in (".", "new", "=", "(", ",", "return", "=>", "await") and _in_type(f, a)
            if member:
                _callable(f, code, close, i, i, taken, exported=_has(code, i, "public") or f.language != "java" and not _has(code, i, "private"))
    for i, (kind, text, a, b) in enumerate(code):
        if kind != "name" or i in taken or text in RESERVED or any(m["start"] <= a < m["end"] for m in f.import_rows):
            continue
        before = code[i - 1][1] if i else ""
        after = code[i + 1][1] if i + 1 < len(code) else ""
        if before in (".", "::", "?.") and i >= 2:
            receiver = code[i - 2][1] if code[i - 2][0] == "name" else "()"
            f.refer(text, "call" if after == "(" else "field", a, receiver, before == "::")
        elif after == "(" or after == "!" and f.language == "rust":
            f.refer(text, "call", a)
        else:
            f.refer(text, "type" if text[0].isupper() else "identifier", a)
    _subtrees(f, code, close)


def _pairs(f: Facts, code) -> dict[int, int]:
    match, stack, out = {"(": ")", "[": "]", "{": "}"}, [], {}
    for i, (kind, text, a, b) in enumerate(code):
        if kind == "op" and text in match:
            stack.append(i)
        elif kind == "op" and text in ")]}":
            if not stack or match[code[stack[-1]][1]] != text:
                f.error(a)
                continue
            j = stack.pop()
            out[j] = i
            if text == "}":
                f.scope(code[j][2], b)
    for j in stack:
        f.error(code[j][2])
    return out


def _has(code, i: int, word: str) -> bool:
    for _, text, _, _ in reversed(code[max(0, i - 6) : i]):
        if text in ";{}":
            return False
        if text == word:
            return True
    return False


def _in_type(f: Facts, at: int) -> bool:
    inside = [c for c in f.containers if c[0] <= at < c[1]]
    if not inside:
        return False
    a, b, _ = min(inside, key=lambda c: c[1] - c[0])
    return not any(a < d["at"] and d["start"] <= at < d["end"] and d["kind"] in ("function", "method") for d in f.definitions)


def _body(code, i: int) -> int | None:
    for j in range(i, min(i + 40, len(code))):
        if code[j][1] == "{":
            return j
        if code[j][1] in ";}=":
            return None
    return None


def _exported(f: Facts, code, i: int, name: str) -> bool:
    return name[:1].isupper() if f.language == "go" else _has(code, i, {"rust": "pub", "zig": "pub", "java": "public"}.get(f.language, "export"))


def _begin(f: Facts, code, i: int) -> int:
    j = i
    while j and code[j - 1][0] == "name" and code[j - 1][1] in RESERVED and code[j - 1][1] not in ("return", "else"):
        j -= 1
    return code[j][2]


def _declare(f: Facts, code, close, i: int, kind: str, taken: set[int]) -> None:
    j, owner = i + 1, None
    if f.language == "go" and kind == "function" and code[j][1] == "(":  # a receiver names the type
        end = close.get(j, j)
        bracket = next((k for k in range(j, end) if code[k][1] == "["), end)  # type parameters follow the type's name
        names = [k for k in range(j, bracket) if code[k][0] == "name"]
        owner = code[names[-1]][1] if names else None
        if len(names) > 1:
            f.define(code[names[0]][1], "parameter", code[names[0]][2])
            taken.add(names[0])
        j = end + 1
    while j < len(code) and code[j][1] in ("mut", "*", "async"):
        j += 1
    if j >= len(code) or code[j][0] != "name" or code[j][1] in RESERVED and code[j][1] not in ("get", "set", "test"):
        return
    name, at = code[j][1], code[j][2]
    if kind == "function":
        _callable(f, code, close, i, j, taken, owner, _exported(f, code, i, name))
        return
    if kind in ("constant", "variable") and (arrow := next((k for k in range(j + 1, min(j + 12, len(code))) if code[k][1] == "=>"), None)) and code[j + 1][1] in "=:" and not any(code[k][1] == ";" for k in range(j, arrow)):
        opened = next((k for k in range(j + 1, arrow) if code[k][1] == "("), None)
        body = arrow + 1
        end = code[close[body]][3] if body in close else code[min(body, len(code) - 1)][3]
        f.define(name, "function", at, _begin(f, code, i), end, _exported(f, code, i, name))
        taken.add(j)
        if opened is not None and opened in close:
            _parameters(f, code, opened, close[opened], taken)
            f.scope(code[opened][2], end)
        return
    body = _body(code, j + 1) if kind not in ("variable",) else None
    if f.language == "zig" and body is None and j + 3 < len(code) and code[j + 1][1] == "=" and code[j + 2][1] in ("struct", "enum", "union"):
        body = _body(code, j + 2)
    stop = next((k for k in range(j, len(code)) if code[k][1] == ";" or k > j and f.text.count("\n", code[k - 1][3], code[k][2]) and code[k - 1][1] not in ",{([=|&.+"), len(code) - 1)
    holder = kind in ("class", "struct", "trait", "interface", "enum", "module") or f.language == "go" and kind == "type" or f.language == "zig" and body is not None and code[body - 1][1] in ("struct", "enum", "union")
    if f.language == "go" and kind == "type" and j + 1 < len(code) and code[j + 1][1] in ("struct", "interface"):
        kind = code[j + 1][1]
    if f.language == "zig" and holder:
        kind = "enum" if code[body - 1][1] == "enum" else "struct"
    end = code[close[body]][3] if holder and body in close else code[max(j, stop - 1)][3]
    f.define(name, kind, at, _begin(f, code, i), end, _exported(f, code, i, name))
    taken.add(j)
    if kind in ("variable", "constant"):
        eq = next((k for k in range(j + 1, min(stop + 1, len(code))) if code[k][1] in ("=", ":=")), None)
        if eq is not None and eq + 1 < len(code):
            f.flow(at, code[eq + 1][2], code[max(eq + 1, stop - 1)][3])
    if holder and body in close:
        f.scope(code[body][2], code[close[body]][3], name)
        for k in range(j + 1, body):
            if code[k][1] in ("extends", "implements", ":") or code[k - 1][1] in ("extends", "implements", ",", ":"):
                if code[k][0] == "name" and code[k][1] not in RESERVED:
                    f.supertypes.append((name, code[k][1]))
        _fields(f, code, close, body, kind, taken)


def _callable(f: Facts, code, close, i: int, j: int, taken: set[int], owner: str | None = None, exported: bool = False) -> None:
    name, at = code[j][1], code[j][2]
    opened = next((k for k in range(j + 1, min(j + 30, len(code))) if code[k][1] == "("), None)
    if opened is None or opened not in close:
        return
    body = _body(code, close[opened] + 1)
    end = code[close[body]][3] if body in close else code[close[opened]][3]
    f.define(name, "function", at, _begin(f, code, i), end, exported)
    if owner:
        f.definitions[-1]["own_qualifier"] = owner
        if f.language == "go":
            _go_signature(f, code, close, at, opened, body)
    taken.add(j)
    _parameters(f, code, opened, close[opened], taken)
    f.scope(code[opened][2], end)
    k = i - 1
    while k >= 0 and code[k][0] == "name" and code[k][1] in RESERVED:
        k -= 1
    if k >= 1 and code[k][0] == "name" and code[k - 1][1] == "@":
        f.note(at, code[k][1])


def _parameters(f: Facts, code, a: int, b: int, taken: set[int]) -> None:
    first, depth = True, 0
    for k in range(a + 1, b):
        kind, text, at, _ = code[k]
        depth += (text in "([{<") - (text in ")]}>") if kind == "op" and len(text) == 1 else 0
        if kind == "op" and text == "," and depth == 0:
            first = True
        elif kind == "name" and first and text not in ("mut", "final", "comptime", "readonly", "public", "private"):
            if f.language == "java":  # the name is the last of its part
                last = next((m - 1 for m in range(k, b + 1) if m == b or code[m][1] == ","), k)
                k, text, at = last, code[last][1], code[last][2]
            if text not in RESERVED:
                f.define(text, "parameter", at)
                taken.add(k)
            first = False


def _parts(code, a: int, b: int) -> list[list[str]]:
    """The tokens between two brackets, by commas outside further brackets."""
    parts, depth = [[]], 0
    for _, text, _, _ in code[a + 1 : b]:
        depth += (text in "([{") - (text in ")]}") if len(text) == 1 else 0
        if text == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(text)
    return [x for x in parts if x]


def _go_type(tokens: list[str]) -> str | None:
    """A type without package names and spaces; null where it holds types that are written out on the spot."""
    if {"func", "struct", "interface"} & set(tokens) and tokens[-3:] != ["interface", "{", "}"]:
        return None
    kept = [x for i, x in enumerate(tokens) if not (i + 2 < len(tokens) and tokens[i + 1] == "." and x.isidentifier() and tokens[i + 2].isidentifier())]
    return "".join(x for i, x in enumerate(kept) if not (x == "." and i + 1 < len(kept) and kept[i + 1].isidentifier() and (i == 0 or kept[i - 1] != ".")))


def _go_types(parts: list[list[str]]) -> list[str | None]:
    """One type for each parameter: `a, b int` are two of them, and names don't count."""
    names = [p[0].isidentifier() and p[0] not in ("map", "chan", "func", "interface", "struct") and (len(p) > 1 and (p[1] != "." or p[1:4] == [".", ".", "."])) for p in parts]
    if not any(names):
        return [_go_type(p) for p in parts]
    out: list[str | None] = []
    after = None
    for p, named in zip(reversed(parts), reversed(names)):
        after = _go_type(p[1:]) if named else after
        out.append(after)
    return out[::-1]


def _go_signature(f: Facts, code, close, at: int, opened: int, body: int | None) -> None:
    """Notes the number of a method's parameters and, where all of its types can be read, its signature."""
    types = _go_types(_parts(code, opened, close[opened]))
    f.note(at, "@arity", str(len(types)))
    k = close[opened] + 1
    stop = k
    while stop < len(code) and stop != body and code[stop][1] not in ";}" and (body is not None or "\n" not in f.text[code[stop - 1][3] : code[stop][2]]):
        stop = close.get(stop, stop) + 1
    result = [x[1] for x in code[k:stop]]
    if result[:1] == ["("] and close.get(k) == stop - 1:
        gives = _go_types(_parts(code, k, stop - 1))
    else:
        gives = [_go_type(result)] if result else []
    if None not in types and None not in gives:
        f.note(at, "@signature", f"({','.join(types)}) {','.join(gives)}")


def _fields(f: Facts, code, close, body: int, kind: str, taken: set[int]) -> None:
    k, end = body + 1, close[body]
    while k < end:
        text, after = code[k][1], code[k + 1][1]
        if code[k][1] in "([{" and code[k][0] == "op":
            k = close.get(k, k) + 1
            continue
        begins = code[k - 1][1] in ("{", ";", ",", "}") or f.language in ("go", "typescript", "tsx") and "\n" in f.text[code[k - 1][3] : code[k][2]] or _has(code, k, "pub")
        if code[k][0] == "name" and text not in RESERVED and begins and kind not in ("enum", "module"):
            script = f.language in ("typescript", "tsx")
            maybe = script and after == "?" and code[k + 2][1] == ":"
            plain = after == ":" or maybe or f.language == "go" and (code[k + 1][0] == "name" or after in "*[") or f.language == "java" and False
            if plain:
                f.define(text, "field", code[k][2], code[k][2], code[k + 1][3], text[:1].isupper() if f.language == "go" else True)
                taken.add(k)
                if script:
                    stop = begin = k + 2 + maybe
                    angles = 0
                    while stop < end and code[stop][1] != ";" and (code[stop][1] != "," or angles) and (angles or stop == begin or "\n" not in f.text[code[stop - 1][3] : code[stop][2]] or code[stop][1] == "|"):
                        angles += (code[stop][1] == "<") - (code[stop][1] == ">" and angles > 0)
                        stop = close.get(stop, stop) + 1
                    f.note(code[k][2], "@declares", f.text[code[begin][2] : code[stop - 1][3]] if stop > begin else None)
                    if maybe:
                        f.note(code[k][2], "@optional")
            elif after == "(" and kind == "interface":
                f.define(text, "method", code[k][2], code[k][2], code[close.get(k + 1, k + 1)][3], True)
                taken.add(k)
                if f.language == "go" and k + 1 in close:
                    _go_signature(f, code, close, code[k][2], k + 1, None)
        elif f.language == "java" and code[k][0] == "name" and after in ("=", ";") and code[k - 1][0] == "name" and text not in RESERVED:
            f.define(text, "field", code[k][2], code[k - 1][2], code[k + 1][3], _has(code, k, "public"))
            taken.add(k)
        elif kind == "enum" and code[k][0] == "name" and code[k - 1][1] in ("{", ",") and text not in RESERVED:
            f.define(text, "constant", code[k][2], exported=True)
            taken.add(k)
        k += 1


def _impl(f: Facts, code, close, i: int) -> None:
    body = _body(code, i + 1)
    if body not in close:
        return
    names = [code[k][1] for k in range(i + 1, body) if code[k][0] == "name" and (code[k][1] not in RESERVED or code[k][1] == "for")]
    if "for" in names:
        k = names.index("for")
        if k and k + 1 < len(names):
            f.supertypes.append((names[k + 1], names[k - 1]))
            f.scope(code[body][2], code[close[body]][3], names[k + 1])
    elif names:
        f.scope(code[body][2], code[close[body]][3], names[0])


_IMPORTS = {
    "go": re.compile(r"import\s+(?:(?P<alias>[\w.]+)\s+)?\"(?P<m>[^\"]+)\"|import\s*\((?P<block>[^)]*)\)"),
    "rust": re.compile(r"(?:pub\s+)?use\s+(?P<m>[\w:]+?)(?:::\{(?P<names>[^}]*)\}|::(?P<glob>\*)|\s+as\s+(?P<alias>\w+))?\s*;"),
    "java": re.compile(r"import\s+(?:static\s+)?(?P<m>[\w.]+?)(?:\.(?P<glob>\*))?\s*;"),
    "typescript": re.compile(r"(?:import|export)\s+(?:type\s+)?(?:(?P<alias>\w+)\s*,?\s*)?(?:\*\s+as\s+(?P<space>\w+)\s*|\{(?P<names>[^}]*)\}\s*|(?P<glob>\*)\s*)?from\s*['\"](?P<m>[^'\"]+)['\"]"),
    "zig": re.compile(r"const\s+(?P<alias>\w+)\s*=\s*@import\(\"(?P<m>[^\"]+)\"\)\s*;"),
}
_IMPORTS["tsx"] = _IMPORTS["typescript"]


def _imports(f: Facts) -> None:
    for m in _IMPORTS[f.language].finditer(f.text):
        g, a, b = m.groupdict(), m.start(), m.end()
        if g.get("block") is not None:
            for x in re.finditer(r"(?:([\w.]+)\s+)?\"([^\"]+)\"", g["block"]):
                local = x[1] or x[2].rpartition("/")[2]
                f.import_(x[2], a, b, [(x[2].rpartition("/")[2], local, m.start("block") + x.start(2))], x[1], x[1] == ".")
            continue
        module, names = g["m"], []
        if g.get("names"):
            for x in re.finditer(r"(\w+)(?:\s+as\s+(\w+))?", g["names"]):
                if x[1] not in ("type", "self"):
                    names.append((x[1], x[2] or x[1], m.start("names") + x.start(1)))
                    f.refer(x[1], "identifier", m.start("names") + x.start(1), in_import=True)
        alias = g.get("space") or g.get("alias")
        if f.language in ("rust", "java") and not names and not g.get("glob"):
            parts = re.split(r"::|\.", module)
            at = m.start("m") + len(module) - len(parts[-1])
            names, module = [(parts[-1], alias or parts[-1], at)], module[: len(module) - len(parts[-1])].rstrip(":.")
            f.refer(parts[-1], "identifier", at, in_import=True)
        elif f.language == "go":
            names = [(module.rpartition("/")[2], alias or module.rpartition("/")[2], m.start("m"))]
        elif alias and f.language in ("typescript", "tsx", "zig"):
            names.append(("default" if not g.get("space") and f.language != "zig" else "*", alias, a))
        f.import_(module, a, b, names, alias, bool(g.get("glob")))


def _subtrees(f: Facts, code, close) -> None:
    """Blocks in braces, by the kinds of their tokens; names and literals don't count."""
    depth = 0
    kinds = [text if kind == "op" or text in RESERVED else kind for kind, text, _, _ in code]
    for i, (_, text, a, _) in enumerate(code):
        if text == "{" and i in close:
            depth += 1
            j = close[i]
            if 20 <= j - i <= 4000:
                h = hashlib.blake2b(" ".join(kinds[i : j + 1]).encode(), digest_size=12).hexdigest()
                f.subtrees.append((h, j - i + 1, depth, a, code[j][3]))
        elif text == "}":
            depth -= 1
