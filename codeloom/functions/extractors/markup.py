"""Facts of HTML, XML, Markdown and CSS."""

from __future__ import annotations

import re

from .base import Facts

_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[A-Za-z][\w:.-]*)(?P<attrs>(?:\s+[^\s=<>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\s*/)*)\s*(?P<end>/?)>")
_ATTR = re.compile(r"(?P<name>[^\s=<>/\"']+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+))")
#: Attributes whose values are ids of elements.
ID_REFS = ["for", "aria-labelledby", "aria-describedby", "aria-controls", "list", "headers", "form"]


def split_values(value: str, at: int):
    """(word, offset) of every word between white space and commas."""
    for m in re.finditer(r"[^\s,]+", value):
        yield m.group(), at + m.start()


def _value(m: re.Match) -> tuple[str, int]:
    name = "a" if m["a"] is not None else "b" if m["b"] is not None else "c"
    return m[name], m.start(name)


def html(f: Facts) -> None:
    for m in re.finditer(r"<!--.*?-->", f.text, re.S):
        f.say(*m.span())
    for m in _TAG.finditer(f.text):
        if m["close"]:
            continue
        base = m.start("attrs")
        for x in _ATTR.finditer(m["attrs"]):
            (value, at), name = _value(x), x["name"].lower()
            at += base
            f.say(at, at + len(value))
            if name == "id" and value.strip():
                f.define(value.strip(), "element-id", at + value.index(value.strip()), m.start(), m.end(), True)
            elif name in ("class", "classname"):
                for word, place in split_values(value, at):
                    f.refer(word, "string-ref", place, expects="selector")
            elif name.startswith("data-"):
                f.define(name, "data-attribute", base + x.start("name"), m.start(), m.end(), True)
            elif name in ID_REFS:
                for word, place in split_values(value, at):
                    f.refer(word, "string-ref", place, expects="element-id")
            elif name == "href" and "://" not in value and "#" in value and value.split("#", 1)[1]:
                part = value.split("#", 1)[1]
                f.refer(part, "string-ref", at + value.index("#") + 1, expects="element-id")
            elif name == "src" or name == "href" and m["tag"].lower() == "link":
                f.import_(value, m.start(), m.end())


def xml(f: Facts) -> None:
    stack: list[tuple[str, int]] = []
    for m in _TAG.finditer(f.text):
        if m["close"]:
            if not stack or stack[-1][0] != m["tag"]:
                f.error(m.start())
            else:
                f.scope(stack.pop()[1], m.end())
            continue
        for x in _ATTR.finditer(m["attrs"]):
            value, at = _value(x)
            at += m.start("attrs")
            f.say(at, at + len(value))
            if x["name"] in ("id", "xml:id") and value:
                f.define(value, "element-id", at, m.start(), m.end(), True)
            elif x["name"] in ("ref", "idref") and value:
                f.refer(value, "string-ref", at, expects="element-id")
        if not (m["end"] or m["attrs"].rstrip().endswith("/")):
            stack.append((m["tag"], m.start()))
    for _, at in stack:
        f.error(at)


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.M)
_LINK_DEF = re.compile(r"^[ ]{0,3}\[([^\]\n]+)\]:[ \t]*(\S+)", re.M)
_LINK = re.compile(r"\[[^\]\n]*\]\(([^)\s]+)[^)]*\)")
_LINK_REF = re.compile(r"\[([^\]\n]+)\]\[([^\]\n]*)\]")


def markdown(f: Facts) -> None:
    fenced = [m.span() for m in re.finditer(r"^```.*?^```[ \t]*$", f.text, re.M | re.S)]
    free = lambda at: not any(a <= at < b for a, b in fenced)
    heads = [m for m in _HEADING.finditer(f.text) if free(m.start())]
    for i, m in enumerate(heads):
        end = next((x.start() for x in heads[i + 1 :] if len(x[1]) <= len(m[1])), len(f.text))
        if m[2]:
            f.define(m[2], "heading", m.start(2), m.start(), end, True)
            f.scope(m.start(), end)
    for m in _LINK_DEF.finditer(f.text):
        if free(m.start()):
            f.define(m[1], "link-def", m.start(1), *m.span(), True)
    for m in _LINK.finditer(f.text):
        target = m[1]
        if free(m.start()) and "://" not in target and (part := target.split("#", 1)[1] if "#" in target else target):
            f.refer(part, "string-ref", m.start(1) + (target.index("#") + 1 if "#" in target else 0), expects="heading" if "#" in target else None)
    for m in _LINK_REF.finditer(f.text):
        name, group = (m[2], 2) if m[2] else (m[1], 1)
        if free(m.start()):
            f.refer(name, "string-ref", m.start(group), expects="link-def")
    for m in re.finditer(r"[^\n]+", f.text):
        f.say(*m.span())


_CSS = re.compile(r"(?P<comment>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<string>\"[^\"\n]*\"|'[^'\n]*')|(?P<open>\{)|(?P<close>\})|(?P<semi>;)", re.S)


def specificity(selector: str) -> tuple[int, int, int]:
    """Ids, classes, elements; :where counts nothing and :is, :not and :has count their strongest argument."""
    ids = classes = elements = 0
    while m := re.search(r":(is|not|has|where|matches)\(([^()]*)\)", selector):
        if m[1] != "where":
            a, b, c = max(map(specificity, m[2].split(",")))
            ids, classes, elements = ids + a, classes + b, elements + c
        selector = selector[: m.start()] + selector[m.end() :]
    selector, n = re.subn(r"::[\w-]+(?:\([^)]*\))?", " ", selector)
    elements += n
    ids += len(re.findall(r"#[\w-]+", selector))
    classes += len(re.findall(r"\.[\w-]+|\[[^\]]*\]|:[\w-]+(?:\([^)]*\))?", selector))
    elements += len(re.findall(r"(?<![\w#.:\[-])[A-Za-z][\w-]*", re.sub(r"\[[^\]]*\]|[#.:][\w-]+(?:\([^)]*\))?", " ", selector)))
    return ids, classes, elements


def declarations(text: str) -> list[dict]:
    """Every declaration with its selector, specificity, layer, conditions and importance; layers are numbered as they appear, unlayered last."""
    out, stack, start, layers = [], [], 0, {}
    masked = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    for m in _CSS.finditer(masked):
        kind = m.lastgroup
        if kind == "open":
            stack.append((masked[start : m.start()].strip(), start))
            start = m.end()
        elif kind in ("semi", "close"):
            body = masked[start : m.start()]
            if ":" in body and stack and not stack[-1][0].startswith("@") and (d := re.match(r"\s*([\w-]+)\s*:\s*(.*?)\s*$", body, re.S)):
                important = bool(re.search(r"!\s*important\s*$", d[2]))
                value = re.sub(r"\s*!\s*important\s*$", "", d[2])
                layer = next((x[0][6:].strip() for x in stack if x[0].startswith("@layer")), None)
                chain = [x[0] for x in stack if not x[0].startswith("@")]
                selector = chain[0] if len(chain) == 1 else " ".join(chain)
                for one in selector.split(","):
                    out.append({"property": d[1], "value": value, "selector": one.strip(), "specificity": specificity(one), "important": important, "layer": 1_000_000 if layer is None else layers.setdefault(layer, len(layers)), "conditions": [x[0] for x in stack if re.match(r"@(media|supports|container)", x[0])], "start": start + d.start(1)})
            elif body.strip().startswith("@layer"):
                for name in body.strip()[6:].split(","):
                    layers.setdefault(name.strip(), len(layers))
            start = m.end()
            if kind == "close" and stack:
                stack.pop()
    return out


def css(f: Facts) -> None:
    text = f.text
    if f.language == "scss":
        text = re.sub(r"#\{[^{}]*\}", lambda m: "x" * len(m.group()), text)  # X3: interpolations as names of equal length
        for m in re.finditer(r"#\{([^{}]*)\}", f.text):
            for x in re.finditer(r"\$[\w-]+", m[1]):
                f.refer(x.group(), "identifier", m.start(1) + x.start())
    stack, start, depth = [], 0, 0
    for m in _CSS.finditer(text):
        kind = m.lastgroup
        if kind in ("comment", "string") or kind == "line" and f.language == "scss":
            f.say(*m.span())
            if kind != "string":
                start = m.end() if not text[start : m.start()].strip() else start
        elif kind == "open":
            stack.append((start, m.start()))
            head = text[start : m.start()]
            if not head.lstrip().startswith("@"):
                for x in re.finditer(r"([.#])(-?[A-Za-z_][\w-]*)", head):
                    end = _close(text, m.start())
                    f.define(x[2], "selector", start + x.start(2), start, end, True)
            elif x := re.match(r"\s*@mixin\s+([\w-]+)", head):
                f.define(x[1], "function", start + x.start(1), start, _close(text, m.start()), True)
            f.scope(start, _close(text, m.start()))
            depth += 1
            start = m.end()
        elif kind in ("semi", "close"):
            body, at = text[start : m.start()], start
            if x := re.match(r"\s*(--[\w-]+|\$[\w-]+)\s*:\s*", body):
                f.define(x[1], "property" if x[1].startswith("--") else "variable", at + x.start(1), at + x.start(1), m.start(), True)
                f.flow(at + x.start(1), at + x.end(), m.start())
                body, at = body[x.end() :], at + x.end()
            if x := re.match(r"\s*@(import|use|forward)\s+(?:url\()?['\"]([^'\"]+)", body):
                f.import_(x[2], start, m.end(), glob=True)
            if x := re.match(r"\s*@include\s+([\w-]+)", body):
                f.refer(x[1], "call", at + x.start(1))
            for x in re.finditer(r"var\(\s*(--[\w-]+)", body):
                f.refer(x[1], "string-ref", at + x.start(1), expects="property")
            for x in re.finditer(r"\$[\w-]+", body):
                f.refer(x.group(), "identifier", at + x.start())
            start = m.end()
            if kind == "close":
                depth -= 1
                if depth < 0:
                    f.error(m.start())
                    depth = 0
    if depth > 0:
        f.error(len(text))


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return i + 1
    return len(text)
