"""Facts of YAML, Helm templates, HCL and Bash."""

from __future__ import annotations

import re

from .base import Facts

_ACTION = re.compile(r"\{\{-?\s*(?P<body>.*?)\s*-?\}\}", re.S)


def mask_actions(text: str) -> str:
    """Template actions replaced by filler of equal length: blanks where they stand alone on a line or as a key, x inside values."""

    def fill(m: re.Match) -> str:
        begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        before, after = text[begin : m.start()], text[m.end() : end if end >= 0 else len(text)]
        alone = not before.strip() and not after.strip() or not before.strip() and after.lstrip().startswith(":")
        return "".join("\n" if c == "\n" else " " if alone else "x" for c in m.group())

    return _ACTION.sub(fill, text)


def actions(text: str) -> list[dict]:
    """Kind, body and span of every template action; control actions carry the nesting they open in."""
    out, depth = [], 0
    for m in _ACTION.finditer(text):
        body = m["body"]
        word = body.split(None, 1)[0] if body else ""
        kind = word if word in ("if", "else", "end", "range", "with", "define", "template", "include", "block") else "comment" if body.startswith("/*") else "value"
        if kind == "end":
            depth = max(0, depth - 1)
        out.append({"kind": kind, "body": body, "start": m.start(), "end": m.end(), "body_start": m.start("body"), "depth": depth})
        if kind in ("if", "range", "with", "define", "block"):
            depth += 1
    return out


def _keys(f: Facts, text: str, values: bool = False) -> None:
    import yaml

    def walk(node, path: list[str]) -> None:
        if isinstance(node, yaml.MappingNode):
            for key, value in node.value:
                if isinstance(key, yaml.ScalarNode):
                    at = key.start_mark.index + (text[key.start_mark.index : key.start_mark.index + 1] in "\"'")
                    f.define(key.value, "key", at, key.start_mark.index, value.end_mark.index, True)
                    f.definitions[-1]["own_qualifier"] = ".".join(path) or None
                    f.flow(at, value.start_mark.index, value.end_mark.index)
                    walk(value, [*path, key.value])
        elif isinstance(node, yaml.SequenceNode):
            for i, x in enumerate(node.value):
                walk(x, path)
        elif isinstance(node, yaml.ScalarNode) and node.value:
            f.say(node.start_mark.index, node.end_mark.index)

    try:
        for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
            if doc is not None:
                f.scope(doc.start_mark.index, doc.end_mark.index)
                walk(doc, [])
                _kubernetes(f, doc)
    except yaml.YAMLError as e:
        f.error(getattr(getattr(e, "problem_mark", None), "index", 0))
    for m in re.finditer(r"(?m)(?:^|\s)#[^\n]*", text):
        f.say(m.start(), m.end())


def _get(node, *path):
    for name in path:
        node = next((v for k, v in getattr(node, "value", []) if not isinstance(v, str) and getattr(k, "value", None) == name), None) if node is not None and node.__class__.__name__ == "MappingNode" else None
    return node


def _kubernetes(f: Facts, doc) -> None:
    """Declared objects as notes; key references with the object as receiver."""
    kind, name = _get(doc, "kind"), _get(doc, "metadata", "name")
    if kind is not None and name is not None and kind.value in ("ConfigMap", "Secret"):
        f.note(name.start_mark.index, f"k8s:{kind.value}", name.value)

    def walk(node) -> None:
        if node.__class__.__name__ == "MappingNode":
            for k, v in node.value:
                if k.value in ("configMapKeyRef", "secretKeyRef"):
                    key, owner = _get(v, "key"), _get(v, "name")
                    if key is not None and owner is not None:
                        f.refer(key.value, "string-ref", key.start_mark.index, f"{'ConfigMap' if k.value[0] == 'c' else 'Secret'}/{owner.value}", expects="key")
                walk(v)
        elif node.__class__.__name__ == "SequenceNode":
            for x in node.value:
                walk(x)

    walk(doc)


def yaml_(f: Facts) -> None:
    _keys(f, f.text)


def helm(f: Facts) -> None:
    for a in actions(f.text):
        for m in re.finditer(r"\.Values((?:\.\w+)+)", a["body"]):
            path = m[1].strip(".").split(".")
            at = a["body_start"] + m.end() - len(path[-1])
            f.refer(path[-1], "string-ref", at, ".".join(path[:-1]) or None, expects="key")
        if a["kind"] == "define" and (m := re.search(r"\"([^\"]+)\"", a["body"])):
            f.define(m[1], "function", a["body_start"] + m.start(1), a["start"], a["end"], True)
        for m in re.finditer(r"(?:include|template)\s+\"([^\"]+)\"", a["body"]):
            f.refer(m[1], "call", a["body_start"] + m.start(1))
        f.say(a["start"], a["end"])
    opened = sum(a["kind"] in ("if", "range", "with", "define", "block") for a in actions(f.text)) - sum(a["kind"] == "end" for a in actions(f.text))
    if opened:
        f.error(len(f.text))
    if re.search(r"(?m)^\s*\{\{[^}]*\}\}\s*:", f.text):
        f.gaps.add("templated-keys")
    _keys(f, mask_actions(f.text))


_BLOCK = re.compile(r"(?m)^[ \t]*(?P<type>\w+)((?:[ \t]+\"[^\"]*\")*)[ \t]*\{")


def _matching(text: str, at: int) -> int:
    depth = 0
    for m in re.finditer(r"\"(?:\\.|[^\"\\])*\"|#[^\n]*|[{}]", text[at:]):
        depth += (m.group() == "{") - (m.group() == "}")
        if depth == 0 and m.group() == "}":
            return at + m.end()
    return -1


def hcl(f: Facts) -> None:
    for m in re.finditer(r"\"(?:\\.|[^\"\\\n])*\"|(?m:#|//)[^\n]*", f.text):
        f.say(*m.span())
    for m in _BLOCK.finditer(f.text):
        labels = [(x[1], m.start(2) + x.start(1)) for x in re.finditer(r"\"([^\"]*)\"", m[2])]
        end = _matching(f.text, m.end() - 1)
        if end < 0:
            f.error(m.start())
            end = len(f.text)
        f.scope(m.end() - 1, end)
        kind = {"variable": "variable", "output": "field", "module": "module", "resource": "block", "data": "block", "provider": "block"}.get(m["type"])
        if kind and labels:
            f.define(labels[-1][0], kind, labels[-1][1], m.start(), end, m["type"] in ("variable", "output"))
            f.definitions[-1]["own_qualifier"] = {"variable": "var", "module": "module", "output": "output"}.get(m["type"], labels[0][0])
        body = f.text[m.end() : end - 1]
        for x in re.finditer(r"(?m)^[ \t]*(\w+)[ \t]*=[ \t]*([^\n]*)", body):
            at = m.end() + x.start(1)
            if m["type"] == "locals":
                f.define(x[1], "variable", at, at, m.end() + x.end(), True)
                f.definitions[-1]["own_qualifier"] = "local"
                f.flow(at, m.end() + x.start(2), m.end() + x.end(2))
            elif m["type"] == "variable" and x[1] == "default" or m["type"] == "output" and x[1] == "value":
                f.flow(labels[-1][1] if labels else at, m.end() + x.start(2), m.end() + x.end(2))
            elif m["type"] == "module" and x[1] == "source":
                f.import_(x[2].strip().strip('"'), m.start(), end, [], labels[0][0] if labels else None)
    if f.path.endswith(".tfvars"):
        for x in re.finditer(r"(?m)^(\w+)[ \t]*=[ \t]*([^\n]*)", f.text):
            f.refer(x[1], "identifier", x.start(1), "var")
            f.flow(x.start(1), x.start(2), x.end(2))
    for x in re.finditer(r"\b(var|local|module|data)\.(\w+)(?:\.(\w+))?", f.text):
        if x[1] == "module" and x[3]:
            f.refer(x[2], "identifier", x.start(2), "module")
            f.refer(x[3], "field", x.start(3), f"module.{x[2]}")
        else:
            f.refer(x[2], "identifier", x.start(2), x[1])


def bash(f: Facts) -> None:
    text = f.text
    for m in re.finditer(r"(?m)(?:^|\s)#[^\n]*|\"(?:\\.|[^\"\\])*\"|'[^']*'", text):
        f.say(*m.span())
    masked = re.sub(r"(?m)(?:^|(?<=\s))#[^\n]*|'[^']*'", lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    for m in re.finditer(r"(?m)^[ \t]*(?:function[ \t]+(\w[\w-]*)[ \t]*(?:\(\))?|(\w[\w-]*)[ \t]*\(\))[ \t\n]*\{", masked):
        g = 1 if m[1] else 2
        depth, end = 0, len(text)
        for x in re.finditer(r"[{}]", masked[m.end() - 1 :]):
            depth += 1 if x.group() == "{" else -1
            if not depth:
                end = m.end() - 1 + x.end()
                break
        else:
            f.error(m.start())
        f.define(m[g], "function", m.start(g), m.start(), end, True)
        f.scope(m.end() - 1, end)
    for m in re.finditer(r"(?m)(?:^|[;&|]|\bthen\b|\bdo\b)[ \t]*(?:export[ \t]+|local[ \t]+|readonly[ \t]+)?(\w+)=([^\n;]*)", masked):
        f.define(m[1], "variable", m.start(1), m.start(1), m.end(), True)
        f.flow(m.start(1), m.start(2), m.end(2))
    for m in re.finditer(r"\$\{?(\w+)", masked):
        if not m[1].isdigit():
            f.refer(m[1], "identifier", m.start(1))
    for m in re.finditer(r"(?m)(?:^|[;&|(]|\bthen\b|\bdo\b|\belse\b|\bif\b|!)[ \t]*([A-Za-z_][\w-]*)(?![\w=-]|[ \t]*\(\))", masked):
        if m[1] in ("source",) and (x := re.match(r"[ \t]+(\S+)", masked[m.end() :])):
            f.import_(x[1].strip('"'), m.start(1), m.end() + x.end(), glob=True)
        elif m[1] not in ("if", "then", "else", "fi", "for", "do", "done", "while", "case", "esac", "function", "export", "local", "readonly", "return", "in", "echo", "set", "exit", "cd"):
            f.refer(m[1], "call", m.start(1))
    for m in re.finditer(r"(?m)^[ \t]*\.[ \t]+(\S+)", masked):
        f.import_(m[1].strip('"'), m.start(), m.end(), glob=True)
