"""What all extractors share: a builder that takes character offsets and returns fact rows in bytes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

#: Of two definitions at one name, and of two references at one place, the more specific kind stays; lower is more specific.
_KINDS = ["method", "function", "class", "struct", "trait", "interface", "enum", "type", "field", "parameter", "constant", "property"]
_REFS = ["call", "type", "field", "string-ref", "identifier", "textual"]


class Facts:
    def __init__(self, path: str, language: str, text: str) -> None:
        self.path, self.language, self.text = path, language, text
        self.definitions: list[dict] = []
        self.references: list[dict] = []
        self.spans: list[tuple[int, int]] = [(0, len(text))]
        self.containers: list[tuple[int, int, str]] = []
        self.import_rows: list[dict] = []
        self.texts: list[tuple[int, int]] = []
        self.supertypes: list[tuple[str, str]] = []
        self.subtrees: list[tuple[str, int, int, int, int]] = []
        self.notes: list[tuple[int, str, str | None]] = []
        self.flows: list[tuple[int, int, int]] = []
        self.error_places: list[int] = []
        self.gaps: set[str] = set()

    def define(self, name: str, kind: str, at: int, start: int | None = None, end: int | None = None, exported: bool = False) -> None:
        start, end = at if start is None else start, at + len(name) if end is None else end
        self.definitions.append({"name": name, "kind": kind, "at": at, "to": at + len(name), "start": start, "end": end, "exported": exported})

    def refer(self, name: str, kind: str, at: int, receiver: str | None = None, path: bool = False, expects: str | None = None, in_import: bool = False, to: int | None = None) -> None:
        self.references.append({"name": name, "kind": kind, "at": at, "to": at + len(name) if to is None else to, "receiver": receiver, "path": path, "expects": expects, "in_import": in_import})

    def scope(self, start: int, end: int, owner: str | None = None) -> None:
        """A scope; with an owner, what is defined in it belongs to that type."""
        self.spans.append((start, end))
        if owner:
            self.containers.append((start, end, owner))

    def import_(self, module: str, start: int, end: int, names: list[tuple[str, str, int]] = (), alias: str | None = None, glob: bool = False) -> None:
        self.import_rows.append({"module": module, "start": start, "end": end, "names": list(names), "alias": alias, "glob": glob})

    def say(self, start: int, end: int) -> None:
        """A string or comment."""
        self.texts.append((start, end))

    def note(self, owner: int, name: str, arg: str | None = None) -> None:
        self.notes.append((owner, name, arg))

    def flow(self, target: int, start: int, end: int) -> None:
        """The definition at `target` is initialised from the span."""
        self.flows.append((target, start, end))

    def error(self, at: int) -> None:
        self.error_places.append(at)
        self.gaps.add("syntax-errors")

    def subtree(self, parts: list[str], tokens: int, depth: int, start: int, end: int) -> str:
        """Hash of a node from its kind and its children's hashes; kept as a clone candidate."""
        h = hashlib.blake2b("\0".join(parts).encode(), digest_size=12).hexdigest()
        self.subtrees.append((h, tokens, depth, start, end))
        return h

    def row(self) -> dict:
        data = self.text
        if data.isascii():
            where = lambda i: i
        else:
            offsets, n = [0], 0
            for c in data:
                n += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
                offsets.append(n)
            where = lambda i: offsets[min(i, len(data))]
        spans = sorted(set(self.spans), key=lambda s: (s[0], -s[1]))
        parents, stack = [], []
        for i, (a, b) in enumerate(spans):
            while stack and spans[stack[-1]][1] < b or stack and spans[stack[-1]][1] <= a:
                stack.pop()
            parents.append(stack[-1] if stack else None)
            stack.append(i)
        begins = [s[0] for s in spans]

        def scope_at(at: int, but: tuple[int, int] | None = None) -> int:
            i = bisect_right(begins, at) - 1
            while i > 0 and (spans[i][1] <= at or but and but[0] <= spans[i][0] and spans[i][1] <= but[1]):
                i = parents[i] if parents[i] is not None else 0
            return max(i, 0)

        merged: dict[tuple[int, int], dict] = {}
        rank = lambda k: _KINDS.index(k) if k in _KINDS else len(_KINDS)
        for d in self.definitions:
            key = (d["at"], d["to"])
            if old := merged.get(key):
                wide = max((old, d), key=lambda x: x["end"] - x["start"])
                best = min((old, d), key=lambda x: rank(x["kind"]))
                d = best | {"start": wide["start"], "end": wide["end"], "exported": old["exported"] or d["exported"]}
            merged[key] = d
        symbols = sorted(merged.values(), key=lambda d: (d["start"], -d["end"], d["at"]))
        open_: list[dict] = []
        for d in symbols:
            while open_ and open_[-1]["end"] < d["end"] or open_ and open_[-1]["end"] <= d["start"]:
                open_.pop()
            d["container"] = next((where(o["at"]) for o in reversed(open_) if (o["start"], o["end"]) != (d["start"], d["end"])), None)
            open_.append(d)
            inside = [c for c in self.containers if c[0] <= d["at"] < c[1]]
            owner = min(inside, key=lambda c: c[1] - c[0])[2] if inside and d["kind"] not in ("variable", "parameter") else None
            # Only what stands directly in the type's body belongs to it.
            if owner and any(o["kind"] in ("function", "method") and o is not d and o["start"] <= d["at"] < o["end"] and min(inside, key=lambda c: c[1] - c[0])[0] <= o["start"] for o in open_):
                owner = None
            d["qualifier"] = d.get("own_qualifier") or owner
            if d["kind"] == "function" and d["qualifier"]:
                d["kind"] = "method"
        names = {(d["at"], d["to"]) for d in symbols}
        refs: dict[tuple[int, int], dict] = {}
        for r in sorted(self.references, key=lambda r: (r["at"], _REFS.index(r["kind"]))):
            if (r["at"], r["to"]) not in names or r["in_import"]:
                refs.setdefault((r["at"], r["to"]), r)
        callables = [d for d in symbols if d["kind"] in ("function", "method")]

        def enclosing(at: int) -> int | None:
            best = None
            for d in callables:
                if d["start"] > at:
                    break
                if at < d["end"] and (best is None or d["end"] - d["start"] < best["end"] - best["start"]):
                    best = d
            return where(best["at"]) if best else None

        return {
            "path": self.path, "language": self.language,
            "symbols": [{"name": d["name"], "kind": d["kind"], "name_start": where(d["at"]), "name_end": where(d["to"]), "full_start": where(d["start"]), "full_end": where(d["end"]), "scope_id": scope_at(d["at"], (d["start"], d["end"])), "container": d["container"], "qualifier": d["qualifier"], "exported": d["exported"]} for d in symbols],
            "refs": [{"name": r["name"], "kind": r["kind"], "start": where(r["at"]), "end": where(r["to"]), "scope_id": scope_at(r["at"]), "expects": r["expects"], "receiver": r["receiver"], "receiver_is_path": r["path"], "in_import": r["in_import"], "enclosing": enclosing(r["at"])} for r in refs.values()],
            "scopes": [{"scope_id": i, "start": where(a), "end": where(b), "parent_id": p} for i, ((a, b), p) in enumerate(zip(spans, parents))],
            "imports": [{"import_pos": i, "module": m["module"], "alias": m["alias"], "is_glob": m["glob"], "start": where(m["start"]), "end": where(m["end"]), "names": [{"original": o, "local": local, "start": where(at), "end": where(at + len(o))} for o, local, at in m["names"]]} for i, m in enumerate(self.import_rows)],
            "text_spans": [{"start": where(a), "end": where(b), "text": data[a:b]} for a, b in sorted(set(self.texts))],
            "supertypes": [{"type": a, "parent": b} for a, b in self.supertypes],
            "subtrees": [{"hash": h, "tokens": n, "depth": k, "start": where(a), "end": where(b)} for h, n, k, a, b in self.subtrees],
            "notes": [{"owner": where(o), "name": n, "arg": a} for o, n, a in self.notes],
            "flows": [{"target": where(x), "source_start": where(a), "source_end": where(b)} for x, a, b in self.flows],
            "errors": [where(e) for e in self.error_places], "gaps": sorted(self.gaps),
        }


def tokens_of(text: str, pattern: re.Pattern) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of a pattern with named groups."""
    return [(m.lastgroup or "", m.group(), m.start(), m.end()) for m in pattern.finditer(text)]
