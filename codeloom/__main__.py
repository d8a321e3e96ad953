"""Command line: python -m codeloom VERB FOLDER [NAME] [--depth N] [--json]. Exit codes: 0 ok, 1 other, 2 invalid, 3 not found, 5 refused (K1-K8)."""

from __future__ import annotations

import argparse
import json
import sys

VERBS = ["stats", "parse", "symbols", "definitions", "implementations", "refs", "usages", "mentions", "callers", "callees", "graph", "impact", "entrypoints", "unused", "duplicates", "unused-imports", "stitch", "terraform", "css", "rename", "delete", "recipe"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codeloom")
    parser.add_argument("verb", choices=VERBS)
    parser.add_argument("folder")
    parser.add_argument("args", nargs="*")
    parser.add_argument("--depth", type=int, default=3)
    parser.add_argument("--json", action="store_true")
    a = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators.edits import Refusal
    from .operators.recipes import RecipeError
    from .workspace import NotFound, Workspace

    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    w = Workspace.open(spark, a.folder)
    name = a.args[0] if a.args else None
    verbs = {
        "stats": w.stats, "parse": w.parse_tally, "symbols": lambda: w.symbols(name), "definitions": lambda: w.definitions(name), "implementations": lambda: w.implementations(name), "refs": lambda: w.references(name),
        "usages": lambda: w.usages(name), "mentions": lambda: w.mentions(name), "callers": lambda: w.callers(name, a.depth), "callees": lambda: w.callees(name, a.depth), "graph": w.dot, "impact": lambda: w.impact(name, a.depth),
        "entrypoints": lambda: w.entry_points(name), "unused": w.unused, "duplicates": w.duplicates, "unused-imports": w.unused_imports, "stitch": w.stitch, "terraform": w.terraform, "css": w.css,
        "rename": lambda: w.apply(w.rename(name, a.args[1])[0]).select("path", "diff", "refused"), "delete": lambda: w.apply(w.delete(name)).select("path", "diff", "refused"),
        "recipe": lambda: next(r["rows"] for r in w.run(open(name, encoding="utf-8").read()) if "rows" in r),
    }
    try:
        out = verbs[a.verb]()
        for row in out.toJSON().toLocalIterator() if a.json else out.toLocalIterator():
            print(row if a.json else "\t".join("" if v is None else str(v) for v in row))
        return 0
    except NotFound as e:
        return _fail(a, "not-found", str(e), 3)
    except RecipeError as e:
        return _fail(a, "invalid", str(e), 2)
    except Refusal as e:
        return _fail(a, e.kind, str(e), 5)


def _fail(a, kind: str, message: str, code: int) -> int:
    print(json.dumps({"error": kind, "message": message}) if a.json else message, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
