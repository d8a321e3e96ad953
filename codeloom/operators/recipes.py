"""Recipes: steps whose `where` clause is a predicate query over symbols or files.

    requires language python
    expect no-new unused
    expect changed > 0 files

    step rename-helpers
      select symbols
      where kind=function name~help* !exported in=pkg/
      limit 10
      rename new_name
      on-refusal skip

Predicates are a conjunction; set-valued ones (calls=, called-by=, implements=, unused, duplicated) become semi-joins and
their negations anti-joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..schemas import LANGUAGES
from .calls import walkable
from .edits import Refusal, safe_deletes
from .graphs import one_step

#: What a where clause may name.
FIELDS = ["name", "kind", "lang", "file", "in", "annotated-with", "calls", "called-by", "implements", "matches"]
FLAGS = ["exported", "unused", "duplicated", "changed"]
KINDS = "function method class struct trait interface enum type constant variable parameter field module block key selector property anchor heading link-def element-id data-attribute".split()
ACTIONS = ["rename", "delete", "restructure", "report"]


#: What a recipe may require of a workspace, and expect of what it leaves.
REQUIRES = ["language", "symbol", "path"]
EXPECTS = ["no-new", "changed", "refusals"]
COMPARISONS = {"=": "__eq__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


class RecipeError(ValueError):
    pass


@dataclass
class Step:
    name: str
    subject: str = "symbols"
    where: list[tuple[bool, str, str, str]] = field(default_factory=list)  # (negated, field, = or ~ or flag, value)
    limit: int | None = None
    action: str = "report"
    args: list[str] = field(default_factory=list)
    on_refusal: str = "stop"
    allow_empty: bool = False


@dataclass
class Recipe:
    steps: list[Step] = field(default_factory=list)
    requires: list[tuple[str, str]] = field(default_factory=list)
    expects: list[tuple[str, str, int]] = field(default_factory=list)  # (no-new, what, 0) or (changed or refusals, comparison, count)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def known(word: str, words: list[str], what: str) -> str:
    """refuses what is not in a closed vocabulary and names the nearest word."""
    if word in words:
        return word
    near = min(words, key=lambda w: (_distance(word, w), w))
    raise RecipeError(f"unknown {what} {word!r}" + (f"; did you mean {near!r}?" if _distance(word, near) <= 3 else ""))


def predicate(text: str) -> tuple[bool, str, str, str]:
    negated, text = text.startswith("!"), text.removeprefix("!")
    for op in "=~":
        if op in text:
            name, value = text.split(op, 1)
            known(name, FIELDS, "predicate")
            if op == "~" and name not in ("name", "file"):
                raise RecipeError(f"{name} takes no pattern")
            if name == "kind":
                known(value, KINDS, "kind")
            if name == "lang":
                known(value, list(LANGUAGES), "language")
            return negated, name, op, value
    return negated, known(text, FLAGS, "flag"), "flag", ""


def _expectation(args: list[str], number: int) -> tuple[str, str, int]:
    what = known(args[0] if args else "", EXPECTS, "expectation")
    if what == "no-new":
        return what, known(args[1] if len(args) > 1 else "", ["unused", "duplicates"], "analysis"), 0
    if len(args) < 3 or args[1] not in COMPARISONS or not args[2].isdigit() or args[3:] not in ([], ["files"]):
        raise RecipeError(f"line {number}: expect {what} takes one of {' '.join(COMPARISONS)} and a number")
    return what, args[1], int(args[2])


def read(text: str) -> Recipe:
    """A recipe's steps, and the requirements and expectations that stand outside or between them."""
    recipe = Recipe()
    steps = recipe.steps
    for number, line in enumerate(text.splitlines(), 1):
        words = line.split("#", 1)[0].split()
        if not words:
            continue
        verb, args = words[0], words[1:]
        if verb == "step":
            steps.append(Step(" ".join(args)))
            continue
        if verb == "expect":
            recipe.expects.append(_expectation(args, number))
            continue
        if verb == "requires":
            kind, value = known(args[0] if args else "", REQUIRES, "requirement"), " ".join(args[1:]).strip("\"'")
            recipe.requires.append((kind, known(value, list(LANGUAGES), "language") if kind == "language" else value))
            continue
        if not steps:
            raise RecipeError(f"line {number}: a recipe begins with a step")
        step = steps[-1]
        if verb == "select":
            step.subject = known(args[0], ["symbols", "files"], "subject")
        elif verb == "where":
            step.where += [predicate(a) for a in args]
        elif verb == "limit":
            step.limit = int(args[0])
        elif verb == "on-refusal":
            step.on_refusal = known(args[0], ["stop", "skip"], "answer to a refusal")
        elif verb == "allow-empty":
            step.allow_empty = True
        else:
            step.action, step.args = known(verb, ACTIONS, "action"), args
    return recipe


def parse(text: str) -> list[Step]:
    return read(text).steps


def glob_match(pattern: str, text: str) -> bool:
    """`*` stands for any run of characters; every part is taken at its leftmost place, without going back, and the last must end the text."""
    parts = pattern.split("*")
    if len(parts) == 1:
        return pattern == text
    if not text.startswith(parts[0]):
        return False
    at = len(parts[0])
    for i, part in enumerate(parts[1:], 1):
        found = text.find(part, at) if part else at
        if found < 0:
            return False
        at = found + len(part)
        if i == len(parts) - 1 and part:
            return at == len(text)
    return True


def glob(column: Column, pattern: str) -> Column:
    match = F.pandas_udf(lambda s: s.map(lambda x: glob_match(pattern, x)).astype(bool), "boolean")
    return match(column)


def select(workspace, step: Step) -> DataFrame:
    """The rows that a step's predicates keep, in order of place, cut to its limit. An empty answer is refused unless allowed."""
    t, symbols = workspace.tables, step.subject == "symbols"
    rows = t.symbols if symbols else t.files
    for negated, name, op, value in step.where:
        c = F.col
        if name in ("unused", "duplicated", "calls", "called-by", "implements", "annotated-with", "changed", "matches"):
            keys = _set_of(workspace, name, value, symbols)
            rows = rows.join(keys, keys.columns, "left_anti" if negated else "left_semi")
            continue
        if name == "name":
            test = c("name") == value if op == "=" else glob(c("name"), value)
        elif name == "file":
            test = c("path").endswith(value) if op == "=" else glob(c("path"), value)
        else:
            test = {"kind": lambda: c("kind") == value, "lang": lambda: c("language") == value, "in": lambda: c("path").contains(value.rstrip("/")), "exported": lambda: c("exported")}[name]()
        rows = rows.where(~test if negated else test)
    order = ["path", "full_start"] if symbols else ["path"]
    rows = rows.orderBy(*order)
    rows = rows.limit(step.limit) if step.limit is not None else rows
    if not step.allow_empty and rows.isEmpty():
        raise Refusal("no-match", f"step {step.name} selects nothing")
    return rows


def _set_of(workspace, name: str, value: str, symbols: bool) -> DataFrame:
    t = workspace.tables
    if name == "unused":
        return workspace.unused().where("spared is null").select("path", "name_start") if symbols else workspace.unused().where("spared is null").select("path").distinct()
    if name == "duplicated":
        places = workspace.duplicates().select(F.explode("places").alias("p")).select("p.path", "p.start", "p.end")
        inside = t.symbols.join(places, "path").where("start <= full_start and full_end <= end").select("path", "name_start").distinct()
        return inside if symbols else places.select("path").distinct()
    if name in ("calls", "called-by"):
        g, named = walkable(workspace.graph), workspace.graph["nodes"].where(F.col("name") == value).select("node")
        return one_step(g.flipped() if name == "calls" else g, named).select(F.col("node").alias("symbol_id"))
    if name == "implements":
        from .calls import ancestors_of

        return ancestors_of(t).where(F.col("dst") == value).select(F.col("src").alias("name")).distinct()
    if name == "annotated-with":
        return t.notes.where(F.col("name") == value).select("symbol_id").distinct()
    if name == "matches":
        from .patterns import search

        hits = None
        for lang in ("python", "typescript", "go", "rust", "java"):
            found = search(t.files, lang, value).select("path")
            hits = found if hits is None else hits.union(found)
        return hits.distinct()
    return workspace.changed.select("path").distinct()


def _do(workspace, step: Step) -> dict:
    try:
        rows = select(workspace, step)
        result = {"step": step.name, "rows": rows}
        if step.action == "rename":
            names = [r["qualified_name"] for r in rows.select("qualified_name").distinct().limit(1000).collect()]
            if len(names) != 1:
                raise Refusal("ambiguous", f"rename takes one name, not {len(names)}")
            result["edits"], result["warnings"] = workspace.rename(names[0], step.args[0])
        elif step.action == "delete":
            names = rows.select(F.col("qualified_name").alias("wanted")).distinct()
            result["edits"] = safe_deletes(workspace.tables, workspace.resolved, names)
        elif step.action == "restructure":
            pattern, template = " ".join(step.args).split(" => ", 1)
            lang = next((v for _, n, _, v in step.where if n == "lang"), "python")
            result["edits"] = workspace.search(lang, pattern, template).select("path", "start", "end", "replacement")
        return result
    except Refusal as e:
        if step.on_refusal == "stop":
            raise
        return {"step": step.name, "refused": e.kind}


def check_requirements(workspace, recipe: Recipe) -> None:
    """Refuses a recipe that was written for another tree, before it does nothing and says it has succeeded."""
    t = workspace.tables
    for kind, value in recipe.requires:
        found = {"language": lambda v: t.files.where(F.col("language") == v), "symbol": lambda v: t.symbols.where(F.col("name") == v), "path": lambda v: t.files.where(F.col("path").contains(v))}[kind](value)
        if found.isEmpty():
            raise Refusal("requirement", f"requires {kind} {value}: this workspace has none")


def run(workspace, text: str) -> list[dict]:
    """Runs the steps on the workspace as it is; each gives its name, its edits (a DataFrame) or rows, and any refusal."""
    recipe = read(text)
    check_requirements(workspace, recipe)
    return [_do(workspace, step) for step in recipe.steps]


def expectations(before, after, recipe: Recipe, changed: DataFrame, refusals: int) -> DataFrame:
    """(expectation, actual, held) of two resolved states of a workspace, in one plan.

    What is unused now and wasn't is a difference of rows, by path and name; of clone classes, the difference of their
    numbers that doesn't go below 0.
    """
    spark = before.spark
    rows = []
    for what, how, count in recipe.expects:
        if what == "no-new":
            key = ["path", "name"]
            if how == "unused":
                listed = lambda w: w.unused().where("spared is null").select(*key).distinct()
                fresh = listed(after).join(listed(before), key, "left_anti").agg(F.count("*").alias("actual"))
            else:
                number = lambda w, sign: w.duplicates().agg((F.count("*") * sign).alias("n"))
                fresh = number(after, 1).union(number(before, -1)).agg(F.greatest(F.sum("n"), F.lit(0)).alias("actual"))
            rows.append(fresh.select(F.lit(f"no-new {how}").alias("expectation"), "actual", (F.col("actual") == 0).alias("held")))
            continue
        actual = changed.agg(F.count("*").alias("actual")) if what == "changed" else spark.range(1).select(F.lit(refusals).cast("bigint").alias("actual"))
        rows.append(actual.select(F.lit(f"{what} {how} {count}" + " files" * (what == "changed")).alias("expectation"), "actual", getattr(F.col("actual"), COMPARISONS[how])(F.lit(count)).alias("held")))
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], "expectation string, actual bigint, held boolean")


def verify(workspace, text: str) -> dict:
    """Runs the steps one on another's result, and holds what they leave against the recipe's expectations.

    Gives steps, the workspace after them, changed (path, before, after), expectations (a DataFrame) and ok. Edits are
    planned only: a caller writes them where ok says so.
    """
    recipe = read(text)
    check_requirements(workspace, recipe)
    now, steps = workspace, []
    for step in recipe.steps:
        steps.append(_do(now, step))
        if "edits" in steps[-1]:
            now = now.edited(steps[-1]["edits"])
    then = now.files.select("path", F.col("text").alias("after"))
    changed = cut(workspace.files.select("path", F.col("text").alias("before")).join(then, "path").where("before <> after"))
    held = cut(expectations(workspace, now, recipe, changed, sum("refused" in x for x in steps)))
    return {"steps": steps, "workspace": now, "changed": changed, "expectations": held, "ok": held.where("not held").isEmpty()}
