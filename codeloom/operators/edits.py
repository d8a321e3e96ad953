"""Edits as rows (path, start, end, replacement): checked, applied, diffed."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extractors import EXTRACTORS, extract
from ..functions.lineage import cut
from .calls import attribute_family, families
from .facts import Tables
from .ranking import overlapping, runs
from .references import with_entities
from .resolving import FIELD

EDIT = "path string, start bigint, end bigint, replacement string"


class Refusal(Exception):
    """A planned change that was declined, with the reason's kind and the rows that caused it."""

    def __init__(self, kind: str, message: str, rows: list | None = None) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind, self.rows = kind, rows or []


def rename(t: Tables, resolved: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """M1: (edits, warnings). The entity's sites, its dispatch or attribute family and all references of proven targets; weaker ones are warnings."""
    every = with_entities(t.symbols)
    hit = cut(every.where((F.col("qualified_name") == old) | (F.col("name") == old)).select("symbol_id", "entity", "kind", "path", "scope_id"))  # many plans read it; all symbols are read once for it
    if hit.isEmpty():
        raise Refusal("not-found", old)
    leaf = old.rpartition("::")[2]
    kin = families(t)
    linked = kin.union(kin.select("concrete_id", "abstract_id")).toDF("a", "b").join(hit.select(F.col("symbol_id").alias("a")), "a", "left_semi").select(F.col("b").alias("symbol_id"))
    fields = hit.where("kind = 'field'")
    if not fields.isEmpty():
        linked = linked.union(attribute_family(t, fields).select("member_id"))
    ids = cut(hit.select("symbol_id").union(linked).union(every.join(hit.select("entity").distinct(), "entity", "left_semi").select("symbol_id")).distinct())
    clash = t.symbols.where(F.col("name") == new).join(hit.select("path", "scope_id"), ["path", "scope_id"], "left_semi")
    if not clash.isEmpty():
        raise Refusal("name-taken", f"{new} is already defined beside {old}", clash.limit(10).collect())
    sites = t.symbols.join(ids, "symbol_id", "left_semi").select("path", F.col("name_start").alias("start"), F.col("name_end").alias("end"))
    of = resolved.join(ids.select(F.col("symbol_id").alias("target_id")), "target_id", "left_semi").where(F.col("name") == leaf)
    safe = of.where(F.col("confidence") < FIELD).select("path", "start", "end")
    edits = sites.union(safe).distinct().withColumn("replacement", F.lit(new))
    weak = of.where(F.col("confidence") >= FIELD).select("path", "start", F.lit("unproven-reference").alias("kind"))
    loose = resolved.where((F.col("name") == leaf) & F.col("target_id").isNull()).select("path", "start", F.lit("unresolved-same-name").alias("kind"))
    return edits, weak.union(loose)


def safe_delete(t: Tables, resolved: DataFrame, name: str) -> DataFrame:
    """M3: edits that remove all sites of a name; refuses while something outside them refers to it."""
    return safe_deletes(t, resolved, t.symbols.sparkSession.createDataFrame([(name,)], "wanted string"))


def safe_deletes(t: Tables, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """M3 for all names (wanted) at once: refuses the plan as a whole while one of them is unknown or still referred to."""
    by = lambda c: t.symbols.join(names.distinct(), F.col(c) == F.col("wanted"))
    found = by("qualified_name").union(by("name")).select("wanted", "symbol_id", F.col("path").alias("t_path"), "full_start", "full_end").distinct()
    if missing := names.join(found, "wanted", "left_anti").limit(1).collect():
        raise Refusal("not-found", str(missing[0]["wanted"]))
    holders = resolved.join(found.withColumnRenamed("symbol_id", "target_id"), "target_id").where("path <> t_path or start < full_start or start >= full_end")
    if rows := holders.select("path", "start", "wanted").limit(20).collect():
        raise Refusal("still-referenced", rows[0]["wanted"], rows)
    return found.select(F.col("t_path").alias("path"), F.col("full_start").alias("start"), F.col("full_end").alias("end"), F.lit("").alias("replacement")).distinct()


def organized_imports(t: Tables, resolved: DataFrame) -> DataFrame:
    """M8: every imported name with what becomes of it: live, removed, or kept with the reason why a name without a use stays."""
    used = resolved.where("not in_import").select("path", "name").union(resolved.where("not in_import and receiver is not null").select("path", F.col("receiver").alias("name"))).distinct().withColumn("used", F.lit(True))
    gaps = t.gaps.select("path").distinct().withColumn("gap", F.lit(True))
    listed = t.texts.join(t.symbols.where("name = '__all__'").select("path").distinct(), "path", "left_semi").select("path", F.regexp_extract("text", r"""^["'](\w+)["']$""", 1).alias("name")).where("name <> ''").distinct().withColumn("listed", F.lit(True))
    out = t.bindings.join(used, ["path", "name"], "left").join(gaps, "path", "left").join(listed, ["path", "name"], "left")
    c = F.col
    reason = (
        F.when(c("gap"), "file-has-gaps").when(c("module") == "__future__", "future").when(c("path").rlike(r"(^|/)__init__\.py$|(^|/)(index|mod)\.[a-z]+$"), "package-file").when(c("listed"), "listed-in-all")
        .when((c("language") == "python") & (c("original") == c("module")) & c("module").contains("."), "submodule").when(c("original") == "*", F.when(c("language").isin("bash", "css", "scss", "hcl"), "binds-invisibly"))
    )
    status = F.when(c("used"), "live").when(reason.isNotNull(), "kept").otherwise("removed")
    return out.select("path", "language", "import_pos", "name", "module", status.alias("status"), F.when(status == "kept", reason).alias("reason"))


def unused_imports(t: Tables, resolved: DataFrame) -> DataFrame:
    """M8: imported names that go, with the run of statements that each stands in."""
    dead = organized_imports(t, resolved).where("status = 'removed'").drop("status", "reason")
    return runs(dead, ["path"], "import_pos", F.col("import_pos") - F.col("previous") > 1)


def check(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits that can't be applied, with the reason: overlapping another, past the end, or of no known file."""
    sized = edits.join(files.select("path", F.octet_length("text").alias("n")), "path", "left")
    out = sized.where("n is null or start > end or end > n").select("path", "start", "end", F.when(F.col("n").isNull(), "no-such-file").otherwise("past-the-end").alias("reason"))
    return out.union(overlapping(edits, ["path"], "start", "end").select("path", "start", "end", F.lit("overlap").alias("reason")))


def apply(edits: DataFrame, files: DataFrame, gate: bool = True) -> DataFrame:
    """(path, before, after, diff, refused) of every file that edits touch. With the gate, a file that would gain syntax errors stays as it is and says so."""
    edits = cut(edits)  # checked and applied from one copy: their plan may read all symbols and references
    bad = check(edits, files)
    if rows := bad.limit(20).collect():
        raise Refusal("bad-edits", "edits can't be applied", rows)
    lists = edits.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("start", "end", "replacement")), asc=False).alias("edits"))

    def run(batches):
        for b in batches:
            out = []
            for path, lang, text, changes in zip(b["path"], b["language"], b["text"], b["edits"]):
                raw = text.encode("utf-8", "surrogatepass")
                for e in changes:  # from the end backwards, so earlier offsets stay right
                    raw = raw[: e["start"]] + e["replacement"].encode() + raw[e["end"] :]
                after, refused = raw.decode("utf-8", "replace"), None
                if gate and lang in EXTRACTORS and len(extract(lang, path, after)["errors"]) > len(extract(lang, path, text)["errors"]):
                    after, refused = text, "new-syntax-errors"
                diff = "".join(difflib.unified_diff(text.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}"))
                out.append((path, text, after, diff, refused))
            yield pd.DataFrame(out, columns=["path", "before", "after", "diff", "refused"])

    return files.join(lists, "path").select("path", "language", "text", "edits").mapInPandas(run, "path string, before string, after string, diff string, refused string")
