"""The user-facing API: a workspace whose verbs return DataFrames."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .functions.lineage import cut, importable
from .operators import calls, edits, facts, graphs, patterns, provenance, recipes, refactorings, references, reports, types
from .sources import catalogs, workspace


class NotFound(LookupError):
    """No such name; carries the nearest ones."""

    def __init__(self, name: str, near: list[str]) -> None:
        super().__init__(f"{name} is not defined" + (f"; nearest: {', '.join(near)}" if near else ""))
        self.near = near


class Workspace:
    """Facts are extracted once, resolved once and kept; every verb is a plan over them."""

    def __init__(self, files: DataFrame, catalog_folder: str | None = None, only: list[str] | None = None, store: str | None = None) -> None:
        self.spark, self.given = files.sparkSession, files
        self.files = workspace.with_languages(files, only)
        self.catalog_folder, self.store = catalog_folder, store
        self.changed = self.files.limit(0)
        self.base: Workspace | None = None
        importable(self.spark)

    @classmethod
    def of(cls, spark: SparkSession, files: dict[str, str], **options) -> "Workspace":
        return cls(workspace.from_map(spark, files), **options)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> "Workspace":
        return cls(workspace.scan(spark, root).where("status = 'ok'").select("path", "text"), **options)

    @cached_property
    def tables(self) -> facts.Tables:
        """Of an edited workspace, only changed files are extracted; their facts lie over those that stay."""
        if self.base is None:
            return facts.tables(self.files)
        fresh = cut(facts.extracted(self.files.join(self.changed, "path", "left_semi")))
        return facts.tables(self.files, self.base.tables.nested.join(self.changed, "path", "left_anti").unionByName(fresh))

    @cached_property
    def import_files(self) -> DataFrame:
        return cut(references.import_files(self.tables))

    @cached_property
    def resolved_again(self) -> DataFrame:
        """Of an edited workspace, the references that changed files may affect, resolved."""
        links = self.base.import_files.union(self.import_files)
        asked = cut(references.affected(self.base.tables, self.tables, self.changed, links))
        return cut(references.resolve(replace(self.tables, refs=asked), self.import_files))

    @cached_property
    def resolved(self) -> DataFrame:
        """K7: written once to the shared folder, so no verb resolves again; with a store, kept there by workspace key and taken from it by later workspaces of the same files."""
        if self.base is not None:
            rest = self.base.resolved.join(self.changed, "path", "left_anti").join(self.resolved_again.select("ref_id"), "ref_id", "left_anti")
            return cut(rest.unionByName(self.resolved_again))
        if not self.store:
            return cut(references.resolve(self.tables, self.import_files))
        at = f"{self.store}/resolved-{facts.workspace_key(self.files)}"
        try:
            return self.spark.read.parquet(at)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        references.resolve(self.tables, self.import_files).write.parquet(at)
        return self.spark.read.parquet(at)

    @cached_property
    def graph(self) -> dict[str, DataFrame]:
        """Direct edges, sites and sets are written once; `edges` is the plan that writes all pairs out."""
        graph = calls.call_graph(self.tables, self.resolved)
        graph |= {name: cut(graph[name]) for name in ("direct", "sites", "sets")}
        return graph | {"edges": calls.pairs(graph)}

    @cached_property
    def walkable(self) -> graphs.Factored:
        return calls.walkable(self.graph)

    def attribute_family(self, name: str) -> DataFrame:
        return calls.attribute_family(self.tables, self.target(name).where("kind = 'field'"))

    @cached_property
    def entries(self) -> DataFrame:
        return cut(reports.entry_points(self.tables, self.resolved, catalogs.rules(self.spark, self.catalog_folder), self.given))

    @cached_property
    def types(self) -> DataFrame:
        return cut(types.types(self.tables))

    def helm(self, passed: list[str] = (), sets: dict[str, str] | None = None) -> DataFrame:
        return provenance.helm_sources(self.tables, passed, sets)

    @cached_property
    def consumer_edges(self) -> DataFrame:
        return cut(provenance.consumer_edges(self.tables, self.resolved))

    def consumers(self, name: str, depth: int = 8) -> DataFrame:
        return provenance.consumers(self.tables, self.consumer_edges, self.target(name), depth)

    def module_callers(self) -> DataFrame:
        return provenance.module_callers(self.tables)

    def visible_scripts(self) -> DataFrame:
        return provenance.visible_scripts(self.tables, self.import_files)

    def reaches_style(self, origin: str, destination: str) -> bool:
        return provenance.reaches_style(self.tables, self.import_files, origin, destination)

    def first_definition(self, name: str) -> DataFrame:
        return reports.first_definition(self.tables, name)

    def orphaned_imports(self, planned: DataFrame) -> DataFrame:
        return refactorings.orphaned_imports(self, planned)

    def inline_variable(self, symbol_id: str) -> DataFrame:
        return refactorings.inline_variable(self.tables, self.resolved, symbol_id)

    def change_signature(self, name: str, change: str) -> DataFrame:
        return refactorings.change_signature(self.tables, self.resolved, name, change)

    def move(self, name: str, destination: str) -> DataFrame:
        return refactorings.move_symbol(self.tables, self.resolved, name, destination)

    def extract_variable(self, path: str, start: int, end: int, name: str) -> DataFrame:
        return refactorings.extract_variable(self.files, path, start, end, name)

    def extract_function(self, path: str, start: int, end: int, name: str) -> DataFrame:
        return refactorings.extract_function(self.files, path, start, end, name)

    def rewrite(self, path: str, at: int, kind: str) -> DataFrame:
        return refactorings.rewrite(self.files, path, at, kind)

    def remove_flag(self, flag: str, value: bool) -> tuple[DataFrame, list[dict]]:
        return refactorings.remove_flag(self, flag, value)

    def target(self, name: str) -> DataFrame:
        """Q24: symbols of a name or at path:line:column (from 1), or NotFound with the three nearest names."""
        if place := re.fullmatch(r"(.+):(\d+):(\d+)", name):
            hit = self.at(place[1], int(place[2]), int(place[3]))
        else:
            hit = self.tables.symbols.where((F.col("name") == name) | (F.col("qualified_name") == name))
        if hit.isEmpty():
            near = self.tables.symbols.select("name").distinct().select("name", F.levenshtein("name", F.lit(name)).alias("d")).orderBy("d", "name").limit(3).collect()
            raise NotFound(name, [r["name"] for r in near])
        return hit

    def at(self, path: str, line: int, column: int) -> DataFrame:
        """The symbol defined or referred to at a place, lines and characters counted from 1."""
        rows = F.split("text", "\n")
        before = F.aggregate(F.slice(rows, 1, line - 1), F.lit(0), lambda n, x: n + F.octet_length(x) + 1) if line > 1 else F.lit(0)
        found = self.files.where(F.col("path") == path).select((before + F.octet_length(F.substring(F.get(rows, F.lit(line - 1)), 1, column - 1))).alias("offset")).first()
        if found is None or found["offset"] is None:
            return self.tables.symbols.limit(0)
        return reports.definition_at(self.tables, self.resolved, path, found["offset"])

    def candidates(self, name: str) -> DataFrame:
        """Q24: what a name may mean, as places to choose from: (place, kind, qualified_name, language), one row for each entity."""
        hit = references.with_entities(self.tables.symbols).join(self.target(name).select("symbol_id"), "symbol_id", "left_semi")
        first = hit.groupBy("entity").agg(F.min(F.struct("path", "name_start", "kind", "qualified_name", "language")).alias("b")).select("b.*")
        upto = F.decode(F.expr("substring(cast(text as binary), 1, int(name_start))"), "utf-8")
        placed = first.join(self.files.select("path", "text"), "path").withColumn("head", upto)
        line, column = F.size(F.split("head", "\n")), F.length(F.substring_index("head", "\n", -1)) + 1
        return placed.select(F.concat_ws(":", "path", line, column).alias("place"), "kind", "qualified_name", "language")

    def symbols(self, name: str | None = None, kind: str | None = None, roots: list[str] | None = None) -> DataFrame:
        from .functions.scalars import under

        out = self.tables.symbols
        out = out.where(F.col("name").contains(name)) if name else out
        out = out.where(F.col("kind") == kind) if kind else out
        return out.where(under(F.col("path"), roots)) if roots else out

    def stats(self) -> DataFrame:
        return reports.stats(self.tables, self.resolved)

    def parse_tally(self) -> DataFrame:
        return reports.parse_tally(self.tables)

    def definitions(self, name: str) -> DataFrame:
        self.target(name)
        return reports.definitions(self.tables, name)

    def implementations(self, name: str) -> DataFrame:
        return self.definitions(name).where("role = 'implementation'")

    def references(self, name: str) -> DataFrame:
        return reports.references_to(self.resolved, self.target(name))

    def usages(self, name: str) -> DataFrame:
        return reports.usages(self.tables, self.resolved, name)

    def mentions(self, word: str) -> DataFrame:
        return reports.mentions(self.tables, word)

    def callers(self, name: str, depth: int = 3) -> DataFrame:
        return graphs.trace(self.walkable.flipped(), self.target(name).select(F.col("symbol_id").alias("node")), depth)

    def callees(self, name: str, depth: int = 3) -> DataFrame:
        return graphs.trace(self.walkable, self.target(name).select(F.col("symbol_id").alias("node")), depth)

    def neighbourhood(self, name: str, depth: int = 2) -> DataFrame:
        return graphs.neighbourhood(self.walkable, self.target(name).select(F.col("symbol_id").alias("node")), depth)

    def dot(self) -> DataFrame:
        return graphs.dot(self.graph["edges"])

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return reports.impact(self.tables, self.resolved, self.graph, name, depth)

    def entry_points(self, kind: str | None = None) -> DataFrame:
        return self.entries.where(F.col("kind") == kind) if kind else self.entries

    def unreachable(self) -> DataFrame:
        seeds = self.entries.select(F.col("symbol_id").alias("node"))
        return self.graph["nodes"].join(graphs.reach(self.walkable, seeds), "node", "left_anti")

    def unused(self, internal: bool = False) -> DataFrame:
        out = reports.unused(self.tables, self.resolved, self.graph, self.entries)
        return out.where("not exported") if internal else out

    def duplicates(self, floor: int = 60, config_floor: int = 30) -> DataFrame:
        return reports.duplicates(self.tables, floor, config_floor)

    def flow(self, symbol_id: str, forward: bool = False, depth: int = 8) -> DataFrame:
        return (reports.flow_forward if forward else reports.flow_backward)(self.tables, self.resolved, symbol_id, depth)

    def stitch(self) -> DataFrame:
        return reports.stitch(self.tables)

    def terraform(self) -> DataFrame:
        return reports.terraform_value(self.tables)

    def css(self) -> DataFrame:
        return reports.css_values(self.tables)

    def search(self, language: str, pattern: str, template: str | None = None) -> DataFrame:
        return patterns.search(self.files, language, pattern, template)

    def rename(self, old: str, new: str) -> tuple[DataFrame, DataFrame]:
        return edits.rename(self.tables, self.resolved, old, new)

    def delete(self, name: str) -> DataFrame:
        return edits.safe_delete(self.tables, self.resolved, name)

    def unused_imports(self) -> DataFrame:
        return edits.unused_imports(self.tables, self.resolved)

    def apply(self, planned: DataFrame) -> DataFrame:
        return edits.apply(planned, self.files)

    def edited(self, planned: DataFrame) -> "Workspace":
        """The workspace as the edits leave it; files that refuse theirs stay as they are. Facts and answers that they can't alter are kept."""
        done = self.apply(planned).where("refused is null and before <> after").select("path", "after")
        return self.with_texts(done)

    def with_texts(self, changed: DataFrame) -> "Workspace":
        """The workspace with other texts (path, after) for some of its files."""
        done = cut(changed)
        files = self.given.join(done, "path", "left").withColumn("text", F.coalesce("after", "text")).drop("after")
        out = Workspace(files, self.catalog_folder)
        out.files = out.files.join(self.files.select("path"), "path", "left_semi")  # languages that were left out stay out
        out.base, out.changed = self, done.select("path")
        return out

    def close(self) -> None:
        """Releases what is held of the texts' facts."""
        if "tables" in self.__dict__:
            self.tables.nested.unpersist()

    def verify(self, recipe: str) -> dict:
        return recipes.verify(self, recipe)

    def run(self, recipe: str) -> list[dict]:
        return recipes.run(self, recipe)
