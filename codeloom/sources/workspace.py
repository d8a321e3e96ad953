"""Workspaces as rows: an in-memory map, a folder (through a Python data source) or any table of paths and texts (S rows)."""

from __future__ import annotations

import fnmatch
import os
import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import scalars as S
from ..schemas import EXTENSIONS, LANGUAGES, MAX_BYTES

FILES = "path string, status string, n_bytes bigint, text string, detail string"


def ignored(path: str, is_dir: bool, rules: list[tuple[str, str]]) -> bool:
    """Whether ignore rules, given as (folder, pattern) from the top down, leave a path out; the last rule that fits decides."""
    out = False
    for folder, rule in rules:
        flip = rule.startswith("!")
        rule = rule[flip:]
        only_dir, rule = rule.endswith("/"), rule.rstrip("/")
        inside = path[len(folder) :].lstrip("/") if folder else path
        if only_dir and not is_dir or folder and not path.startswith(f"{folder}/"):
            continue
        if "/" in rule:
            fits = fnmatch.fnmatchcase(inside, rule.lstrip("/").replace("**/", "*"))
        else:
            fits = fnmatch.fnmatchcase(posixpath.basename(inside), rule)
        out = not flip if fits else out
    return out


#: Files without a language that name a package's commands.
PACKAGING = ["pyproject.toml", "setup.cfg"]


class _Part(InputPartition):
    """Some files (path, status, detail), or a whole folder with the ignore rules that hold in it."""

    def __init__(self, paths: list[tuple[str, str, str]], folder: str | None = None, rules: list[tuple[str, str]] = ()) -> None:
        self.paths, self.folder, self.rules = paths, folder, list(rules)


class _Reader(DataSourceReader):
    """The driver lists folders from the top until there are `folders` of them; tasks walk those and read. The root must be a folder that all executors see."""

    def __init__(self, options) -> None:
        self.root = options["path"]
        self.no_ignore = str(options.get("noIgnore", "false")).lower() == "true"
        self.most, self.per, self.folders = int(options.get("maxBytes", MAX_BYTES)), int(options.get("filesPerPartition", 500)), int(options.get("folders", 256))

    def _entries(self, folder: str, rules: list[tuple[str, str]]) -> tuple[list[tuple[str, str, str]], list[str], list[tuple[str, str]]]:
        """Files and rejects, folders, and the ignore rules that hold inside one folder."""
        at, found, inner = os.path.join(self.root, folder), [], []
        ignore = os.path.join(at, ".gitignore")
        if not self.no_ignore and os.path.isfile(ignore):
            with open(ignore, encoding="utf-8", errors="replace") as file:
                rules = rules + [(folder, line.strip()) for line in file if line.strip() and not line.startswith("#")]
        for entry in sorted(os.scandir(at), key=lambda e: e.name):
            path = posixpath.join(folder, entry.name) if folder else entry.name
            if not self.no_ignore and (entry.name.startswith(".") or ignored(path, entry.is_dir(follow_symlinks=False), rules)):
                continue
            ext = entry.name.rpartition(".")[2].lower()
            if entry.is_symlink():
                if ext in EXTENSIONS:
                    found.append((path, "symlink", os.readlink(entry.path)))
            elif entry.is_dir():
                inner.append(path)
            elif ext not in EXTENSIONS and entry.name not in PACKAGING:
                found.append((path, "unsupported", ext if "." in entry.name else "no extension"))
            else:
                found.append((path, "too-large" if entry.stat().st_size > self.most else "ok", ""))
        return found, inner, rules

    def partitions(self) -> list[_Part]:
        files, open_ = [], [("", [])]
        while open_ and len(open_) < self.folders:
            deeper = []
            for folder, rules in open_:
                found, inner, held = self._entries(folder, rules)
                files += found
                deeper += [(x, held) for x in inner]
            open_ = deeper
        parts = [_Part(files[i : i + self.per]) for i in range(0, len(files), self.per)]
        return parts + [_Part([], folder, rules) for folder, rules in open_] or [_Part([])]

    def _walk(self, folder: str, rules: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        found, inner, held = self._entries(folder, rules)
        yield from found
        for x in inner:
            yield from self._walk(x, held)

    def read(self, part: _Part) -> Iterator[tuple]:
        for path, status, detail in part.paths if part.folder is None else self._walk(part.folder, part.rules):
            at = os.path.join(self.root, path)
            if status != "ok":
                yield path, status, os.lstat(at).st_size, None, detail
                continue
            with open(at, "rb") as file:
                raw = file.read()
            try:
                yield path, "ok", len(raw), raw.decode("utf-8"), ""
            except UnicodeDecodeError as e:
                yield path, "unreadable", len(raw), None, str(e)


class WorkspaceSource(DataSource):
    """spark.read.format("workspace").load(folder): one row for each file, rejects included. Unlike the built-in file sources it returns names that begin with an underscore."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """Files and rejects of a folder."""
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspace").options(**{k: str(v) for k, v in options.items()}).load(root)


def from_map(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """S8."""
    return spark.createDataFrame([(p, t) for p, t in sorted(files.items())], "path string, text string")


def language_of(path: Column) -> Column:
    """S3, before charts are known."""
    ext = S.extension(path)
    out = F.lit(None).cast("string")
    for lang, names in LANGUAGES.items():
        out = F.when(ext.isin(names.split()), lang).otherwise(out)
    return out


def with_languages(files: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Language of every file; YAML in a chart's templates folder is Helm. Files of no known language go; `only` keeps some languages."""
    charts = files.where(S.file_name(F.col("path")) == "Chart.yaml").select(S.parent(F.col("path")).alias("__chart")).distinct().withColumn("__is", F.lit(True))
    lang = files.withColumn("language", language_of(F.col("path"))).where("language is not null")
    folder = F.regexp_extract("path", r"^(?:(.*)/)?templates/", 1)
    in_templates = F.col("path").rlike(r"(^|/)templates/") & F.col("language").isin("yaml", "helm")
    # Only files of templates folders meet the charts: with a null key, all others would go to one task.
    marked = lang.where(in_templates).withColumn("__chart", folder).join(charts, "__chart", "left").withColumn("language", F.when(F.col("__is"), "helm").otherwise(F.col("language"))).drop("__chart", "__is")
    out = lang.where(~in_templates).unionByName(marked)
    return out.where(F.col("language").isin(only)) if only else out


def census(files: DataFrame) -> DataFrame:
    """(ext, n) of files that no language has."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(~ext.isin(list(EXTENSIONS))).groupBy(F.when(ext == "", "no extension").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def split_by_size(files: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(kept, too large)."""
    return files.where(F.octet_length("text") <= most), files.where(F.octet_length("text") > most)


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as a workspace of HTML files."""
    return pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
