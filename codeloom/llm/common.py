"""Shared plumbing: tables, the shared folder for cut lineage, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, \x20 and \x09-\x0D: what bytes.split() and bytes.strip() take for white space too.
SPACE = " \t\n\x0b\x0c\r"
#: No Arrow batch sent to Python is larger than this, whatever its rows hold.
BATCH_BYTES = "8m"

_own: list[str] = []
#: For each stashed_alone() that runs, the paths stashed in it. No DataFrame is kept here: each holds the names of its files in the driver.
_made: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes and rows, so that a run of long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """docs with a bigint that names each row, its column's name, and whether that is just the id.

    It is the id where every row has one of its own. Otherwise rows are numbered, and written to the shared folder so
    that a number stays with its row however often it is read.
    """
    row = fresh("__row", docs)
    if docs.groupBy(F.col(id_col)).count().where(F.col("count") > 1).isEmpty() and docs.where(F.col(id_col).isNull()).isEmpty():
        return docs.withColumn(row, F.col(id_col).cast("bigint")), row, True
    return stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row, False


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and driver and executors are one process, as in tests, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="codeloom-"))
            atexit.register(shutil.rmtree, _own[0], True)
        at = f"file://{_own[0]}"
    return at


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _made:
        _made[-1].append(path)
    return out


def stashed_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stash(make()), and then deletes every other table that make() stashed: what it gave is whole on disk."""
    _made.append([])
    try:
        out = stash(make(), name)
    finally:
        paths = _made.pop()
    for path in paths:
        if path != out._stash_path:
            _delete(out.sparkSession, path)
    if _made:
        _made[-1].append(out._stash_path)
    return out


def drop_stash(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    if path := getattr(df, "_stash_path", None):
        _delete(df.sparkSession, path)
        df._stash_path = None
        for paths in _made:
            if path in paths:
                paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def task_id() -> int:
    return TaskContext.get().partitionId()


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def emitter(schema: pa.Schema, rows: int = 4000, size: int = 8 << 20):
    """put(row, bytes) collects rows; it returns a batch whenever enough have come. flush() returns the rest."""
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        nonlocal weight
        columns = list(zip(*held)) if held else [()] * len(schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        held.clear()
        weight = 0
        return out

    def put(row: tuple, nbytes: int = 64) -> list[pa.RecordBatch]:
        nonlocal weight
        held.append(row)
        weight += nbytes
        return [batch()] if len(held) >= rows or weight >= size else []

    def flush() -> list[pa.RecordBatch]:
        return [batch()] if held else []

    return put, flush


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, z): whole texts compressed before they are shuffled, null as empty."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze(utf8(t)) for t in b.column(1).to_pylist()], pa.binary())], names=[id_col, "z"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _roots(up: DataFrame) -> DataFrame:
    """(node, root, moved) of (node, root) where roots may be nodes again: each goes on to the last, twice as far every time."""
    while True:
        ahead = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = stash(up.select("node", "root").join(ahead, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        drop_stash(up)
        up = after
        if up.where("moved").isEmpty():
            return up


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in links (u, v): the smallest node that can be reached.

    Each round, a node goes to its least neighbour, if that is less, and on from there to one that has no lesser neighbour. Links are then drawn anew between those, and links within one go, so that rounds don't read all links again. Two rounds halve the nodes at least. Every round aggregates before it shuffles and is written to the shared folder.
    """

    def drawn(df: DataFrame) -> DataFrame:
        return stash(df.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")

    left, levels = drawn(links), []
    while not left.isEmpty():
        if len(levels) == rounds:
            raise RuntimeError("components did not settle")
        roots = _roots(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")))
        levels.append(roots)
        ru, rv = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("u", "v"))
        after = drawn(left.join(ru, "u", "left").join(rv, "v").select(F.coalesce("ru", "u").alias("u"), F.col("rv").alias("v")))
        drop_stash(left)
        left = after
    if not levels:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    drop_stash(left)
    # A node went at one level only, to one that went at a later level or at none.
    labels = levels.pop()
    while levels:
        lower, ahead = levels.pop(), labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = stash(lower.select("node", "root").join(ahead, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(labels.select("node", "root")), "labels")
        drop_stash(lower)
        drop_stash(labels)
        labels = after
    own = labels.select("root").distinct()
    out = stash(labels.select("node", F.col("root").alias("component")).union(own.select("root", "root")), "labels")
    drop_stash(labels)
    return out
