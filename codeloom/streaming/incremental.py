"""Incremental indexing with Structured Streaming.

An addition of this engine, on top of the content-addressed cache (K6): files that arrive as rows (path, language, text)
are extracted only if no stored facts have their language and content. Facts are kept by content key, and a second table
says which path has which key, so renamed and repeated files cost a row each. A micro-batch that is run again appends
path rows that change nothing.

Facts lie in a partition for each version of the extractors (H4): facts that other rules made are never served, and what
they were made from is extracted again when it comes, or when `stale` asks for it. `compact` rewrites the partition of
this version without repeats and drops the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facts import extracted, fingerprint, missing_from_cache

MANIFEST = "path string, language string, text string"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _facts(spark: SparkSession, store: str) -> DataFrame | None:
    """Facts of this version of the extractors, without their version."""
    found = _read(spark, f"{store}/facts")
    return None if found is None else found.where(F.col("version") == fingerprint()).drop("version")


def index_batch(batch: DataFrame, store: str, number: int = 0) -> None:
    """Facts of new contents go to store/facts by version and key; which path has which content goes to store/paths."""
    spark = batch.sparkSession
    keyed = batch.withColumn("key", F.sha2(F.concat("language", F.lit("\0"), "text"), 256))
    known = _facts(spark, store)
    once = keyed.dropDuplicates(["key"])
    new = missing_from_cache(once.drop("key"), known if known is not None else once.limit(0))
    made = extracted(new).join(once.select("path", "key"), "path").drop("path").withColumn("version", F.lit(fingerprint()))
    made.write.mode("append").partitionBy("version").parquet(f"{store}/facts")
    keyed.select("path", "key", F.lit(number).cast("bigint").alias("batch")).write.mode("append").parquet(f"{store}/paths")


def _latest(spark: SparkSession, store: str) -> DataFrame:
    """(path, key): the content of every path in its latest batch; a batch that comes late changes nothing."""
    return spark.read.parquet(f"{store}/paths").groupBy("path").agg(F.max_by("key", F.struct("batch", "key")).alias("key"))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """Facts of every path, as its latest batch left it; files of equal content share what was stored once. Paths of stale facts are missing."""
    return _latest(spark, store).join(_facts(spark, store).dropDuplicates(["key"]), "key").drop("key")


def stale(spark: SparkSession, store: str) -> DataFrame:
    """Paths whose content no extractors of this version have seen: they must come again."""
    return _latest(spark, store).join(_facts(spark, store).select("key").distinct(), "key", "left_anti").select("path")


def compact(spark: SparkSession, store: str, files: int = 1) -> None:
    """Rewrites the facts of this version without repeats, in so many files, and drops those of others.

    The new facts are whole in store/compacted before old ones go, and are moved by one rename.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{store}/{x}")
    fs = path("").getFileSystem(conf)
    once = _facts(spark, store).dropDuplicates(["key"]).withColumn("version", F.lit(fingerprint()))
    once.repartition(files, "key").write.mode("overwrite").partitionBy("version").parquet(f"{store}/compacted")
    fs.rename(path("facts"), path("replaced"))
    fs.rename(path("compacted"), path("facts"))
    fs.delete(path("replaced"), True)


def start(spark: SparkSession, manifest: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follows a folder of Parquet manifests."""
    stream = spark.readStream.schema(MANIFEST).parquet(manifest)
    writer = stream.writeStream.foreachBatch(lambda df, number: index_batch(df, store, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event counts by tumbling window with a watermark; the same plan serves batch and stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
