"""Ranking and frame operators (W rows): precedence with losers kept, neighbours, runs, overlaps, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def competition(sources: DataFrame, subject: str, order: list[Column]) -> DataFrame:
    """Every source of a subject with its place; the first wins and the losers stay. Without a participant nothing wins."""
    return sources.withColumn("place", F.row_number().over(Window.partitionBy(subject).orderBy(*order))).withColumn("wins", F.col("place") == 1)


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as an aggregation that combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    out = df.groupBy(*keys).agg(F.min(ordered).alias("__b"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__b.{c}").alias(c) for c in df.columns])


def next_sibling(df: DataFrame, keys: list[str], at: str, name: str = "next_at") -> DataFrame:
    """Where the next row of the same keys begins."""
    return df.withColumn(name, F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def overlapping(spans: DataFrame, keys: list[str], start: str, end: str, ties: list[str] = ()) -> DataFrame:
    """Spans that begin before an earlier one of the same keys has ended; `ties` says which of equal spans is the earlier."""
    w = Window.partitionBy(*keys).orderBy(start, end, *[F.asc_nulls_last(c) for c in ties]).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__e", F.max(end).over(w)).where(F.col(start) < F.col("__e")).drop("__e")


def runs(df: DataFrame, keys: list[str], at: str, breaks: Column) -> DataFrame:
    """Numbers the contiguous runs of each key; `breaks` says of a row and `previous` (the value before) whether a new run begins."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("previous", F.lag(at).over(w)).withColumn("run", F.sum(F.when(F.col("previous").isNull() | breaks, 1).otherwise(0)).over(w)).drop("previous")


def css_cascade(declarations: DataFrame, subject: str) -> DataFrame:
    """Important, then layer, specificity (a struct) and, only inside one file, source order. Where the best come from several files nothing is decided.

    Columns: important boolean, layer int (unlayered highest; reversed for important ones), specificity struct<int,int,int>, path, start.
    """
    strength = F.struct(F.col("important").cast("int").alias("i"), F.when(F.col("important"), -F.col("layer")).otherwise(F.col("layer")).alias("l"), F.col("specificity").alias("s"))
    w = Window.partitionBy(subject)
    top = declarations.withColumn("__s", strength).withColumn("__top", F.max("__s").over(w))
    best = F.col("__s") == F.col("__top")
    files = F.size(F.collect_set(F.when(best, F.col("path"))).over(w))
    last = F.max(F.when(best, F.col("start"))).over(w)
    return top.withColumn("decided", files == 1).withColumn("wins", best & (files == 1) & (F.col("start") == last)).withColumn("reason", F.when(files == 1, F.lit(None).cast("string")).otherwise("equal rules in several files")).drop("__s", "__top")


def capped(df: DataFrame, keys: list[str], order: list, most: int, item: str) -> DataFrame:
    """For each key the count of its rows and its first `most` items in order; no more of a key are held together."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first = F.sort_array(F.collect_list(F.when(F.col("__n") <= most, F.struct("__n", item))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("total"), F.transform(first, lambda x: x[item]).alias("first"))
