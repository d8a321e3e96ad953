"""Resolution as relational operators: ranked candidates, uniqueness, confidence tiers (J1-J3, A13 and kin).

Every function is generic over key columns, so that the same plan resolves code references and any other keys.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, IMPORTED, FIELD, NAME = range(4)
TIERS = ["exact", "import-qualified", "field-based", "name-only"]


def tier_name(confidence: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), confidence.cast("int") + 1)


def with_key(rows: DataFrame, key: str, other: DataFrame, row_id: str, on: list[str] = ()) -> DataFrame:
    """Left join on a string key that many rows lack. Those match nothing, so they are dealt by their id; as nulls they would all go to one task."""
    dealt = rows.withColumn("__key", F.coalesce(key, F.concat(F.lit("\0"), row_id)))
    return dealt.join(other.withColumnRenamed(key, "__key"), ["__key", *on], "left").drop("__key")


def answers(candidates: DataFrame, key: str, target: str, rank: int, hit: int, ambiguous: int = NAME, keep_first: bool = False, order: list | None = None) -> DataFrame:
    """The answer of one rule for each key that has candidates: the only one at tier `hit`; of several the first, or none, at tier `ambiguous`.

    One grouped aggregation with map-side combining, whatever the number of candidates of a key.
    """
    best = F.min(F.struct(*(order or [F.col(target)]), F.col(target).alias("__t"))).alias("best")
    grouped = candidates.groupBy(key).agg(best, F.count_distinct(target).alias("n"))
    chosen = F.when((F.col("n") == 1) | F.lit(keep_first), F.col("best.__t"))
    return grouped.select(key, chosen.alias(target), F.when(F.col("n") == 1, hit).otherwise(ambiguous).cast("int").alias("confidence"), F.lit(rank).alias("rule"))


def answers_by(keys: DataFrame, key: str, by: str, candidates: DataFrame, target: str, rank: int, hit: int, ambiguous: int = NAME, keep_first: bool = False) -> DataFrame:
    """The `answers` of keys whose candidates are all those with an equal value of `by`: found once for each value, before keys meet them.

    Pairs of keys and candidates are only made for a key that stands with several values.
    """
    rule = rank, hit, ambiguous, keep_first
    values = keys.groupBy(key).agg(F.min(by).alias(by), F.max(by).alias("__most"))
    once = values.where(F.col(by) == F.col("__most")).select(key, by).join(answers(candidates, by, target, *rule), by).drop(by)
    several = keys.join(values.where(F.col(by) < F.col("__most")).select(key), key, "left_semi").select(key, by).distinct()
    return once.unionByName(answers(several.join(candidates.select(by, target), by), key, target, *rule))


def first_answer(keys: DataFrame, key: str, target: str, rules: list[DataFrame]) -> DataFrame:
    """For each key the answer of the lowest rule that has one, a deliberate non-answer included; keys without any get none at the weakest tier."""
    found = reduce(DataFrame.unionByName, rules)
    won = found.groupBy(key).agg(F.min_by(F.struct(target, "confidence", "rule"), "rule").alias("won"))
    out = keys.join(won, key, "left")
    return out.select(*keys.columns, F.col(f"won.{target}").alias(target), F.coalesce("won.confidence", F.lit(NAME)).alias("confidence"), F.coalesce("won.rule", F.lit(99)).alias("rule"))


def cap(resolved: DataFrame, untyped: Column, least: int = FIELD) -> DataFrame:
    """Answers on receivers of unknown type are no stronger than `least`; the target stays."""
    return resolved.withColumn("confidence", F.when(untyped, F.greatest("confidence", F.lit(least))).otherwise(F.col("confidence")))


def _sweep(inner: DataFrame, outer: DataFrame, on: list[str], key: str, start: str, end: str, name: str, at: str, strict: bool, every: bool) -> DataFrame:
    """(key, name): for each point the smallest interval of equal keys `on` that holds it, or every one.

    Intervals and points are laid out by key and place, and one pass keeps the intervals that are open, the smallest on
    top. That is n log n in a key's rows, and holds no more of them than are open at once.
    """
    kinds = dict(inner.dtypes)[key], dict(outer.dtypes)[name]
    order = (1, 0) if strict else (0, 1)  # whether intervals or points come first at one place
    keyed = reduce(Column.__and__, [F.col(c).isNotNull() for c in on])
    spans = outer.where(keyed & (F.col(start) < F.col(end))).select(*on, F.col(start).cast("bigint").alias("__at"), F.lit(order[0]).alias("__side"), F.col(end).cast("bigint").alias("__end"), F.col(name).alias("__name"), F.lit(None).cast(kinds[0]).alias("__key"))
    points = inner.where(keyed & F.col(at).isNotNull()).select(*on, F.col(at).cast("bigint").alias("__at"), F.lit(order[1]).alias("__side"), F.lit(None).cast("bigint").alias("__end"), F.lit(None).cast(kinds[1]).alias("__name"), F.col(key).alias("__key")).distinct()
    laid = spans.unionByName(points).repartition(*on).sortWithinPartitions(*on, "__at", "__side")
    point = order[1]

    def sweep(batches):
        now, open_ = None, []
        for b in batches:
            keys, names = [], []
            for *g, p, side, stop, called, k in zip(*(c.to_pylist() for c in b.columns)):
                if g != now:
                    now, open_ = g, []
                if side != point:
                    heapq.heappush(open_, (stop - p, called, stop))
                    continue
                while open_ and open_[0][2] <= p:
                    heapq.heappop(open_)
                if every and open_:
                    open_ = [x for x in open_ if x[2] > p]
                    heapq.heapify(open_)
                for x in open_ if every else open_[:1]:
                    keys.append(k)
                    names.append(x[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(b.num_columns - 1).type), pa.array(names, b.schema.field(b.num_columns - 2).type)], names=["k", "n"])

    found = laid.select(*on, "__at", "__side", "__end", "__name", "__key").mapInArrow(sweep, f"k {kinds[0]}, n {kinds[1]}")
    return found.select(F.col("k").alias(key), F.col("n").alias(name))


def innermost(inner: DataFrame, outer: DataFrame, on: list[str], key: str, start: str, end: str, name: str, at: str, strict: bool = False) -> DataFrame:
    """The smallest outer interval of equal keys `on` that holds a point, or null; the least name of equally small ones. Null points are in none.

    `strict` leaves out intervals that begin at the point itself.
    """
    return inner.join(_sweep(inner, outer, on, key, start, end, name, at, strict, False), key, "left")


def containing(inner: DataFrame, outer: DataFrame, on: list[str], key: str, start: str, end: str, name: str, at: str) -> DataFrame:
    """(key, name) of every outer interval that holds a point: as many rows as there are such pairs."""
    return _sweep(inner, outer, on, key, start, end, name, at, False, True)


def nearest_preceding(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str], tie: str) -> DataFrame:
    """As-of join: of the right rows with equal keys at or before each left row the latest; null without one.

    One shuffle by key: both sides are laid out together in order and the last right row is carried forward.
    """
    l = left.withColumn("__at", F.col(left_at)).withColumn("__side", F.lit(1)).withColumn("__take", F.lit(None).cast(_struct(right, take))).withColumn("__tie", F.lit(None).cast(dict(right.dtypes)[tie]))  # noqa: E741
    r = right.select(*on, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.struct(*take).alias("__take"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(*on).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__last", F.last("__take", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col(f"__last.{c}").alias(f"prev_{c}") for c in take])


def _struct(df: DataFrame, cols: list[str]) -> str:
    types = dict(df.dtypes)
    return "struct<" + ",".join(f"{c}:{types[c]}" for c in cols) + ">"


def nearest(pairs: DataFrame, key: str, target: str, distance: Column) -> DataFrame:
    """The candidate at the least distance, ties to the lesser target."""
    return pairs.groupBy(key).agg(F.min(F.struct(distance.alias("distance"), F.col(target))).alias("b")).select(key, f"b.{target}", "b.distance")


def nearest_within(rows: DataFrame, on: str, key: str, at: str, target: str) -> DataFrame:
    """J26 for candidates that are the rows of an equal `on` with another key: (key, target), without pairs.

    Each value of a group stands once, with its two least keys. The nearest candidate has the same value or lies on the
    nearest value to either side that another key has. Values without finite distances (infinite, NaN, null in this order,
    as SQL has it) are met by kind. Two values count as equally far only if they are one value or lie on both sides.
    """
    rows = rows.where(F.col(on).isNotNull() & F.col(key).isNotNull()).select(on, key, F.col(at).cast("double").alias("x"))
    finite = F.coalesce(F.abs("x") < float("inf"), F.lit(False))

    def two_least(df: DataFrame) -> DataFrame:
        numbered = df.distinct().withColumn("n", F.row_number().over(Window.partitionBy(on, "x").orderBy(key))).where("n <= 2")
        return numbered.groupBy(on, "x").agg(F.min(key).alias("k1"), F.max(F.when(F.col("n") == 2, F.col(key))).alias("k2"))

    values = two_least(rows.where(finite)).withColumn("only", F.when(F.col("k2").isNull(), F.col("k1"))).withColumn("e", F.struct("x", "k1", "k2"))
    sides = []
    for side, order in (("l", F.col("x").asc()), ("r", F.col("x").desc())):
        w = Window.partitionBy(on).orderBy(order)
        begins = F.col("only").isNull() | F.lag("only").over(w).isNull() | (F.col("only") != F.lag("only").over(w))
        values = values.withColumn("begins", begins).withColumn("before", F.lag("e").over(w))
        values = values.withColumn("other", F.last(F.when(F.col("begins"), F.col("before")), ignorenulls=True).over(w))  # on the last value that has a key besides the only one here
        values = values.withColumn(f"{side}1", F.col("before")).withColumn(f"{side}2", F.lag("other").over(w)).drop("begins", "before", "other")
        sides += [f"{side}1", f"{side}2"]
    met = rows.where(finite).join(values.select(on, "x", "e", *sides), [on, "x"]).select(on, key, "x", F.explode(F.array("e", *sides)).alias("c"))
    kinds = two_least(rows.withColumn("x", F.when(finite, 0.0).otherwise(F.col("x")))).select(on, F.struct("x", "k1", "k2").alias("c"))

    def best(candidates: DataFrame) -> DataFrame:
        other = F.when(F.col("c.k1") != F.col(key), F.col("c.k1")).otherwise(F.col("c.k2"))
        far = F.abs(F.col("x") - F.col("c.x"))
        return candidates.select(key, F.struct(far.isNull().alias("unknown"), far.alias("far"), other.alias(target)).alias("b")).where(F.col(f"b.{target}").isNotNull()).groupBy(key).agg(F.min("b").alias("b"))

    near = best(met)
    odd = rows.where(~finite).union(rows.where(finite).join(near.select(key), key, "left_anti").select(on, key, "x"))
    found = near.union(best(odd.join(kinds, on)))
    return found.groupBy(key).agg(F.min("b").alias("b")).select(key, f"b.{target}")


def divide(have: DataFrame, need: DataFrame, owner: str, item: str, group: str | None = None) -> DataFrame:
    """Owners (with the group) that have every item needed: counts of matches against counts of needs, no pairs of owners and groups without a match."""
    keys = [group] if group else []
    wanted = need.select(*keys, item).distinct()
    got = have.select(owner, item).distinct().join(wanted, item).groupBy(owner, *keys).agg(F.count("*").alias("__got"))
    joined = got.join(wanted.groupBy(*keys).agg(F.count("*").alias("__need")), keys) if keys else got.withColumn("__need", F.lit(wanted.count()))
    return joined.where("__got = __need").select(owner, *keys)


def divide_loosely(have: DataFrame, need: DataFrame, owner: str, item: str, group: str, detail: str) -> DataFrame:
    """(owner, group) of owners that have every item of a group, in a detail that agrees; a null detail agrees with all.

    have has one row an owner and item, need one a group and item. Only owners of a group's rarest item are looked at, so
    items that everybody has make no pairs.
    """
    have = have.select(owner, item, F.col(detail).alias("__h")).dropDuplicates([owner, item])
    need = need.select(group, item, F.col(detail).alias("__n")).dropDuplicates([group, item])
    counted = need.join(have.groupBy(item).agg(F.count("*").alias("__have")), item, "left").withColumn("__have", F.coalesce("__have", F.lit(0)))
    rarest = counted.groupBy(group).agg(F.min(F.struct("__have", item, "__n")).alias("b"), F.count("*").alias("__need")).select(group, "__need", f"b.{item}", "b.__n")
    agree = F.col("__h").isNull() | F.col("__n").isNull() | (F.col("__h") == F.col("__n"))
    likely = have.join(rarest, item).where(agree).select(owner, group, "__need")
    rest = likely.join(need, group).join(have, [owner, item]).where(agree)
    return rest.groupBy(owner, group).agg(F.count("*").alias("__got"), F.first("__need").alias("__need")).where("__got = __need").select(owner, group)


def with_orphans(left: DataFrame, right: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """Left rows with their sorted matches; without any they are orphans."""
    lists = right.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias(name))
    return left.join(lists, key, "left").withColumn("orphan", F.col(name).isNull()).withColumn(name, F.coalesce(name, F.array().cast(f"array<{dict(right.dtypes)[item]}>")))


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """Every ancestor folder of a path with its distance; the top is the empty string."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return paths.withColumn("__p", parts).select(*paths.columns, F.explode(F.transform(F.sequence(F.lit(0), F.size("__p")), lambda i: F.struct(F.array_join(F.slice(F.col("__p"), F.lit(1), i), "/").alias("ancestor"), (F.size("__p") - i).alias("distance")))).alias("__a")).select(*paths.columns, "__a.ancestor", "__a.distance")


def nearest_folder(paths: DataFrame, path: str, folders: DataFrame, folder: str, take: str) -> DataFrame:
    """What the nearest ancestor folder offers; the least of several in one folder."""
    up = ancestors(paths.select(path).distinct(), path)
    best = up.join(folders.select(F.col(folder).alias("ancestor"), take), "ancestor").groupBy(path).agg(F.min(F.struct("distance", take)).alias("b"))
    return paths.join(best.select(path, F.col(f"b.{take}").alias(take)), path, "left")


def longest_suffix_folder(wanted: DataFrame, path: str, folders: DataFrame, folder: str) -> DataFrame:
    """The folder that ends with the longest suffix of a package path; null where several do."""
    suffix = wanted.select(path).distinct().withColumn("__p", F.split(path, "/")).withColumn("__k", F.explode(F.sequence(F.lit(1), F.size("__p"))))
    suffix = suffix.select(path, F.col("__k"), F.array_join(F.slice("__p", F.size("__p") - F.col("__k") + 1, F.col("__k")), "/").alias("suffix"))
    ends = folders.select(folder).distinct().withColumn("__f", F.split(folder, "/")).withColumn("__n", F.explode(F.sequence(F.lit(1), F.size("__f"))))
    ends = ends.select(folder, F.array_join(F.slice("__f", F.size("__f") - F.col("__n") + 1, F.col("__n")), "/").alias("suffix"))
    hits = suffix.join(ends, "suffix").groupBy(path, "__k").agg(F.min(folder).alias(folder), F.count_distinct(folder).alias("n"))
    best = hits.groupBy(path).agg(F.max_by(F.struct(folder, "n"), "__k").alias("b"))
    return wanted.join(best.select(path, F.when(F.col("b.n") == 1, F.col(f"b.{folder}")).alias(folder)), path, "left")
