"""Q12, L2, L3: maximal clones: a greedy cover, settled in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def greedy_cover(members: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(class, path, start, end, tokens) of the copies that are reported.

    members has (class, path, start, end, tokens, depth): spans of a file lie inside or outside each other, and the copies
    of a class have as many tokens. In order of (tokens descending, depth, path and start of its first copy), a class
    gives up the copies that lie inside copies of accepted classes, and is accepted if two are left.

    That order is not walked class by class. What may take a copy from a class are classes that have a copy around it, so
    a class is settled as soon as no class that isn't settled yet has one around any of its copies. A round settles all
    such classes: two running maxima over a file's spans, and one aggregation by class. There are as many rounds as
    copies are nested in each other.
    """
    first = F.min(F.struct("path", "start", "depth")).alias("first")
    rank = members.groupBy("class").agg(first).select("class", F.col("first.depth").alias("d"), F.col("first.path").alias("p"), F.col("first.start").alias("s"))
    # Where copies of two classes are the same span, which have as many tokens, the earlier class is around the later one.
    open_ = cut(members.join(rank, "class").select("class", "path", "start", "end", "tokens", F.struct("d", "p", "s", "class").alias("order"), F.lit(False).alias("taken")))
    taken = open_.limit(0)
    inside = Window.partitionBy("path").orderBy("start", F.desc("end"), "order").rowsBetween(Window.unboundedPreceding, -1)
    around = lambda which: F.coalesce(F.max(F.when(which, F.col("end"))).over(inside) >= F.col("end"), F.lit(False))
    for _ in range(rounds):
        if open_.isEmpty():
            return taken.select("class", "path", "start", "end", "tokens")
        seen = open_.union(taken).withColumn("waits", around(~F.col("taken"))).withColumn("covered", around(F.col("taken"))).where("not taken")
        state = seen.groupBy("class").agg(F.bool_or("waits").alias("blocked"), F.count_if(~F.col("covered")).alias("free"))
        judged = cut(seen.join(state, "class"))
        taken = cut(taken.union(judged.where("not blocked and free > 1 and not covered").select(*open_.columns[:-1], F.lit(True).alias("taken"))))
        open_ = cut(judged.where("blocked").select(*open_.columns))
    raise RuntimeError("the cover did not settle")
