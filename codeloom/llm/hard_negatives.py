"""Hard negatives by a pivot table.

Vectors become integers, and a vector x is augmented by sqrt(M - x.x), where M is the largest squared norm; an anchor q
is augmented by 0. Then the squared distance of q and x is q.q + M - 2 q.x: the order by inner product is the order by
distance. A table stores every row's distances to `pivots` rows, which are chosen in turn, each farthest from those
before, from at most `sample` rows. By the triangle inequality, the differences and sums of stored distances bracket the
distance of an anchor and a row and so their score; rows whose bracket can't be among the wanted ones go unread, first
block by block and then one by one, and the scores of the rest are computed exactly.

The table is cut into blocks of about `block` rows of one label with the same nearest pivot. Anchors are taken in blocks
of about `anchors`, which are broadcast; each meets the table's blocks where they lie, without a shuffle. What a task
hands on are the best rows of each anchor; scores on the sample give a bound that they must reach.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Components beyond
2^31 / sqrt(2 * dimensions) take that value, so that scores are exact 64-bit integers. Of vectors of unequal length, the
shorter are continued by 0. Rows are told apart by themselves: repeated rows and ids are rows of their own, a row is never
its own positive, and null ids are no anchors and come last among ties. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stash, rows_of, stash

#: An id above all others, for rows without one.
_NONE = 2**63 - 1
_FOUND = "anchor bigint, place int, score bigint, id bigint, row bigint"


def vectors(table: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(row, id, label, q) of the rows that take part; q are whole numbers."""
    v = F.col(vector_col)
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.alias("v"))
    rows = rows.where("label IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = F.floor(F.lit(2.0**31) / F.sqrt(2.0 * F.greatest(F.size("v"), F.lit(1))))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, most.cast("double")), -most.cast("double"))).cast("bigint")
    return stash(rows.select("row", "id", "label", F.transform("v", whole).alias("q")), "vectors")


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of int64, continued by 0."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = np.asarray(lists.flatten())
    return out


class Pivots:
    """Pivots, and distances to them of rows and of anchors; m is the largest squared norm of all rows."""

    def __init__(self, sample: np.ndarray, m: int, number: int) -> None:
        self.m = float(m)
        rows = self._augmented(sample.astype(np.float64))
        chosen = [0]
        near = np.linalg.norm(rows - rows[0], axis=1)
        while len(chosen) < min(number, len(rows)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        self.at = rows[chosen]

    def _augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.m - (x * x).sum(1, keepdims=True), 0))])

    def _from(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (self.at * self.at).sum(1)[None, :] - 2 * x @ self.at.T
        return np.sqrt(np.maximum(square, 0))

    def of_rows(self, q: np.ndarray) -> np.ndarray:
        return self._from(self._augmented(q.astype(np.float64)))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._from(np.hstack([q.astype(np.float64), np.zeros((len(q), 1))]))


class Block:
    """Rows of one label, with their distances to the pivots."""

    def __init__(self, label: int, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, far: np.ndarray, exact: bool) -> None:
        self.label, self.rows, self.ids, self.q, self.far = label, rows, ids, q.astype(np.float64) if exact else q, far
        self.low, self.high = far.min(0), far.max(0)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.q[at] @ q.astype(self.q.dtype)).astype(np.int64)


class Search:
    """The wanted rows of some anchors, as blocks go by. want: at most so many rows for each place of an anchor.

    A place is a range of scores; without any, an anchor has one place, of rows of its own label. With ranges, rows of
    other labels are wanted.
    """

    def __init__(self, anchors: list, m: int, want: int, ranges: list | None, slack: float) -> None:
        self.anchors, self.m, self.want, self.ranges, self.slack = anchors, m, want, ranges, slack
        count = lambda i: 1 if ranges is None else len(ranges[i])
        self.best = [[np.zeros((3, 0), np.int64)] * count(i) for i in range(len(anchors))]
        self.least = [[-(2**63)] if ranges is None else [-(-80 * p // 100) for p in ranges[i]] for i in range(len(anchors))]
        self.squares = np.array([float((a[3].astype(np.float64) ** 2).sum()) for a in anchors]) + float(m)
        self.far = np.array([a[4] for a in anchors]).reshape(len(anchors), -1)
        self.seen = self.checked = 0

    def meet(self, block: Block) -> None:
        if not len(self.anchors):
            return
        # The least distance from each anchor to any row of the block.
        apart = np.maximum(np.maximum(self.far - block.high, block.low - self.far), 0).max(1)
        upper = (self.squares - apart * apart) / 2 + self.slack
        for i, (_, row, label, q, _) in enumerate(self.anchors):
            if (label == block.label) != (self.ranges is None) or not self.least[i] or upper[i] < min(self.least[i]):
                continue
            differ = np.abs(block.far - self.far[i]).max(1)
            stay = (self.squares[i] - differ * differ) / 2 + self.slack >= min(self.least[i])
            if self.ranges is not None:
                sums = (block.far + self.far[i]).min(1)
                stay &= (self.squares[i] - sums * sums) / 2 - self.slack <= max(self.ranges[i])
            at = np.flatnonzero(stay & (block.rows != row))
            self.seen, self.checked = self.seen + len(stay), self.checked + len(at)
            if len(at):
                self._take(i, at, block.scores(at, q), block)

    def _take(self, i: int, at: np.ndarray, scores: np.ndarray, block: Block) -> None:
        for j, least in enumerate(self.least[i]):
            ok = scores >= least
            if self.ranges is not None:
                ok &= scores <= self.ranges[i][j]
            if ok.any():
                both = np.hstack([self.best[i][j], np.stack([scores[ok], block.ids[at[ok]], block.rows[at[ok]]])])
                both = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.want]]
                self.best[i][j] = both
                if both.shape[1] == self.want:
                    self.least[i][j] = max(least, int(both[0, -1]))


def pivot_table(rows: DataFrame, pivots: Pivots, dims: int, block: int) -> DataFrame:
    """(label, ids, rows, q, far) of blocks of about `block` rows of one label and nearest pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            q = matrix(b.column(3), dims)
            far = shared.value.of_rows(q)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(far.argmin(1).astype(np.int32)), pa.array([x.tobytes() for x in q], pa.binary()), pa.array([x.tobytes() for x in far], pa.binary())], names=["row", "id", "label", "cell", "q", "far"])

    placed = stash(rows.mapInArrow(run, "row bigint, id bigint, label bigint, cell int, q binary, far binary"), "pivot-rows")
    counts = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = placed.join(counts, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    number = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Dealt by the group's key, so that grouping needs no shuffle of its own.
    grouped = dealt.repartition(number, "label", "cell", "part").groupBy("label", "cell", "part")
    out = stash(grouped.agg(F.collect_list(F.struct("row", F.coalesce("id", F.lit(_NONE)).alias("id"), "q", "far")).alias("rows")), "pivot-table")
    drop_stash(placed)
    return out


def searched(table: DataFrame, anchors: list, m: int, want: int, ranges: list | None, least: list, dims: int, exact: bool, slack: float) -> DataFrame:
    """(anchor, place, score, id, row): of each task's blocks, at most `want` rows a place."""
    shared = table.sparkSession.sparkContext.broadcast((anchors, ranges, least))

    def run(batches):
        anchors, ranges, least = shared.value
        search = Search(anchors, m, want, ranges, slack)
        search.least = [list(x) for x in least]
        for label, held in rows_of(batches):
            search.meet(read_block(label, held, dims, exact))
        for i, places in enumerate(search.best):
            for j, x in enumerate(places):
                if n := x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int64()), pa.array(np.full(n, j), pa.int32()), *map(pa.array, x)], names=["anchor", "place", "score", "id", "row"])

    return table.select("label", "rows").mapInArrow(run, _FOUND)


def read_block(label: int, held: list[dict], dims: int, exact: bool) -> Block:
    whole = lambda name, kind: np.frombuffer(b"".join(x[name] for x in held), kind).reshape(len(held), -1)
    q = whole("q", np.int64) if dims else np.zeros((len(held), 0), np.int64)
    return Block(label, np.array([x["row"] for x in held]), np.array([x["id"] for x in held]), q, whole("far", np.float64), exact)


def _best(found: DataFrame, want: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchor: Column | None = None, *, positives: int = 5, negatives: int = 5, pivots: int = 16, sample: int = 2048, block: int = 2048, anchors: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For every anchor its `positives` best other rows of the same label, and for each of them the `negatives` best rows of
    other labels whose score is from 80 to 100 percent of the positive's.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    label = F.col("label") if label is None else label
    rows = vectors(table, label, id_col, vector_col)
    chosen = (F.col("id") % 100 == 0) if anchor is None else anchor
    square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    # The sums are of doubles: M is made a little larger, which brackets allow.
    n, marked, dims, m = rows.agg(F.count("*"), F.count_if(chosen), F.max(F.size("q")), F.max(square)).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    out = spark.createDataFrame([], schema)
    if not marked:
        return out
    m = m * (1 + 1e-9) + 1
    exact, slack = m < 2**52, 1 + 1e-7 * m
    part = -(2**63) + int(min(1.0, 1.5 * sample / n + 20 / n) * (2**64 - 1))
    drawn = rows.where(F.xxhash64("row", F.lit(5)) <= F.lit(min(part, _NONE))).orderBy(F.xxhash64("row", F.lit(5)), "row").limit(sample).collect()  # at most `sample` rows
    full = lambda q: np.pad(np.array(q, np.int64), (0, dims - len(q)))
    drawn_q = np.array([full(r["q"]) for r in drawn]).reshape(len(drawn), dims)
    pivot = Pivots(drawn_q, m, pivots)
    held = pivot_table(rows, pivot, dims, block)
    far = pivot.of_rows(drawn_q)
    tests = []
    for v in sorted({r["label"] for r in drawn}):
        at = [i for i, r in enumerate(drawn) if r["label"] == v]
        tests.append(Block(v, np.array([drawn[i]["row"] for i in at]), np.array([_NONE if drawn[i]["id"] is None else drawn[i]["id"] for i in at]), drawn_q[at], far[at], exact))

    def bounds(group: list, want: int, ranges: list | None) -> list:
        """For each place a score that its last wanted row can't be under, from the sample."""
        search = Search(group, m, want, ranges, slack)
        for b in tests:
            search.meet(b)
        return search.least

    blocks = -(-marked // anchors)
    for k in range(blocks):
        got = rows.where(chosen).where(F.pmod(F.xxhash64("row", F.lit(9)), F.lit(blocks)) == k).collect()  # about `anchors` rows
        q = np.array([full(r["q"]) for r in got]).reshape(len(got), dims)
        group = [(r["id"], r["row"], r["label"], x, d) for r, x, d in zip(got, q, pivot.of_anchors(q))]
        if not group:
            continue
        best = _best(searched(held, group, m, positives, None, bounds(group, positives, None), dims, exact, slack), positives).orderBy("anchor", "rank").collect()  # at most `positives` an anchor
        scores: list[list[int]] = [[] for _ in group]
        for r in best:
            scores[r["anchor"]].append(r["score"])
        names = spark.createDataFrame([(r["anchor"], r["rank"] - 1, group[r["anchor"]][0], None if r["id"] == _NONE else r["id"], r["score"]) for r in best], "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = stash(_best(searched(held, group, m, negatives, scores, bounds(group, negatives, scores), dims, exact, slack), negatives), "negatives")
        pairs = found.join(F.broadcast(names), ["anchor", "place"])  # as many rows as positives of one block of anchors
        out = out.union(pairs.select("anchor_id", "positive_id", "rank", F.when(F.col("id") != _NONE, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


NEGATIVES_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v a, v WHERE a.vec_id % 100 = 0 AND a.r <> v.r),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.ar, pr ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.ar = s.ar AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
