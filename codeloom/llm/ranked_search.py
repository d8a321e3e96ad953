"""Ranked lexical search by MaxScore per shard.

Terms are the maximal runs of ASCII letters and digits and of all characters above U+007F, with only A-Z lower-cased.
A first pass reads whole texts once and writes, for each document, its number of terms and the frequencies of those
terms that any item asks for; counts over all documents follow from that table. A second pass reads it in shards of
`shard` documents: postings by term, each with its largest impact as upper bound. For an item, terms are sorted by upper
bound; those at the low end whose bounds together can't reach the item's k-th best score so far are non-essential. Only
essential postings are read whole; documents found there are looked up in non-essential postings, largest bound first,
while their score and the bounds left can still reach the k-th best. Best scores are kept from shard to shard of a task,
and tasks hand on k rows an item, which Spark ranks.

All documents are searched for all items. Items are taken in blocks of about `most_terms` terms, which bounds what a
worker holds of them; a block reads the documents once.

Defined results: null text has no terms; items and documents are rows, so repeated rows or ids rank separately; at equal
scores smaller ids come first, null ids last; an item without known terms has no rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stash, utf8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_terms = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_BEST = "item_row bigint, score bigint, doc_id bigint, doc_row bigint"


def terms(text: str | None) -> list[bytes]:
    return _terms(utf8(text).translate(_LOWER))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_row, item_id, terms, times): the distinct terms of every item and how often it has each."""

    def run(batches):
        for b in batches:
            found = [Counter(terms(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item_row", "item_id", "terms", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return stash(rows.mapInArrow(run, "item_row bigint, item_id bigint, terms array<binary>, times array<bigint>"), "items")


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_row, doc_id, n, terms, tfs) of every document: its number of terms, and frequencies of those in the vocabulary by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches):
        get = shared.value.get
        for b in batches:
            n, ids, tfs = [], [], []
            for t in b.column(2).to_pylist():
                words = terms(t)
                count = Counter(map(get, words))
                count.pop(None, None)
                n.append(len(words))
                ids.append(list(count))
                tfs.append(list(count.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_row", "doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc_row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stash(rows.mapInArrow(run, "doc_row bigint, doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "postings")


class Shard:
    """Postings of some documents, by term: places of documents in ascending order, impacts, and the largest impact."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, length: int) -> None:
        self.docs = len(n)
        m = 25 + (75 * n * documents) // length
        at = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, at, tfs = terms[order], at[order], tfs[order].astype(np.int64)
        impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[at]))
        self.names, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        self.at, self.impacts = [at[a:b] for a, b in zip(starts, ends)], [impacts[a:b] for a, b in zip(starts, ends)]
        self.most = np.array([x.max() for x in self.impacts], np.int64)

    def search(self, asked: np.ndarray, times: np.ndarray, least: int, count: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents with a score of at least `least`, and 1. count: gets the postings read and probed."""
        none = np.zeros(0, np.int64)
        if not len(self.names):
            return none, none
        place = np.minimum(np.searchsorted(self.names, asked), len(self.names) - 1)
        here = self.names[place] == asked
        place, times = place[here], times[here]
        bounds = times * self.most[place]
        order = np.argsort(bounds, kind="stable")
        place, times, reach = place[order], times[order], np.cumsum(bounds[order])
        essential = int(np.searchsorted(reach, least, "left"))  # bounds before it together stay under `least`
        if essential == len(place):
            return none, none
        scores = np.zeros(self.docs, np.int64)
        for p, k in zip(place[essential:], times[essential:]):
            scores[self.at[p]] += k * self.impacts[p]
        found = np.flatnonzero(scores)
        scores = scores[found]
        for i in range(essential - 1, -1, -1):
            stay = scores + reach[i] >= least
            found, scores = found[stay], scores[stay]
            if not len(found):
                break
            at = self.at[place[i]]
            where = np.minimum(np.searchsorted(at, found), len(at) - 1)
            scores = scores + np.where(at[where] == found, times[i] * self.impacts[place[i]][where], 0)
            if count is not None:
                count["probed"] += len(found)
        if count is not None:
            count["read"] += sum(len(self.at[p]) for p in place[essential:])
            count["all"] += sum(len(self.at[p]) for p in place)
        stay = scores >= max(least, 1)
        return found[stay], scores[stay]


def best_of_shards(table: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int, shard: int) -> DataFrame:
    """At most k rows an item and task: (item_row, score, doc_id, doc_row)."""
    shared = table.sparkSession.sparkContext.broadcast((asked, weights))

    def shards(batches):
        held, rows = [], 0
        for b in batches:
            for i in range(0, b.num_rows, shard):
                held.append(b.slice(i, shard))
                rows += held[-1].num_rows
                if rows >= shard:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        items, w = shared.value
        best = [(np.zeros((4, 0), np.int64), 0) for _ in items]
        for t in shards(batches):
            whole = lambda name: np.concatenate([np.asarray(c.flatten()) for c in t[name].chunks] or [np.zeros(0, np.int32)])
            sizes = np.concatenate([np.asarray(c.value_lengths()) for c in t["terms"].chunks])
            part = Shard(t["n"].to_numpy(), sizes, whole("terms"), whole("tfs"), w, documents, length)
            ids, rows = t["doc_id"], t["doc_row"].to_numpy()
            missing, ids = ids.is_null().to_numpy().astype(np.int64), ids.fill_null(0).to_numpy()
            for j, (_, names, times) in enumerate(items):
                top, least = best[j]
                found, scores = part.search(names, times, least)
                if len(found):
                    both = np.hstack([top, np.stack([scores, missing[found], ids[found], rows[found]])])
                    both = both[:, np.lexsort((both[3], both[2], both[1], -both[0]))[:k]]
                    best[j] = both, int(both[0, -1]) if both.shape[1] == k else 0
        for (row, _, _), (top, _) in zip(items, best):
            if top.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(top.shape[1], row), pa.int64()), pa.array(top[0]), pa.array(top[2], mask=top[1].astype(bool)), pa.array(top[3])], names=["item_row", "score", "doc_id", "doc_row"])

    return table.select("doc_row", "doc_id", "n", "terms", "tfs").mapInArrow(run, _BEST)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, most_terms: int = 1_000_000, shard: int = 4096) -> DataFrame:
    """(item id, rank, doc id, score): the k documents of highest score above 0 of every item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    all_items = item_terms(items, item_id, item_text)
    blocks = -(-(all_items.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms)
    out = spark.createDataFrame([], _BEST)
    for block in range(blocks):
        rows = all_items.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).select("item_row", "terms", "times").collect()  # about most_terms terms
        vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in rows for w in r["terms"]}))}
        table = postings(docs, vocabulary, id_col, text_col)
        documents, length = table.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the vocabulary
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        asked = [(r["item_row"], np.array([vocabulary[bytes(w)] for w in r["terms"]], np.int64), np.array(r["times"], np.int64)) for r in rows]
        out = out.union(best_of_shards(table, asked, weights, documents, length, k, shard))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc_row"))).where(F.col("rank") <= k)
    return ranked.join(all_items.select("item_row", "item_id"), "item_row").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score")


SEARCH_SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM lowered WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (SELECT row_number() OVER () AS ir, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT ir, item_id, term, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT ir, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""
