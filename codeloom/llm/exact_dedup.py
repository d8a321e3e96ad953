"""Exact dedup by a log-structured merge index.

Each input task is a small merge tree. A memtable of bounded size maps digests to their best row and holds the
normalised bytes; a hit in it is compared byte by byte. A full memtable is flushed as a sorted run of digests with a
Bloom filter; later rows ask the filters first and search only the runs that may hold them. Runs are merged when too
many have gathered. What a task hands on is one entry for each digest it saw (so a group of any size becomes at most
one entry a task), and compaction across tasks keeps the best entry: most code points, then the smallest identifier.
Hits whose bytes have left the memtable, and entries of one digest from different tasks, are compared byte by byte in
a second pass that aggregates the least and the greatest text of each digest. Digests that stand for more than one
text are grouped by the text itself.

Defined results: null text is empty; empty texts form one group; a null id loses every tie and may stay only where no
other id has as many code points; repeated rows (same id and text) are rows of the same group and are kept or dropped
together; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_batches, emitter, rows_of, stash, task_id, utf8, with_rows

LOG = "kind int, task int, digest string, id bigint, n bigint, members bigint, checked boolean, sha string"
_LOG = pa.schema([("kind", pa.int32()), ("task", pa.int32()), ("digest", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("members", pa.int64()), ("checked", pa.bool_()), ("sha", pa.string())])
_DROP = SPACE.encode()


class Filter:
    """A Bloom filter over digests given as bytes; ten bits and four probes an entry."""

    def __init__(self, digests: list[bytes]) -> None:
        self.size = max(64, 10 * len(digests))
        self.bits = np.zeros(self.size, bool)
        if digests:
            self.bits[self._probes(digests)] = True

    def _probes(self, digests: list[bytes]) -> np.ndarray:
        words = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            return (words[:, :1] + words[:, 1:] * np.arange(1, 5, dtype=np.uint64)) % np.uint64(self.size)

    def may_hold(self, digest: bytes) -> bool:
        a, b = int.from_bytes(digest[:8].ljust(8, b"\0"), "little"), int.from_bytes(digest[8:16].ljust(8, b"\0"), "little")
        return all(self.bits[((a + b * i) & 0xFFFFFFFFFFFFFFFF) % self.size] for i in range(1, 5))


class Run:
    """A flushed run: sorted digests with their best row, and a filter."""

    def __init__(self, entries: dict[bytes, list]) -> None:
        self.keys = sorted(entries)
        self.best = [entries[k] for k in self.keys]
        self.filter = Filter(self.keys)

    def find(self, digest: bytes) -> list | None:
        if not self.filter.may_hold(digest):
            return None
        lo, hi = 0, len(self.keys)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.keys[mid] < digest else (lo, mid)
        return self.best[lo] if lo < len(self.keys) and self.keys[lo] == digest else None


def better(n: int, i: int | None, m: int, j: int | None) -> bool:
    return n > m or n == m and i is not None and (j is None or i < j)


def _level0(digest_bits: int, memtable_bytes: int, memtable_rows: int, fan_in: int):
    def run(batches):
        put, flush = emitter(_LOG)
        task, table, held, runs = task_id(), {}, 0, []
        for i, text in rows_of(batches):
            raw = utf8(text)
            norm = raw.translate(None, _DROP)
            sha = hashlib.sha256(norm).digest()
            digest, n, checked = sha[: digest_bits // 8], len(text or ""), True
            if hit := table.get(digest):
                checked = hit[3] == norm
            elif hit := next((x for r in reversed(runs) if (x := r.find(digest))), None):
                checked = False
            if hit:
                hit[2] += 1
                if better(n, i, hit[0], hit[1]):
                    hit[0], hit[1] = n, i
            else:
                table[digest] = [n, i, 1, norm]
                held += len(norm) + 200
            yield from put((0, task, digest.hex(), i, n, int(not hit), checked, sha.hex()), 200)
            if held >= memtable_bytes or len(table) >= memtable_rows:
                runs.append(Run({k: v[:3] for k, v in table.items()}))
                table, held = {}, 0
                if len(runs) >= fan_in:
                    runs = [Run({k: v for r in runs for k, v in zip(r.keys, r.best)})]
        runs.append(Run({k: v[:3] for k, v in table.items()}))
        for r in runs:
            for k, (n, i, members) in zip(r.keys, r.best):
                yield from put((1, task, k.hex(), i, n, members, None, None), 150)
        yield from flush()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_bits: int = 256, memtable_bytes: int = 32 << 20, memtable_rows: int = 200_000, fan_in: int = 8) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; see the module for the method and the defined cases."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    log = stash(rows.mapInArrow(_level0(digest_bits, memtable_bytes, memtable_rows, fan_in), LOG), "digests")
    entries = log.where("kind = 1")
    unchecked = log.where("kind = 0 and not checked")
    index = stash(
        entries.groupBy("digest").agg(F.max(F.struct("n", F.bitwise_not("id").alias("rank"))).alias("best"), F.sum("members").alias("group_size"), F.count("*").alias("tasks")),
        "index",
    ).select("digest", F.bitwise_not("best.rank").alias("keep_id"), "group_size", "tasks")
    # Byte verification: of digests that several tasks hold or that a memtable could not verify, the rows that entered memtables and the rows that did not match or were not compared.
    contested = index.where("tasks > 1").select("digest").union(unchecked.select("digest")).distinct()
    open_ids = log.where("kind = 0 and (members = 1 or not checked)").join(contested, "digest", "left_semi").select("digest", "id")
    open_texts = rows.join(open_ids.where("id is not null").distinct(), "id").select("digest", F.translate(F.coalesce("text", F.lit("")), SPACE, "").alias("norm"))
    mixed = stash(open_texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest"), "mixed")
    out = log.where("kind = 0").join(
        entries.select("digest", "task").join(index, "digest"), ["digest", "task"]
    ).select("digest", "id", "keep_id", "group_size", F.col("sha").alias("text_sha256"))
    if not mixed.isEmpty():
        bits = digest_bits // 4
        apart = rows.withColumn("norm", F.translate(F.coalesce("text", F.lit("")), SPACE, "")).withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, bits)).join(mixed, "digest")
        groups = apart.groupBy("digest", "norm").agg(F.max(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("n"), F.bitwise_not("id").alias("rank"))).alias("best"), F.count("*").alias("group_size"))
        again = apart.join(groups, ["digest", "norm"]).select("digest", "id", F.bitwise_not("best.rank").alias("keep_id"), "group_size", F.col("sha").alias("text_sha256"))
        out = out.join(mixed, "digest", "left_anti").union(again)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, all columns: of each group of equal texts the one with the most code points, then the smallest id.

    Defined results: null and empty texts are one group; ids may be null or repeated, since rows are told apart by
    number: of equal texts of one id any one of the longest stays, different texts of one id all stay, and a null id
    loses every tie; texts of any length are compared whole; an empty table gives an empty one; other columns, whatever
    their names, are kept as they are.
    """
    rows, row, plain = with_rows(docs, id_col)
    said = exact_dedup(rows, row, text_col, **options)
    if plain:
        kept = said.where("kept").select(row)
    else:
        n = F.length(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        ranked = rows.select(row, F.struct((-n).alias("n"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("rank")).join(said.select(row, "text_sha256"), row)
        kept = ranked.groupBy("text_sha256").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
