"""Whole texts in order of their ids, and their token ids, for the operators that write, pack or compare neighbours."""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8

_encoders: dict[str, "ChunkEncoder"] = {}
#: A word of Latin letters, then ASCII marks; apostrophes (which may begin a contraction) and < and | (which may spell a special token) are left out.
_word = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{}~]*)").fullmatch
_ended = re.compile(rb"[^<]*[0-9][.,]").fullmatch
_id = attrgetter("id")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """For each byte the character that byte-level vocabularies write for it: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in prints else next(rest)) for b in range(256))


class ChunkEncoder:
    """Token ids of texts, as little-endian 32-bit bytes, with a bounded memory of white-space separated chunks.

    Only for byte-level tokenizers that lower-case, drop white space and never join text across it nor letters with
    punctuation (as word_bpe_49k.json): there the ids of a text are those of its chunks. Chunks are cut at ASCII white
    space. A new chunk of lower-case Latin letters is one word to the tokenizer, so its merges are asked for straight
    away; marks after such a word, and a full stop or comma after a digit, are looked up apart; all else goes through the
    whole tokenizer.
    """

    def __init__(self, path: str, held: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.marks, self.held = Tokenizer.from_file(path), {}, {}, {}, held
        self.letters = _byte_letters()
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        size = self.tokenizer.get_vocab_size() + 1
        self.stop, self.digit = np.zeros(size, bool), np.zeros(size, bool)
        for mark in (".", "!", "?", '."', ".)", "...", "?!"):
            if len(ids(mark)) == 1:
                self.stop[ids(mark)] = True
        for digit in "0123456789":
            self.digit[ids(digit)] = True

    def chunks(self, text: bytes) -> list[bytes]:
        """Lower-cased in A-Z, as the tokenizer does; texts that may spell a special token stay as they are."""
        return (text if b"<|" in text else text.lower()).split()

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """A table that has all the chunks. What was not asked for lately is forgotten, in two generations."""
        if len(self.young) >= self.held:
            self.young, self.old = {}, self.young
        young, old, whole, later = self.young, self.old, [], []
        merge, letters = self.tokenizer.model.tokenize, self.letters
        for c in set(chunks):
            if c in young:
                continue
            if (got := old.get(c)) is not None:
                young[c] = got
                continue
            if fit := _word(c):
                word, marks = fit.groups()
                if (got := young.get(word)) is None:
                    if (got := old.get(word)) is None:
                        name = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(letters)
                        got = array("I", map(_id, merge(name))).tobytes()
                    young[word] = got
                if marks:
                    if (after := self.marks.get(marks)) is None:
                        if len(self.marks) >= self.held:
                            self.marks.clear()
                        after = self.marks[marks] = array("I", self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids).tobytes()
                    young[c] = got + after
            elif _ended(c):
                later.append(c)
                whole += [p for p in (c[:-1], c[-1:]) if p not in young]
            else:
                whole.append(c)
        if whole:
            ids = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in whole], add_special_tokens=False)
            for c, e in zip(whole, ids):
                young[c] = array("I", e.ids).tobytes()
        for c in later:
            young[c] = young[c[:-1]] + young[c[-1:]]
        return young

    def encode(self, text: bytes) -> bytes:
        chunks = self.chunks(text)
        return b"".join(map(self.learn(chunks).__getitem__, chunks)) if chunks else b""

    def encode_with_stops(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Ids, and after how many of them a sentence ends: after marks that end one, unless a digit follows."""
        raw = self.encode(text)
        ids = np.frombuffer(raw, "<u4")
        ends = self.stop[ids]
        if len(ids):
            ends[:-1] &= ~self.digit[ids[1:]]
        return raw, np.flatnonzero(ends) + 1


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary in a worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def ordered_texts(docs: DataFrame, id_col: str, text_col: str, *, descending: bool = False, lead: bool = False) -> DataFrame:
    """(bucket int, own boolean, id bigint, z binary): compressed whole texts, dealt into ranges of ids and sorted inside each.

    The bounds are quantiles of the ids, as many as there are shuffle partitions. With lead, a range also gets the row
    that follows its last one in the order (own is false there), for comparisons with the next row; the last range gets
    the very first row. Null ids sort before all others. Repeated ids lie next to each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    bounds = sorted(set(found))[: parts - 1]

    def bucket_of(i: int | None) -> int:
        return 0 if i is None else bisect_right(bounds, i)

    first_of: dict[int, list[int]] = {}
    if lead:
        name = F.lit(0)
        for b in bounds:
            name = name + F.when(F.col("id") >= b, 1).otherwise(0)
        ends = rows.select("id", name.alias("bucket")) if len(bounds) < 64 else rows.select("id").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array([bucket_of(i) for i in b.column(0).to_pylist()], pa.int32())], names=["id", "bucket"]) for b in bs), "id bigint, bucket int")
        edge = {r["bucket"]: r["edge"] for r in ends.groupBy("bucket").agg((F.max if descending else F.min)("id").alias("edge")).collect()}
        order = sorted(edge, reverse=descending)
        for a, b in zip(order, order[1:] + order[:1]):
            first_of.setdefault(b, []).append(a)
        edges = {b: edge[b] for b in order}

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        lent: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                z, at = squeeze(utf8(t)), bucket_of(i)
                out.append((at, True, i, z))
                if lead and edges.get(at) == i and at not in lent:
                    lent.add(at)
                    out += [(a, False, i, z) for a in first_of[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()))] if out else [pa.array([], t) for t in (pa.int32(), pa.bool_(), pa.int64(), pa.binary())], names=["bucket", "own", "id", "z"])

    dealt = rows.mapInArrow(run, "bucket int, own boolean, id bigint, z binary")
    order = F.col("id").desc_nulls_last() if descending else F.col("id").asc_nulls_first()
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.desc("own"), order)
