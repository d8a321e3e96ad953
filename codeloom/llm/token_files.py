"""Token-id files with directly addressable codes.

An id is cut into chunks of `width` bits, the lowest first. Level 0 holds the lowest chunk of every id; a bitmap says
which ids go on, and level 1 holds the next chunk of those alone, and so on. Rank directories hold how many bits are
set before every block of 512 bits, so token i is read with one rank for each level and nothing else is decoded.

A file is a Parquet table in the shared folder; a row is a segment: whole documents in ascending order of ids, their
directory (ids, token counts) and the encoded levels. Segments close at `segment` tokens. `start` counts the tokens of
all documents before; only one total for each range of ids comes to the driver.

Defined results: null or empty text has the end id alone; null ids come first; repeated rows are documents of their own;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emitter, rows_of, stash, unpacked
from .tokens import default_vocabulary, encoder, ordered_texts

BLOCK = 512
MAGIC = b"DAC1"


def dac_encode(ids: np.ndarray, width: int = 8) -> bytes:
    """MAGIC, width, n; for each level: number of chunks, chunks, bitmap, rank directory."""
    kind = np.uint8 if width <= 8 else np.uint16
    out, rest = [MAGIC, struct.pack("<BQ", width, len(ids))], ids.astype(np.uint64)
    while len(rest):
        more = rest >> np.uint64(width)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64))[:-1])).astype("<u8")
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64((1 << width) - 1)).astype(kind).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = more[on]
    return b"".join(out)


class Dac:
    """Random access to encoded ids."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.width, self.n = struct.unpack_from("<BQ", data, 4)
        kind, at, self.levels = (np.uint8 if self.width <= 8 else np.dtype("<u2")), 13, []
        while at < len(data):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, kind, n, at)
            at += chunks.nbytes
            blocks = -(-n // BLOCK)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
            at += bits.nbytes
            ranks = np.frombuffer(data, "<u8", blocks, at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level."""
        _, bits, ranks = self.levels[level]
        block, off = divmod(i, BLOCK)
        if block >= len(ranks):
            block, off = len(ranks) - 1, BLOCK
        start = block * BLOCK // 8
        count = int(ranks[block]) + int(np.bitwise_count(bits[start : start + off // 8]).sum(dtype=np.int64))
        return count + (int(bits[start + off // 8]) & ((1 << off % 8) - 1)).bit_count() if off % 8 else count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            i, shift = self._rank(level, i), shift + self.width
        return out

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, from those places of the levels alone."""
        out = np.zeros(max(0, hi - lo), np.uint64)
        at = np.arange(len(out))
        for level, (chunks, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            out[at] |= chunks[lo:hi].astype(np.uint64) << np.uint64(level * self.width)
            on = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 : (lo & 7) + hi - lo].astype(bool)
            lo = self._rank(level, lo)
            hi, at = lo + int(on.sum()), at[on]
        return out


SEGMENT = "bucket int, segment int, first bigint, ids binary, nulls binary, lengths binary, codes binary"
_SEGMENT = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("codes", pa.binary())])


def write_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, end_id: int = 2, width: int = 8, segment: int = 500_000) -> DataFrame:
    """Writes the token files; returns the table of segments as read back from them."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        put, flush = emitter(_SEGMENT, rows=8, size=4 << 20)
        end = struct.pack("<I", end_id)
        bucket, number, first, ids, parts, held = None, 0, 0, [], [], 0

        def close():
            lengths = np.array([len(p) // 4 for p in parts], "<u4")
            codes = dac_encode(np.frombuffer(b"".join(parts), "<u4"), width)
            known = np.array([i or 0 for i in ids], "<i8").tobytes()
            row = (bucket, number, first, known, np.array([i is None for i in ids]).tobytes(), lengths.tobytes(), codes)
            return put(row, len(codes) + len(known))

        for at, _, i, z in rows_of(batches):
            if ids and (at != bucket or held >= segment):
                yield from close()
                number, first = (number + 1, first + held) if at == bucket else (0, 0)
                ids, parts, held = [], [], 0
            bucket = at
            code = encoder(path).encode(unpacked(z)) + end
            ids.append(i)
            parts.append(code)
            held += len(code) // 4
        if ids:
            yield from close()
        yield from flush()

    return stash(ordered_texts(docs, id_col, text_col).mapInArrow(run, SEGMENT), "tokens")


READ = "id bigint, bucket int, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
_READ = pa.schema([("id", pa.int64()), ("bucket", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_tokens(segments: DataFrame, id_col: str = "doc_id", *, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, and its ids where asked for, from the files."""
    last = segments.select("bucket", "first", "lengths").mapInArrow(_totals, "bucket int, total bigint").groupBy("bucket").agg(F.max("total").alias("total")).collect()
    before, total = {}, 0
    for r in sorted(last, key=lambda r: r["bucket"]):
        before[r["bucket"]] = total
        total += r["total"]

    def run(batches):
        put, flush = emitter(_READ)
        for bucket, _, first, ids, nulls, lengths, codes in rows_of(batches):
            dac, start = Dac(codes), 0
            gone = np.frombuffer(nulls, bool)
            for j, (i, n) in enumerate(zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(lengths, "<u4").tolist())):
                raw = dac.slice(start, start + n).astype("<u4").tobytes()
                yield from put((None if gone[j] else i, bucket, before[bucket] + first + start, n, zlib.crc32(raw), raw if with_ids else None), 60 + with_ids * len(raw))
                start += n
        yield from flush()

    out = segments.mapInArrow(run, READ).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32", "ids")
    return out if with_ids else out.drop("ids")


def _totals(batches):
    for b in batches:
        ends = [f + int(np.frombuffer(x, "<u4").sum(dtype=np.int64)) for f, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.int64())], names=["bucket", "total"])


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the files and reads every document back from them."""
    return read_tokens(write_tokens(docs, id_col, text_col, **options), id_col)
