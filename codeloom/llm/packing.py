"""Order-preserving packing by dynamic programming with monotone-queue transitions.

Documents are taken in ascending order of ids and their ids laid end to end. A sequence is a run of at most `length` ids.
Cuts may lie at document ends (free), at sentence ends (`sentence_cost`) and, inside stretches without either, at fixed
steps (`hard_cost`). A sequence costs its padding plus `sequence_cost` plus the cost of the cut at its end. Padding fills
up to `length`, but a sequence whose length is a power of two needs none. The least cost up to a cut is found from the
cuts at most `length` before it by a queue that stays monotone in cost + place, and from the few cuts a power of two
before it. The plan is made for each range of ids, in blocks of `block` ids that end with a document, so memory is
bounded and no step of the plan waits for another range.

Defined results: null or empty text is its end id alone; null ids come first; repeated rows are documents of their own
(their pieces share the id); documents of any length are cut as needed; an empty table gives no pieces; other columns
are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emitter, rows_of, unpacked
from .tokens import default_vocabulary, encoder, ordered_texts


def choose_cuts(places: list[int], costs: list[float], length: int, sequence_cost: float) -> list[int]:
    """Indexes of the cuts taken; places ascend, and no two neighbours lie more than length apart. The stretch begins at 0; the last place is its end."""
    powers = [1 << k for k in range(length.bit_length() - 1, 2, -1) if 1 << k <= length]
    at, best, back = [0, *places], [0.0], [0]
    index = {p: i for i, p in enumerate(at)}
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - length:
            queue.popleft()
        cost, _, i = queue[0]
        cost += length - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and best[k] < cost:
                cost, i = best[k], k
        cost += sequence_cost + costs[j - 1]
        best.append(cost)
        back.append(i)
        cost += here
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, here, j))
    out, j = [], len(at) - 1
    while j:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def candidates(ends: np.ndarray, stops: np.ndarray, length: int, sentence_cost: float, hard_cost: float, step: int) -> tuple[list[int], list[float]]:
    """Places and costs of the possible cuts: document ends, sentence ends, steps where both are far apart, and a few places counted back from the end."""
    total = int(ends[-1])
    soft = np.union1d(ends, stops)
    gaps = np.diff(np.concatenate(([0], soft)))
    hard = [np.arange(soft[i] - gaps[i] + step, soft[i], step) for i in np.flatnonzero(gaps > step)]
    hard.append(total - np.array([1 << k for k in range(length.bit_length()) if 1 << k < min(total, length + 1)], np.int64))
    places = np.union1d(soft, np.concatenate(hard)).astype(np.int64)
    costs = np.full(len(places), hard_cost)
    costs[np.searchsorted(places, stops)] = sentence_cost
    costs[np.searchsorted(places, ends)] = 0.0
    return places.tolist(), costs.tolist()


PIECE = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_PIECE = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 4096, vocabulary: str | None = None, end_id: int = 2, sentence_cost: float = 8.0, hard_cost: float = 96.0, sequence_cost: float = 64.0, step: int = 256, block: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece, and its ids where asked for. Sequence ids ascend with the order of documents: range number * 2**36 + number in the range."""
    path = vocabulary or default_vocabulary()
    step = min(step, length)

    def run(batches):
        put, flush = emitter(_PIECE)
        end, bucket, sequence = struct.pack("<I", end_id), None, 0
        ids, parts, stops, held = [], [], [], 0

        def close():
            nonlocal sequence
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            ends = np.cumsum(sizes)
            places, costs = candidates(ends, np.concatenate(stops), length, sentence_cost, hard_cost, step)
            cuts = [places[i] for i in choose_cuts(places, costs, length, sequence_cost)]
            starts, d, last = (ends - sizes).tolist(), 0, 0
            sizes, limits = sizes.tolist(), ends.tolist()
            for cut in cuts:
                name, at = (bucket << 36) + sequence, last
                while at < cut:
                    to = min(cut, limits[d])
                    raw = parts[d][4 * (at - starts[d]) : 4 * (to - starts[d])]
                    yield from put((ids[d], at - starts[d], to - at, zlib.crc32(raw), sizes[d], name, at - last, raw if with_ids else None), 80 + with_ids * len(raw))
                    at = to
                    d += to == limits[d]
                last, sequence = cut, sequence + 1

        for at, _, i, z in rows_of(batches):
            if ids and (at != bucket or held >= block):
                yield from close()
                sequence = sequence if at == bucket else 0
                ids, parts, stops, held = [], [], [], 0
            bucket = at
            code, pauses = encoder(path).encode_with_stops(unpacked(z))
            code += end
            ids.append(i)
            parts.append(code)
            stops.append(pauses[pauses > 0] + held)
            held += len(code) // 4
        if ids:
            yield from close()
        yield from flush()

    out = ordered_texts(docs, id_col, text_col).mapInArrow(run, PIECE).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
