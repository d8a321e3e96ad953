"""Suffix-array dedup by prefix-free parsing: removes every byte covered by a string of `length` bytes that also starts elsewhere.

Parsing. A rolling hash over 32 bytes picks trigger strings: of the hashes inside a window of `length` bytes the least
(leftmost of equals) is the window's trigger, so equal windows have equal triggers at equal places, and every window
has one. Triggers cut a text into phrases; the windows that share a trigger occurrence form its phrase context, the
bytes from the first such window's start to the last one's end. The parse of the corpus is one row per phrase context:
the trigger's hash and the context's hash.

Sorting. Contexts that occur twice are repeated as a whole, found by counting the parse with map-side combining, at
any group size. What is left are triggers with several different contexts, where repeated passages begin and end. For
these the dictionary side (what precedes the trigger, read backwards) and the parse side (what follows it) are each put
in suffix order with the lengths of common prefixes between neighbours. Two contexts share the window that begins d
bytes before the trigger exactly if they share d bytes on the dictionary side and length - d on the parse side, so both
arrays together give the corpus order of all windows of that trigger and the repeated ones among them, byte for byte.
Triggers with many different contexts are split over parts of about `group` contexts; windows that no part holds twice
are then counted across parts by hash, one row for each part that holds them.

Defined results: null text is empty; texts shorter than `length` lose nothing; matches never cross texts but count
within one; repeated rows repeat each other; rows are told apart by number, so ids may be null or repeated; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stash, emitter, fresh, packed, rows_of, stash, unpacked, utf8, with_rows

GRAM = 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = _rng.integers(1, 2**63, 5, dtype=np.uint64) | np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
#: A text is parsed in pieces of so many windows, so that memory stays bounded for texts of any length.
PIECE = 1 << 21


def _window_minima(data: np.ndarray, length: int) -> np.ndarray:
    """For every window start the place of its trigger."""
    with np.errstate(over="ignore"):
        h = _BYTE[data]
        for j in range(5):
            h = h[: -(1 << j)] * _MIX[j] + h[1 << j :]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
    m, span = len(h), length - GRAM + 1
    key = np.full(-(-m // span) * span, 2**64 - 1, np.uint64)
    key[:m] = (h & _HIGH) | np.arange(m, dtype=np.uint64)
    rows = key.reshape(-1, span)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n = m - span + 1
    return (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & _LOW).astype(np.int64)


def parse(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window start, last window start) of every phrase context."""
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 3
    data, windows = np.frombuffer(text, np.uint8), len(text) - length + 1
    at = np.concatenate([_window_minima(data[i : i + min(PIECE, windows - i) + length - 1], length) + i for i in range(0, windows, PIECE)])
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.concatenate(([0], cut))
    return at[lo], lo, np.concatenate((cut - 1, [windows - 1]))


PARSED = "rk bigint, n_bytes bigint, sha string, k array<bigint>, c array<bigint>"
_PARSED = pa.schema([("rk", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("k", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parse_rows(length: int):
    def run(batches):
        put, flush = emitter(_PARSED)
        for i, text in rows_of(batches):
            raw = utf8(text)
            at, lo, hi = parse(raw, length)
            k = [_signed(xxhash.xxh64_intdigest(raw[p : p + GRAM])) for p in at.tolist()]
            c = [_signed(xxhash.xxh3_64_intdigest(raw[a : b + length])) for a, b in zip(lo.tolist(), hi.tolist())]
            yield from put((i, len(raw), hashlib.sha256(raw).hexdigest(), k, c), 200 + 16 * len(k))
        yield from flush()

    return run


OPEN = "rk bigint, k bigint, part int, parts int, own boolean, at int, first int, ctx binary"
_OPEN = pa.schema([("rk", pa.int64()), ("k", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("own", pa.bool_()), ("at", pa.int32()), ("first", pa.int32()), ("ctx", pa.binary())])


def _open_contexts(length: int):
    """The contexts that must be told apart byte by byte: flags are 2 for a lone context, 3 for one that stands for equal ones."""

    def run(batches):
        put, flush = emitter(_OPEN)
        for rk, z, flags in rows_of(batches):
            if not any(f["flag"] >= 2 for f in flags):
                continue
            raw = unpacked(z)
            at, lo, hi = parse(raw, length)
            for f in flags:
                if f["flag"] >= 2:
                    i, parts = f["i"], f["parts"]
                    ctx = raw[lo[i] : hi[i] + length]
                    part = xxhash.xxh3_64_intdigest(ctx) % parts
                    yield from put((rk, f["k"], part, parts, f["flag"] == 2, int(at[i] - lo[i]), int(lo[i]), ctx), len(ctx) + 60)
        yield from flush()

    return run


def _common(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _suffix_order(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and the common prefix of each with the one before it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    return np.array(order), np.array([0] + [_common(parts[a], parts[b]) for a, b in zip(order, order[1:])])


def _all_common(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefixes of all pairs of a small group, from neighbours' ones."""
    n = len(order)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        out[order[i], order[i + 1 :]] = np.minimum.accumulate(lcp[i + 1 :])
    return np.maximum(out, out.T)


def repeated_windows(contexts: list[tuple[bytes, int]], length: int, small: int = 48) -> list[np.ndarray]:
    """For each of some different contexts of one trigger, given as (bytes, place of the trigger): which of its windows another context holds too."""
    left = [c[:at][::-1] for c, at in contexts]
    right = [c[at:] for c, at in contexts]
    lo_order, lo_lcp = _suffix_order(left)
    hi_order, hi_lcp = _suffix_order(right)
    n, windows = len(contexts), [len(c) - length + 1 for c, _ in contexts]
    if n <= small:
        first, last = length - _all_common(hi_order, hi_lcp), _all_common(lo_order, lo_lcp)
        np.fill_diagonal(first, length + 1)
        out = []
        for i, (_, at) in enumerate(contexts):
            hit = np.zeros(windows[i], bool)
            for a, b in {*zip(first[i].tolist(), last[i].tolist())}:
                if a <= b:  # windows that begin a to b bytes before the trigger
                    hit[max(0, at - b) : max(0, at - a + 1)] = True
            out.append(hit)
        return out
    out = [np.zeros(w, bool) for w in windows]
    at = np.array([a for _, a in contexts])
    lowest = at - np.array(windows) + 1
    for d in range(int(lowest.min()), int(at.max()) + 1):
        here = np.flatnonzero((lowest <= d) & (d <= at))
        if len(here) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[lo_order], b[hi_order] = np.cumsum(lo_lcp < d), np.cumsum(hi_lcp < length - d)
        _, back, count = np.unique(a[here] * (n + 1) + b[here], return_inverse=True, return_counts=True)
        for i in here[count[back] > 1].tolist():
            out[i][at[i] - d] = True
    return out


FOUND = "rk bigint, first bigint, last bigint, window binary"
_FOUND = pa.schema([("rk", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("window", pa.binary())])


def _solve(length: int):
    """Rows come sorted by trigger and part; the different contexts of each are solved together.

    Where a trigger's contexts are split over several parts, each part also names its different windows once (window is
    their 128-bit hash, rk null if the part has them twice already), so that windows shared by parts are found by counting.
    """

    def solved(group, split):
        hits = repeated_windows([(g[4], g[2]) for g in group], length) if len(group) > 1 else [np.zeros(len(group[0][4]) - length + 1, bool)]
        said: set[bytes] = set()
        for (rk, own, at, first, ctx), hit in zip(group, hits):
            if own and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    yield rk, first + a, first + b - 1, None
            for s, twice in enumerate(hit.tolist() if split else ()):
                window = xxhash.xxh3_128_digest(ctx[s : s + length])
                if window not in said:
                    said.add(window)
                    yield rk if own and not twice else None, first + s, first + s, window

    def run(batches):
        put, flush = emitter(_FOUND)
        key, group, split = None, [], False
        for rk, k, part, parts, own, at, first, ctx in rows_of(batches):
            if (k, part) != key:
                if len(group) > 1 or split:
                    for row in solved(group, split):
                        yield from put(row)
                key, group, split = (k, part), [], parts > 1
            group.append((rk, own, at, first, ctx))
        if len(group) > 1 or split:
            for row in solved(group, split):
                yield from put(row)
        yield from flush()

    return run


CUT = "rk bigint, n_removed bigint, n_spans bigint, longest bigint, kept_sha256 string, kept_text string"
_CUT = pa.schema([("rk", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("longest", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def covered(n: int, spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) covered by windows whose starts lie in the spans [first, last]."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, min(b, n)) for a, b in out]


def _cut(length: int, texts: bool):
    def run(batches):
        put, flush = emitter(_CUT)
        for rk, z, flags, found in rows_of(batches):
            raw = unpacked(z)
            _, lo, hi = parse(raw, length)
            spans = [(int(lo[f["i"]]), int(hi[f["i"]])) for f in flags if f["flag"] in (1, 3)] + [(x["first"], x["last"]) for x in found or ()]
            gone, kept, last = covered(len(raw), spans, length), [], 0
            for a, b in gone:
                kept.append(raw[last:a])
                last = b
            rest = b"".join([*kept, raw[last:]])
            yield from put((rk, len(raw) - len(rest), len(gone), max((b - a for a, b in gone), default=0), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if texts else None), 200 + texts * len(rest))
        yield from flush()

    return run


def _removed(rows: DataFrame, length: int, texts: bool, group: int) -> DataFrame:
    """(rk, n_bytes, sha, and where something was removed n_removed, n_spans, longest, kept_sha256, kept_text) of rows (rk, text), rk being different for each."""
    parsed = stash(rows.mapInArrow(_parse_rows(length), PARSED), "parse")
    each = parsed.select("rk", F.posexplode(F.arrays_zip("k", "c")).alias("i", "x")).select("rk", "i", "x.k", "x.c")
    # Most triggers occur once: one aggregation of fixed-size columns finds the others, and only their contexts go on.
    repeated = each.groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")).where("n > 1").select("k", (F.col("a") != F.col("b")).alias("open"))
    repeated = stash(repeated, "triggers")  # read from a table, a skewed trigger's rows can be dealt over tasks in the join
    again = stash(each.join(repeated, "k"), "again")
    # Triggers with several different contexts are open. 1: repeated as a whole. 2: alone, but its trigger has other contexts. 3: repeated, and stands for its equals beside others.
    contexts = again.where("open").groupBy("k", "c").agg(F.count("*").alias("count"), F.min(F.struct("rk", "i")).alias("first"))
    different = contexts.groupBy("k").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    known = stash(contexts.join(different, "k"), "contexts")
    stands = (F.col("first.rk") == F.col("rk")) & (F.col("first.i") == F.col("i"))
    opened = again.where("open").join(known, ["k", "c"]).select("rk", "i", "k", F.when(F.col("count") == 1, 2).when(stands, 3).otherwise(1).alias("flag"), "parts")
    closed = again.where("not open").select("rk", "i", "k", F.lit(1).alias("flag"), F.lit(1).alias("parts"))
    flagged = opened.union(closed).groupBy("rk").agg(F.collect_list(F.struct("i", "flag", "parts", "k")).alias("flags"))
    touched = stash(packed(rows, "rk", "text").join(flagged, "rk"), "texts")
    drop_stash(known)
    drop_stash(again)
    drop_stash(repeated)
    contexts_open = touched.select("rk", "z", "flags").mapInArrow(_open_contexts(length), OPEN)
    by_trigger = contexts_open.repartition("k", "part").sortWithinPartitions("k", "part", "rk", "first")
    solved = stash(by_trigger.mapInArrow(_solve(length), FOUND), "found")
    shared = solved.where("window is not null").groupBy("window").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("rk").isNotNull(), F.struct("rk", "first", "last"))).alias("rows")).where("n > 1")
    spans = solved.where("window is null").select("rk", "first", "last").union(shared.select(F.explode("rows").alias("r")).select("r.rk", "r.first", "r.last"))
    found = spans.groupBy("rk").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    cut = touched.join(found, "rk", "left").select("rk", "z", "flags", "found").mapInArrow(_cut(length, texts), CUT)
    return parsed.select("rk", "n_bytes", "sha").join(cut, "rk", "left")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, passage: int | None = None, group: int = 16_384) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row. At most about `group` contexts of one trigger are sorted together.

    With `passage`, a shorter length, n_passage_bytes also says how many bytes strings of that length cover that start
    elsewhere too. It is found first, over all texts; only texts with a run of `length` such bytes can then hold a
    repeated string of `length`, and such strings lie in such runs in every text that holds them, so these texts alone
    are searched for the longer ones.
    """
    if min(length, passage or length) < GRAM or passage and passage > length:
        raise ValueError(f"lengths are {GRAM} at least, and a passage is no longer than what is removed")
    bounded_batches(docs.sparkSession)
    rows, row, plain = with_rows(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    texts = rows.select(F.col(row).alias("rk"), "text")
    none = F.lit(0).cast("bigint")
    if passage:
        short = stash(_removed(texts, passage, False, group).select("rk", "n_bytes", "sha", F.coalesce("n_removed", none).alias("n_passage_bytes"), "longest"), "passages")
        held = texts.join(short.where(F.col("longest") >= length).select("rk"), "rk", "left_semi")
        out = short.join(_removed(held, length, False, group).drop("n_bytes", "sha"), "rk", "left")
    else:
        out = _removed(texts, length, False, group)
    cols = ["n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["n_passage_bytes"] if passage else [])]
    if plain:
        return out.select(F.col("rk").alias(id_col), *cols)
    return out.join(rows.select(F.col(row).alias("rk"), "id"), "rk").select(F.col("id").alias(id_col), *cols)


#: Bytes that the stage takes for a passage: about 50 tokens, the customary length for suffix-array dedup of prose.
PASSAGE = 200


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = PASSAGE, group: int = 16_384) -> DataFrame:
    """docs with every passage of `length` bytes or more that occurs again taken out of the texts; n_chars, if there, is counted anew. Code points cut in two are dropped.

    Defined results: null texts stay null and texts shorter than `length` as they are; ids may be null or repeated,
    since rows are told apart by number (repeated rows repeat each other); texts of any length are searched whole; an
    empty table gives an empty one; other columns, whatever their names, are kept as they are.
    """
    rows, row, _ = with_rows(docs, id_col)
    bounded_batches(docs.sparkSession)
    mark, text = fresh("__cut", rows), fresh("__kept", rows)
    texts = rows.select(F.col(row).alias("rk"), F.col(text_col).cast("string").alias("text"))
    cut = _removed(texts, length, True, group).where("n_removed > 0").select(F.col("rk").alias(mark), F.col("kept_text").alias(text))
    joined = rows.join(cut, F.col(row) == F.col(mark), "left")
    new = {text_col: F.col(text), "n_chars": F.length(F.col(text)).cast("bigint")}
    return joined.select(*[F.when(F.col(mark).isNotNull(), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
