"""MinHash near-dedup by a multi-index Hamming join, confirmed on whole shingle sets.

Signatures. Of a document's distinct word shingles, `chunks * width` independent min-wise hashes give as many symbols of
`bits` bits. Two sets of Jaccard likeness J differ in a symbol with probability 1 - J, so the signature distance (the
number of differing symbols) of a pair at the threshold is binomial.

Multi-index join. The signature is split into `chunks` chunks of `width` symbols. If two signatures differ in fewer than
chunks * (errors + 1) symbols, then by pigeonhole some chunk differs in `errors` symbols at most; enumerating which
symbols of each chunk may be wrong gives keys of width - errors symbols, and such a pair shares a key for certain. With
the defaults (12 chunks of 6 symbols, 1 error: 72 keys) all pairs at a distance of 23 of 72 or less are met for certain,
and pairs at the threshold of 0.8 beyond that distance with a chance of 0.999997, since every chunk is a further try.

Few pairs inside groups. Rows of a key are first linked to the first row and to the row before, inside each task (so
that a task hands on one row a key) and then across tasks. Links are dropped if a one-bit sketch of the signature is
further off than any pair at the threshold gets (six standard deviations). Each remaining link is confirmed on the two
whole texts. Links inside a component found so far need no confirmation: they can't change it.

No pairs missed. Keys whose rows are then still in several components are settled. First the rows of such a key that
are nearest to all others meet its rows outside the key's largest component, which joins stars around one base at a
linear cost. Then rows that open keys connect form a family; its rows outside the family's largest component meet all its
rows of a like set size on their whole shingle sets. That is done in units of bounded size, so that a hot family is
spread over tasks; a unit counts all its intersections at once and hands on only links that join two components, never
the pairs that it looked at. So two rows with a common key are in one component, or their whole sets were compared.

Words are lower-cased in A-Z only and split at ASCII white space. Defined results: null or blank text has an empty set
and stands alone; fewer words than a shingle holds count as one shingle; a null id stands alone; repeated rows are
linked with each other as equal sets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, drop_stash, emitter, packed, rows_of, stash, unpacked, utf8, with_rows

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_words = _Words()


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for j in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + h[j : j + n]
    return np.unique(_finish(out))


class Scheme:
    """Signature and key parameters."""

    def __init__(self, threshold: float, chunks: int, width: int, errors: int, bits: int = 16) -> None:
        self.chunks, self.width, self.errors, self.bits = chunks, width, errors, bits
        rng = np.random.default_rng(977)
        k = chunks * width
        self.mul = rng.integers(1, 2**63, (k, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(1, 2**63, (k, 1), dtype=np.uint64)
        self.keep = [list(c) for c in combinations(range(width), width - errors)]
        self.salt = rng.integers(1, 2**63, (chunks, len(self.keep)), dtype=np.uint64)
        far = lambda n, p: n * p + 6 * (n * p * (1 - p)) ** 0.5 + 1
        self.most_symbols, self.most_bits = far(k, 1 - threshold), far(min(k, 64), (1 - threshold) / 2)

    def signature(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mul), 2**64 - 1, np.uint64)
        for i in range(0, len(s), 512):
            out = np.minimum(out, (s[None, i : i + 512] * self.mul + self.add).min(axis=1))
        return _finish(out) & np.uint64((1 << self.bits) - 1)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        sig = sig.reshape(self.chunks, self.width)
        out = np.empty((self.chunks, len(self.keep)), np.uint64)
        for j, at in enumerate(self.keep):
            h = self.salt[:, j].copy()
            for i in at:
                h = (h ^ (h >> np.uint64(31))) * _PRIME + sig[:, i]
            out[:, j] = _finish(h)
        return out.ravel().view(np.int64)

    def sketch(self, sig: np.ndarray) -> int:
        return int(np.packbits((sig[:64] & np.uint64(1)).astype(np.uint8)).tobytes().ljust(8, b"\0").hex(), 16)


#: kind 0: a document (a: id, b: the row in its task with an equal set, n: set size). 1: a possible link a, b. 2: row a has key b; n: sketch. 3: the same, for rows of keys that others have too.
MADE = "kind int, a bigint, b bigint, n bigint"
_MADE = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _batch(kind: int, a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=_MADE)


def _runs(keys: np.ndarray, ids: np.ndarray, sketches: np.ndarray, most_bits: float):
    """Sorted rows of keys -> (first row of each key), (links to the first and the previous row that the sketch allows)."""
    head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
    rest = np.flatnonzero(~head)
    a, b = np.concatenate((first[rest], rest - 1)), np.concatenate((rest, rest))
    near = np.bitwise_count(sketches[a] ^ sketches[b]) <= most_bits
    a, b = ids[a[near]], ids[b[near]]
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return head, pairs[pairs[:, 0] != pairs[:, 1]]


def _shared(head: np.ndarray) -> np.ndarray:
    """Of sorted rows of keys, those whose key another row has too."""
    return ~head | np.append(~head[1:], False)


def _make(scheme: Scheme, size: int, held: int):
    def run(batches):
        equal: dict[bytes, int] = {}
        keys, ids, sketches, waiting = [], [], [], 0

        def flush():
            k, i, s = np.concatenate(keys), np.repeat(np.array(ids, np.int64), len(keys[0])), np.repeat(np.array(sketches, np.uint64), len(keys[0]))
            order = np.lexsort((i, k))
            k, i, s = k[order], i[order], s[order]
            head, pairs = _runs(k, i, s, scheme.most_bits)
            yield _batch(1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            yield _batch(2, i[head], k[head], s[head].view(np.int64))
            many = _shared(head)
            yield _batch(3, i[many], k[many], s[many].view(np.int64))
            for x in (keys, ids, sketches):
                x.clear()

        for b in batches:
            docs, rep, sizes = [], [], []
            for i, text in rows_of([b]):
                s = shingles(utf8(text), size)
                docs.append(i)
                sizes.append(len(s))
                if i is None or not len(s):
                    rep.append(i)
                    continue
                name = xxhash.xxh3_128_digest(s.tobytes())
                if (known := equal.get(name)) is None:
                    if len(equal) < 500_000:
                        equal[name] = i
                    known = i
                    sig = scheme.signature(s)
                    keys.append(scheme.keys(sig))
                    ids.append(i)
                    sketches.append(scheme.sketch(sig))
                    waiting += 1
                rep.append(known)
            yield _batch(0, docs, rep, sizes)
            if waiting >= held:
                yield from flush()
                waiting = 0
        if waiting:
            yield from flush()

    return run


def _meet(most_bits: float):
    """Rows sorted by key: passes kinds 0 and 1 on and links the rows of each key across tasks."""

    def run(batches):
        last = None
        for b in batches:
            kind = b.column(0).to_numpy()
            if (other := kind != 2).any():
                yield b.filter(pa.array(other))
            here = ~other
            if not here.any():
                continue
            own = b.filter(pa.array(here))
            ids, keys, sk = (own.column(j).to_numpy(zero_copy_only=False) for j in (1, 2, 3))
            if last is not None:  # the first and the latest row of the key that the batch before ended with
                keys, ids, sk = (np.concatenate((x, y)) for x, y in zip(last, (keys, ids, sk)))
            head, pairs = _runs(keys, ids, sk.view(np.uint64), most_bits)
            if len(pairs):
                yield _batch(1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            if (many := _shared(head)).any():  # rows carried over come twice, which changes nothing
                yield _batch(3, ids[many], keys[many], sk[many])
            start = int(np.searchsorted(keys, keys[-1]))
            pick = [start, len(keys) - 1] if start < len(keys) - 1 else [start]
            last = tuple(x[pick] for x in (keys, ids, sk))

    return run


def _central(most_bits: float, most: int):
    """Rows sorted by key -> links of each row outside the key's largest component (side 0) with the `most` rows of other components (side 1) that are nearest to all of side 0."""

    def pairs(side, ids, comps, sketches):
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return np.zeros((0, 2), np.int64)
        if len(left) * len(right) > 64:
            total = np.zeros(len(right), np.int64)
            for i in range(0, len(left), 256):
                total += np.bitwise_count(sketches[left[i : i + 256], None] ^ sketches[None, right]).sum(0, dtype=np.int64)
            right = right[np.argsort(total, kind="stable")[:most]]
        near = (np.bitwise_count(sketches[left, None] ^ sketches[None, right]) <= most_bits) & (comps[left, None] != comps[None, right])
        a, b = np.nonzero(near)
        out = np.stack((ids[left[a]], ids[right[b]]), 1)
        return np.stack((out.min(1), out.max(1)), 1) if len(out) else out

    def run(batches):
        held = None

        def units(columns, ends):
            start = 0
            for end in ends:
                found = pairs(*(c[start:end] for c in columns[3:6]), columns[6][start:end].view(np.uint64))
                start = end
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            key, x, y = held[:3]
            ends = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            if len(ends):
                yield from units(held, ends)
                held = [c[ends[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from units(held, [len(held[0])])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, each given as sorted distinct hashes.

    Hashes that few rows hold are counted along their lists of rows, the others by matrix products over `columns` hashes
    at a time, so the memory is that of the sets and of the answer.
    """
    n, m = len(left), len(right)
    out = np.zeros(n * m, np.float32)
    names, at = np.unique(np.concatenate(right), return_inverse=True)
    row_r = np.repeat(np.arange(m), [len(x) for x in right])[np.argsort(at, kind="stable")]
    many_r = np.bincount(at, minlength=len(names))
    start_r = np.cumsum(many_r) - many_r
    mine = np.concatenate(left)
    place = np.minimum(np.searchsorted(names, mine), len(names) - 1)
    both = names[place] == mine
    row_l, place = np.repeat(np.arange(n), [len(x) for x in left])[both], place[both]
    order = np.argsort(place, kind="stable")
    row_l, place = row_l[order], place[order]
    many_l = np.bincount(place, minlength=len(names))
    dense = many_l * many_r > max(1, n * m // 100)
    sparse = np.flatnonzero(~dense[place])
    for i in range(0, len(sparse), 20_000):
        part = sparse[i : i + 20_000]
        k = many_r[place[part]]
        ends = np.cumsum(k)
        with_r = row_r[np.repeat(start_r[place[part]] - (ends - k), k) + np.arange(ends[-1] if len(ends) else 0)]
        np.add.at(out, np.repeat(row_l[part], k) * m + with_r, 1)
    out = out.reshape(n, m)
    heavy, start_l = np.flatnonzero(dense), np.cumsum(many_l) - many_l
    for i in range(0, len(heavy), columns):
        part = heavy[i : i + columns]
        sides = []
        for rows, start, many, size in ((row_l, start_l, many_l, n), (row_r, start_r, many_r, m)):
            has = np.zeros((size, len(part)), np.float32)
            for j, e in enumerate(part.tolist()):
                has[rows[start[e] : start[e] + many[e]], j] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out


def _families(size: int, threshold_percent: int):
    """Rows sorted by unit (family, band, x, y), side 0 first -> links of whole shingle sets between components, no more of them than join what they join."""

    def links(left, right):
        sets = [[shingles(unpacked(z), size) for _, _, z in rows] for rows in (left, right)]
        n, m = (np.array([len(x) for x in s]) for s in sets)
        both = overlaps(*sets)
        ca, cb = (np.array([c for _, c, _ in rows]) for rows in (left, right))
        ok = (100 * both >= threshold_percent * (n[:, None] + m[None] - both)) & (both > 0) & (ca[:, None] != cb[None])
        up: dict[int, int] = {}

        def top(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
            u, v = top(left[i][1]), top(right[j][1])
            if u != v:
                up[u] = v
                yield min(left[i][0], right[j][0]), max(left[i][0], right[j][0])

    def run(batches):
        unit, sides = None, ([], [])

        def done():
            found = list(links(*sides)) if sides[0] and sides[1] else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for family, band, x, y, side, i, comp, z in rows_of(batches):
            if (family, band, x, y) != unit:
                yield from done()
                unit, sides = (family, band, x, y), ([], [])
            sides[side].append((i, comp, z))
        yield from done()

    return run


LINKED = "a bigint, b bigint, ok boolean"


def _confirm(size: int, threshold_percent: int):
    def run(batches):
        name, held = None, None
        for batch in batches:
            a_ids, b_ids, ok = [], [], []
            for a, za, b, zb in rows_of([batch]):
                if a != name:
                    name, held = a, shingles(unpacked(za), size)
                other = shingles(unpacked(zb), size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                a_ids.append(a)
                b_ids.append(b)
                ok.append(both > 0 and 100 * both >= threshold_percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, threshold: float = 0.8, chunks: int = 12, width: int = 6, errors: int = 1, held: int = 8000, unit: int = 2000, unit_shingles: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: components of links of Jaccard likeness `threshold` or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scheme = Scheme(threshold, chunks, width, errors)
    percent = round(threshold * 100)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_make(scheme, shingle, held), MADE)
    spread = F.when(F.col("kind") == 2, F.col("b")).otherwise(F.xxhash64("a", "b"))
    met = stash(made.repartition(spread).sortWithinPartitions("kind", "b", "a").mapInArrow(_meet(scheme.most_bits), MADE), "met")
    documents = met.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("rep"), F.col("n").alias("n_shingles"))
    possible = stash(met.where("kind = 1").select("a", "b").distinct(), "possible")
    members = met.where("kind = 3").select(F.col("b").alias("key"), F.col("a").alias("id"), F.col("n").alias("sketch"))
    ends = members.select("id").distinct()
    texts = stash(packed(rows, "id", "text").join(ends, "id", "left_semi").dropDuplicates(["id"]), "texts")

    def confirmed(links: DataFrame) -> DataFrame:
        pairs = links.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
        return stash(pairs.select("a", "za", "b", "zb").mapInArrow(_confirm(shingle, percent), LINKED), "confirmed")

    # First the least partner of each row; then, between the stars so found, one link for each row and star; then the rest.
    first = confirmed(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    up = first.where("ok").select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(2):
        top = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
        up = stash(up.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "stars")

    def crossing(links: DataFrame) -> DataFrame:
        ra, rb = (up.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
        named = links.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        return named.where("ra <> rb")

    rest = stash(crossing(possible.join(first.select("a", "b"), ["a", "b"], "left_anti")), "crossing")
    second = confirmed(rest.groupBy("b", "ra").agg(F.max("a").alias("a")).select("a", "b"))
    good = first.union(second).where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(good)
    up = labels.select("node", F.col("component").alias("root"))
    third = confirmed(crossing(rest.select("a", "b").join(second.select("a", "b"), ["a", "b"], "left_anti")))
    tested = first.union(second).union(third)

    def joined() -> DataFrame:
        return components(tested.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")))

    if not third.where("ok").isEmpty():
        labels = joined()

    def open_keys() -> DataFrame:
        """Rows of the keys whose rows are in several components, with the key's largest one."""
        own = members.join(labels.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "sketch")
        sizes = own.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
        return stash(own.join(sizes.select("key", F.col("most.comp").alias("main"), F.col("most.n").alias("most"), "n"), "key"), "unsettled")

    blocks = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # First the rows of each key that are nearest to all others, which joins stars at a linear cost.
    unsettled = open_keys()
    if not unsettled.isEmpty():
        parted = unsettled.select("*", blocks(F.col("n") - F.col("most"), unit).alias("xs"), blocks(F.col("n"), unit).alias("ys"))
        left = parted.where("comp <> main").select("key", block(F.col("xs")).alias("x"), every("ys").alias("y"), F.lit(0).alias("side"), "id", "comp", "sketch")
        right = parted.select("key", every("xs").alias("x"), block(F.col("ys")).alias("y"), F.lit(1).alias("side"), "id", "comp", "sketch")
        units = left.union(right).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        pairs = units.mapInArrow(_central(scheme.most_bits, 4), "a bigint, b bigint").distinct()
        found = confirmed(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        tested = tested.union(found)
        if not found.where("ok").isEmpty():
            labels = joined()
            drop_stash(unsettled)
            unsettled = open_keys()
    # Then whole families, the rows that open keys connect: rows outside the family's largest component meet all its rows of a like set size.
    if not unsettled.isEmpty():
        named = unsettled.select("id", "comp").distinct()
        ends = unsettled.groupBy("key").agg(F.min("id").alias("v"))
        family = components(unsettled.select("key", F.col("id").alias("u")).join(ends, "key").select("u", "v")).select(F.col("node").alias("id"), F.col("component").alias("family"))
        band = F.floor(F.log("n_shingles") / float(np.log(1 / threshold))).cast("int")
        rows_in = stash(named.join(family, "id").join(documents.select("id", "n_shingles").dropDuplicates(["id"]), "id").withColumn("band", band), "family")
        most = rows_in.groupBy("family", "comp").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
        rows_in = rows_in.join(most, "family")
        # A set of 0.8 or more of another's size is at most one band away from it.
        left = rows_in.where("comp <> main").select("family", "band", F.lit(0).alias("side"), "id", "comp", "n_shingles")
        right = rows_in.select("family", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.lit(1).alias("side"), "id", "comp", "n_shingles")
        weight = F.col("n_shingles") + unit_shingles // unit
        loads = [side.groupBy("family", "band").agg(blocks(F.sum(weight), unit_shingles // 2).alias(n)) for side, n in ((left, "xs"), (right, "ys"))]
        loads = loads[0].join(loads[1], ["family", "band"])
        left = left.join(loads, ["family", "band"]).select("family", "band", block(F.col("xs")).alias("x"), every("ys").alias("y"), "side", "id", "comp")
        right = right.join(loads, ["family", "band"]).select("family", "band", every("xs").alias("x"), block(F.col("ys")).alias("y"), "side", "id", "comp")
        units = left.union(right).join(texts, "id").select("family", "band", "x", "y", "side", "id", "comp", "z")
        linked = units.repartition("family", "band", "x", "y").sortWithinPartitions("family", "band", "x", "y", "side").mapInArrow(_families(shingle, percent), "a bigint, b bigint")
        linked = stash(linked, "linked")
        if not linked.isEmpty():
            tested = tested.union(linked.select("a", "b", F.lit(True).alias("ok")))
            labels = joined()
    drop_stash(unsettled)
    drop_stash(texts)
    grouped = documents.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    grouped = stash(grouped, "grouped")
    for df in (met, possible, first, second, third, rest):
        drop_stash(df)
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    out = grouped.join(least, "component", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, all columns: of each component the one with the smallest id.

    Defined results: null, empty and blank texts stay; ids may be null or repeated, since rows are told apart by number:
    of linked rows of one id any one stays, and a null id stays only where no linked row has an id; texts of any length
    are compared whole; an empty table gives an empty one; other columns, whatever their names, are kept as they are.
    """
    rows, row, plain = with_rows(docs, id_col)
    said = near_dedup(rows, row, text_col, **options)
    if plain:
        kept = said.where("kept").select(row)
    else:
        ranked = rows.select(row, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("rank")).join(said.select(row, "component_id"), row)
        kept = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
