"""SentencePiece encoding and decoding by a max-plus parallel scan.

A path through a text is a sequence of vocabulary pieces; its weight is the sum over neighbouring pieces, 0 where the
library itself splits the two pieces' joint text into just them and minus infinity elsewhere. For byte-pair models the
library's segmentation is the one path of weight 0, so the best path gives the library's ids exactly, merges included.

Chunks. Texts of less than `giant` characters are one chunk, encoded and decoded where they are read. Longer ones are cut
every `chunk` characters, wherever that is. The states of a boundary are (piece, how far it reaches into the next chunk),
some dozens; a chunk's transfer matrix holds which states at its start lead with weight 0 to which at its end. No piece
reaches across the start of a run of spaces, so all paths meet in one state there: a matrix is found from the
characters up to the chunk's first such place and from its last one on, and what lies between has one path. Matrices are
combined associatively, FAN at a time, level upon level, until a text has one. Going down again, each level's two
boundary states settle those between the matrices below it, and every chunk is then traced back on its own. Characters
that no piece covers become their UTF-8 bytes; nothing merges with them.

Defined results: null or empty text has no ids; texts of any length are handled in bounded memory; null ids and repeated
rows are rows of their own (repeated rows with one id are told apart by their number in the input partition); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, emitter, rows_of, stash, task_id, unpacked

SPACE = "▁"
State = tuple[int, int]  # piece (-1 for none) and how many characters it reaches over the boundary
START: State = (-1, 0)
#: So many transfer matrices are combined in one step.
FAN = 64
_codecs: dict[str, "Codec"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Segments(dict):
    """Segment -> ids, in two generations: what was not asked for lately is forgotten."""

    def __init__(self, codec: "Codec") -> None:
        self.codec, self.old = codec, {}

    def __missing__(self, text: str) -> bytes:
        if (got := self.old.get(text)) is None:
            got = array("I", self.codec.trace_alone(text)).tobytes()
        if len(text) <= 64:
            self[text] = got
        return got

    def age(self, most: int) -> None:
        if len(self) >= most:
            self.old = dict(self)
            self.clear()


class Codec:
    """The vocabulary, the weights between pieces, and a bounded memory of segments."""

    def __init__(self, path: str, held: int = 400_000) -> None:
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        self.pieces = [self.lib.id_to_piece(i) for i in range(n)]
        special = [self.lib.is_byte(i) or self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i) for i in range(n)]
        self.id_of = {p: i for i, (p, s) in enumerate(zip(self.pieces, special)) if not s}
        self.longest = max(map(len, self.id_of))
        self.trie: dict = {}
        for p, i in self.id_of.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.bytes_of = {b: self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.known = _Segments(self)
        self.raw = [bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.pairs: list[dict[int, bool]] = [{} for _ in range(n)]
        self.known_pairs, self.held = 0, held
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("pieces that reach across spaces need another place to cut")

    # -- weights -----------------------------------------------------------------------------------------------------

    def library(self, text: str) -> list[int]:
        """The library's ids of a segment, without the space that it puts first."""
        if text.startswith(SPACE):
            return self.lib.encode(text[1:].replace(SPACE, " "))
        ids = self.lib.encode("\n" + text.replace(SPACE, " "))  # the space and the line feed before it merge with nothing
        return ids[ids.index(self.bytes_of[10]) + 1 :]

    def joins(self, a: int, b: int) -> bool:
        """Whether b may follow a: weight 0, else minus infinity. Nothing (-1) and uncovered characters go with all."""
        if a < 0 or b < 0:
            return True
        if (ok := self.pairs[a].get(b)) is None:
            if self.known_pairs >= 5 * self.held:
                self.known_pairs = 0
                for row in self.pairs:
                    row.clear()
            ok = self.pairs[a][b] = self.library(self.pieces[a] + self.pieces[b]) == [a, b]
            self.known_pairs += 1
        return ok

    # -- segments ----------------------------------------------------------------------------------------------------

    def segments(self, text: str) -> bytes:
        """Ids of a text that is cut at spaces only, as little-endian 32-bit bytes."""
        self.known.age(self.held)
        return b"".join(map(self.known.__getitem__, _parts.findall(text)))

    def trace_alone(self, text: str) -> list[int]:
        """trace() of a whole segment: with one state at its start, every place has one state too."""
        n, pairs, trie, joins = len(text), self.pairs, self.trie, self.joins
        last, start = [None] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for at in range(n):
            if (before := last[at]) is None:
                continue
            node, end, follows = trie, at, pairs[before].get if before >= 0 else None
            for c in text[at : at + self.longest]:
                if (node := node.get(c)) is None:
                    break
                end += 1
                if "" in node and last[end] is None:
                    piece = node[""]
                    ok = follows is None or follows(piece)
                    if ok or ok is None and joins(before, piece):
                        last[end], start[end] = piece, at
            if last[at + 1] is None and text[at] not in self.id_of:
                last[at + 1], start[at + 1] = -1, at
        out: list[list[int]] = []
        while n:
            at = start[n]
            out.append([last[n]] if last[n] >= 0 else [self.bytes_of[b] for b in text[at].encode("utf-8", "surrogatepass")])
            n = at
        return [i for ids in reversed(out) for i in ids]

    def steps(self, text: str, lo: int, hi: int, entry: State) -> list[dict[int, tuple[int, int]]]:
        """For every place from lo on: piece that ends there -> (place and piece before it), over paths of weight 0 that enter by `entry`. Pieces that start before hi may end after it."""
        back: list[dict[int, tuple[int, int]]] = [{} for _ in range(hi - lo + self.longest + 1)]
        back[entry[1]][entry[0]] = (-1, -1)
        for at in range(lo, hi):
            if not back[at - lo]:
                continue
            for n in range(1, min(self.longest, len(text) - at) + 1):
                if (piece := self.id_of.get(text[at : at + n])) is not None:
                    for before in back[at - lo]:
                        if self.joins(before, piece):
                            back[at - lo + n].setdefault(piece, (at, before))
                            break
            if text[at] not in self.id_of:
                back[at - lo + 1].setdefault(-2 - at, (at, next(iter(back[at - lo]))))
        return back

    def meets(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place from lo on and before hi where a run of spaces starts: all paths have one state there."""
        first = next((m.start() + 1 for m in _starts.finditer(text, max(lo - 1, 0), hi) if m.start() + 1 >= lo), hi)
        if first >= hi:
            return None
        last = hi
        while (last := text.rfind(SPACE, first, last)) > first and text[last - 1] == SPACE:
            pass
        return first, max(first, last)

    def transfer(self, text: str, lo: int, hi: int, entries: list[State], last: bool) -> dict[State, list[State]]:
        """Which states at hi each state at lo leads to; at the text's end only the state that reaches just there."""
        if (middle := self.meets(text, lo, hi)) is not None:
            first, tail = middle
            alive = [e for e in entries if e[1] == first - lo or e[1] < first - lo and self.steps(text, lo, first, e)[first - lo]]
            leave = self._across(text, tail, hi, START, last)
            return {e: leave for e in alive if leave}
        return {entry: self._across(text, lo, hi, entry, last) for entry in entries}

    def _across(self, text: str, lo: int, hi: int, entry: State, last: bool) -> list[State]:
        if entry[1] > hi - lo:
            return [(entry[0], entry[1] - (hi - lo))]
        back = self.steps(text, lo, hi, entry)
        found = []
        for over in range(self.longest):
            for piece, (at, _) in back[hi - lo + over].items():
                if at < hi:
                    found.append((max(piece, -1), over))
        return [START] if last and any(s[1] == 0 for s in found) else [] if last else sorted(set(found))

    def entries(self, text: str, at: int) -> list[State]:
        """All states that a boundary may have."""
        out = {(-1, 0)} if at == 0 or text[at - 1] not in self.id_of else set()
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                if (piece := self.id_of.get(text[start:end])) is not None:
                    out.add((piece, end - at))
        return sorted(out)

    def traced(self, text: str, lo: int, hi: int, entry: State, leave: State) -> bytes:
        """Ids of a chunk between two states, as little-endian 32-bit bytes: traced back at its ends, and looked up by segments where all paths meet."""
        pack = lambda ids: array("I", ids).tobytes()
        if (middle := self.meets(text, lo, hi)) is None:
            return pack(self.trace(text, lo, hi, entry, leave))
        first, last = middle
        return pack(self.trace(text, lo, first, entry, START)) + self.segments(text[first:last]) + pack(self.trace(text, last, hi, START, leave))

    def trace(self, text: str, lo: int, hi: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that start in lo + entry's reach and end at hi + leave's reach."""
        end = hi + leave[1]
        if lo + entry[1] >= end:
            return []
        back = self.steps(text, lo, hi, entry)
        at, choices = end - lo, back[end - lo]
        piece = leave[0] if leave[0] >= 0 else next((p for p in choices if p < 0 or self._ends(text, lo, at, p)), next(iter(choices), -1))
        out: list[list[int]] = []
        while at > entry[1]:
            before_at, before = back[at][piece]
            out.append([piece] if piece >= 0 else [self.bytes_of[b] for b in text[before_at].encode("utf-8", "surrogatepass")])
            at, piece = before_at - lo, before
        return [i for ids in reversed(out) for i in ids]

    def _ends(self, text: str, lo: int, at: int, piece: int) -> bool:
        return text.endswith(self.pieces[piece], 0, lo + at)

    # -- decoding ----------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text before encoding."""
        return b"".join(map(self.raw.__getitem__, ids))[1:]


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


_starts = re.compile(f"[^{SPACE}](?={SPACE})")


def cut(text: str, chunk: int) -> list[tuple[int, int, bool, bool]]:
    """(start, end, whether another chunk comes before, likewise behind) of the chunks of a marked text."""
    return [(lo, min(len(text), lo + chunk), lo > 0, lo + chunk < len(text)) for lo in range(0, len(text), chunk)]


CHUNK = "rk string, id bigint, part int, parts int, body string, lo int, hi int, inside boolean, open boolean, moves string"
_CHUNK = pa.schema([("rk", pa.string()), ("id", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("body", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("inside", pa.bool_()), ("open", pa.bool_()), ("moves", pa.string())])


def _write(moves: dict[State, list[State]]) -> str:
    return ";".join(f"{a},{b}>" + " ".join(f"{c},{d}" for c, d in to) for (a, b), to in moves.items())


def _read(moves: str) -> dict[State, list[State]]:
    out = {}
    for row in filter(None, moves.split(";")):
        key, to = row.split(">")
        out[tuple(map(int, key.split(",")))] = [tuple(map(int, x.split(","))) for x in to.split()]
    return out


def _state(text: str) -> State:
    a, b = text.split(",")
    return int(a), int(b)


def combine(moves: list[dict[State, list[State]]]) -> dict[State, list[State]]:
    """The max-plus product of neighbouring transfer matrices. It is associative, and rows that lead nowhere are left out."""
    out = moves[0]
    for m in moves[1:]:
        out = {a: to for a, mid in out.items() if (to := sorted({t for s in mid for t in m.get(s, ())}))}
    return out


def resolve(moves: list[dict[State, list[State]]], enter: State = START, leave: State = START) -> list[State]:
    """The states at the boundaries of neighbouring matrices between two that are known: forward reach, then back."""
    reach = [{enter}]
    for m in moves[:-1]:
        reach.append({t for s in reach[-1] for t in m.get(s, ())})
    out = [leave]
    for m, before in zip(reversed(moves), reversed(reach)):
        out.append(min(s for s in before if out[-1] in m.get(s, ())))
    return out[::-1]


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _chunks(path: str, chunk: int):
    def run(batches):
        put, flush = emitter(_CHUNK)
        number, task = 0, task_id()
        for i, text in rows_of(batches):
            number += 1
            whole = marked(text or "")
            rows = cut(whole, chunk)
            reach = codec(path).longest
            for part, (lo, hi, inside, hard) in enumerate(rows):
                a = max(0, lo - reach) if inside else lo
                b = min(len(whole), hi + reach) if hard else hi
                c, body = codec(path), whole[a:b]
                moves = _write(c.transfer(body, lo - a, hi - a, c.entries(body, lo - a) if inside else [START], not hard))
                yield from put((f"{task}:{number}", i, part, len(rows), body, lo - a, hi - a, inside, hard, moves), b - a + 100)
        yield from flush()

    return run


_LEVEL = pa.schema([("rk", pa.string()), ("part", pa.int32()), ("moves", pa.string())])
_STATES = pa.schema([("rk", pa.string()), ("part", pa.int32()), ("enter", pa.string()), ("leave", pa.string())])


def _groups(batches):
    """Rows (rk, part, ...) sorted by rk and part, in groups of FAN parts."""
    key, group = None, []
    for row in rows_of(batches):
        if (row[0], row[1] // FAN) != key:
            if group:
                yield key, group
            key, group = (row[0], row[1] // FAN), []
        group.append(row)
    if group:
        yield key, group


def _up(batches):
    """(rk, part, moves) of one level -> those of the next, a FAN-th as many."""
    put, flush = emitter(_LEVEL)
    for (rk, part), group in _groups(batches):
        yield from put((rk, part, _write(combine([_read(m) for _, _, m in group]))))
    yield from flush()


def _down(batches):
    """(rk, part, moves, enter, leave), the states being those of the FAN parts together -> the states of each part."""
    put, flush = emitter(_STATES)
    for (rk, _), group in _groups(batches):
        states = resolve([_read(m) for _, _, m, _, _ in group], _state(group[0][3]), _state(group[0][4]))
        for (_, part, *_), a, b in zip(group, states, states[1:]):
            yield from put((rk, part, f"{a[0]},{a[1]}", f"{b[0]},{b[1]}"))
    yield from flush()


def boundary_states(moves: DataFrame) -> DataFrame:
    """(rk, part, enter, leave) of every chunk from (rk, part, moves): matrices combined up a tree, states settled down it."""
    level, levels, most = moves, [], moves.agg(F.max("part")).first()[0] or 0
    dealt = lambda df: df.withColumn("g", F.floor(F.col("part") / FAN)).repartition("rk", "g").drop("g").sortWithinPartitions("rk", "part")
    while most > 0:
        levels.append(level)
        level = stash(dealt(level).mapInArrow(_up, "rk string, part int, moves string"), "level")
        most //= FAN
    states = level.select("rk", "part", F.lit("-1,0").alias("enter"), F.lit("-1,0").alias("leave"))
    for below in reversed(levels):
        above = states.select("rk", F.col("part").alias("g"), "enter", "leave")
        joined = below.withColumn("g", F.floor(F.col("part") / FAN).cast("int")).join(above, ["rk", "g"]).select("rk", "part", "moves", "enter", "leave")
        states = dealt(joined).mapInArrow(_down, "rk string, part int, enter string, leave string")
    return states


IDS = "rk string, id bigint, part int, n bigint, ids binary"
_IDS = pa.schema([("rk", pa.string()), ("id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])


def _encode(path: str):
    """Chunks whose boundary states are known -> their ids; with states null, whole texts."""

    def run(batches):
        c = codec(path)
        put, flush = emitter(_IDS)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for rk, i, part, body, lo, hi, inside, hard, enter, leave in rows_of(batches):
            if inside or hard:
                raw = c.traced(body, lo, hi, _state(enter), _state(leave))
            else:
                raw = c.segments(body[lo:hi])
            small = squeeze(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if len(c.pieces) <= 1 << 16 else raw)
            yield from put((rk, i, part, len(raw) // 4, small), len(small) + 80)
        yield from flush()

    return run


def _wide(c: Codec, small: bytes) -> bytes:
    """Ids as shuffled -> little-endian 32-bit integers."""
    raw = unpacked(small)
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(c.pieces) <= 1 << 16 else raw


def matrices(rows: DataFrame, path: str, giant: int, chunk: int) -> DataFrame:
    """The chunks of giant texts with their transfer matrices (moves), written to the shared folder."""
    return stash(rows.where(F.length("text") >= giant).mapInArrow(_chunks(path, chunk), CHUNK), "chunks")


def _giants(rows: DataFrame, path: str, giant: int, chunk: int) -> DataFrame:
    """(rk, id, part, n, ids) of the chunks of giant texts; ids as _encode packs them."""
    chunks = matrices(rows, path, giant, chunk)
    cols = ["rk", "id", "part", "body", "lo", "hi", "inside", "open", "enter", "leave"]
    named = chunks.join(boundary_states(chunks.select("rk", "part", "moves")), ["rk", "part"])
    return named.select(*cols).repartition("rk", "part").mapInArrow(_encode(path), IDS)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """(id, rk, part, n_tokens, ids): ids of every chunk in little-endian 32-bit integers. rk names the input row of a text of several chunks, which are the whole text in order of part; it is null for others."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        c = codec(path)
        put, flush = emitter(_IDS)
        for i, text in rows_of(batches):
            raw = c.segments(marked(text or ""))
            yield from put((None, i, 0, len(raw) // 4, raw), len(raw) + 80)
        yield from flush()

    def widen(batches):
        c = codec(path)
        for b in batches:
            yield b.set_column(4, "ids", pa.array([_wide(c, z) for z in b.column(4).to_pylist()], pa.binary()))

    alone = rows.where(F.coalesce(F.length("text"), F.lit(0)) < giant).mapInArrow(run, IDS)
    return alone.union(_giants(rows, path, giant, chunk).mapInArrow(widen, IDS)).select(F.col("id").alias(id_col), "rk", "part", F.col("n").alias("n_tokens"), "ids")


DONE = "id bigint, n_tokens bigint, ids_crc32 bigint, n_chars bigint, decoded_sha256 string"
_DONE = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chars", pa.int64()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, giant: int = 32_768, chunk: int = 8_192) -> DataFrame:
    """(id, n_tokens, ids_crc32, n_chars, decoded_sha256) of every row: encodes each text and decodes its ids again. A giant text's chunks are read in order and never held together."""
    bounded_batches(docs.sparkSession)
    path = model or default_model()
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = lambda text: int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)) if text else 0

    def alone(batches):
        c = codec(path)
        put, flush = emitter(_DONE)
        for i, text in rows_of(batches):
            raw = c.segments(marked(text or ""))
            back = c.decode(memoryview(raw).cast("I"))
            yield from put((i, len(raw) // 4, zlib.crc32(raw), chars(back), hashlib.sha256(back).hexdigest()), 200)
        yield from flush()

    def run(batches):
        c = codec(path)
        put, flush = emitter(_DONE)
        key, state = None, None

        def done():
            i, n, crc, size, sha = state
            return put((i, n, crc, size, sha.hexdigest()))

        for rk, i, part, n, small in rows_of(batches):
            if rk != key:
                if key is not None:
                    yield from done()
                key, state = rk, [i, 0, 0, 0, hashlib.sha256()]
            raw = _wide(c, small)
            ids = memoryview(raw).cast("I")
            text = c.decode(ids) if part == 0 else c.decode([c.id_of[SPACE], *ids])
            state[1] += n
            state[2] = zlib.crc32(raw, state[2])
            state[3] += chars(text)
            state[4].update(text)
        if key is not None:
            yield from done()
        yield from flush()

    small = rows.where(F.coalesce(F.length("text"), F.lit(0)) < giant).mapInArrow(alone, DONE)
    giant = _giants(rows, path, giant, chunk).repartition("rk").sortWithinPartitions("rk", "part").mapInArrow(run, DONE)
    return small.union(giant).withColumnRenamed("id", id_col)
