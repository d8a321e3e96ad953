import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm.packing import choose_cuts, pack
from codeloom.llm.pieces import START, Codec, combine, cut, default_model, encode, marked, resolve, round_trip
from codeloom.llm.token_files import Dac, dac_encode, read_tokens, token_files, write_tokens
from codeloom.llm.tokens import ChunkEncoder, default_vocabulary

from .conftest import frame


def ids_of(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, x in rows]


@pytest.mark.parametrize("width", [4, 8, 16])
def test_codes_give_any_token(width):
    ids = np.random.default_rng(2).choice([0, 3, 255, 256, 49407, 70000], 3000).astype("<u4")
    d = Dac(dac_encode(ids, width))
    assert [d[i] for i in range(0, 3000, 7)] == ids[::7].tolist() and d.slice(511, 1700).tolist() == ids[511:1700].tolist() and d.slice(5, 5).tolist() == []
    with pytest.raises(IndexError):
        d[3000]
    assert Dac(dac_encode(ids[:0])).n == 0


def test_chunks_encode_as_the_library(odd_rows):
    texts = [t for _, t in odd_rows if t] + ["don't. X.y, 3.14, \"a,\" é, É. <|endoftext|>Foo. BAR", "İ. K, Σας ΣΑΣ. 你好, ok.", "x\x85y, \x1cq, ①, ３,", "É. ö, a\n.b"]
    t, e = Tokenizer.from_file(default_vocabulary()), ChunkEncoder(default_vocabulary(), held=50)
    for x in texts:
        assert np.frombuffer(e.encode(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_files_round_trip(spark, odd_rows):
    rows = [r[:2] for r in odd_rows]
    out = token_files(frame(spark, rows).repartition(3), segment=500).collect()
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0))
    ids, want, start = ids_of(rows), [], 0
    for n in order:
        want.append((rows[n][0], start, len(ids[n]) // 4, zlib.crc32(ids[n])))
        start += len(ids[n]) // 4
    key = lambda r: (r[1],)
    assert sorted(((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in out), key=key) == want


def test_files_with_ids_and_of_nothing(spark):
    segments = write_tokens(frame(spark, [(2, "b c"), (1, "a")]))
    assert [np.frombuffer(r.ids, "<u4")[-1] for r in read_tokens(segments, with_ids=True).collect()] == [2, 2]
    assert token_files(frame(spark, []).where("false")).collect() == []


def check_packing(rows, out, length):
    ids = ids_of(rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in out:
        docs[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    for n, (i, _) in enumerate(rows):
        if sum(r[0] == i for r in rows) > 1 or i is None:
            continue
        at = 0
        for x in sorted(docs[i], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids[n]) // 4 and x.ids_crc32 == zlib.crc32(ids[n][4 * at : 4 * (at + x.length)])
            at += x.length
        assert at == len(ids[n]) // 4
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert 0 < at <= length
    return sum(0 if (n := sum(x.length for x in p)) & (n - 1) == 0 else length - n for p in sequences.values())


@pytest.mark.parametrize("length", [64, 4096])
def test_packing_places_every_id_once(spark, odd_rows, length):
    rows = [r[:2] for r in odd_rows]
    out = pack(frame(spark, rows).repartition(3), length=length).collect()
    assert sum(x.length for x in out) == sum(len(i) // 4 for i in ids_of(rows))
    padding = check_packing(rows, out, length)
    assert length != 64 or padding < 0.05 * sum(x.length for x in out)
    assert pack(frame(spark, []).where("false")).collect() == []


def test_cuts_are_optimal():
    rng = np.random.default_rng(8)
    for _ in range(40):
        places = np.cumsum(rng.integers(1, 12, 30)).tolist()
        costs = rng.choice([0.0, 3.0, 9.0], 30).tolist()
        at, best = [0, *places], [0.0]
        for j in range(1, 31):
            options = []
            for i in range(j):
                n = at[j] - at[i]
                if n <= 32:
                    options.append(best[i] + (0 if n >= 8 and n & (n - 1) == 0 else 32 - n) + 5 + costs[j - 1])
            best.append(min(options))
        cuts = [places[i] for i in choose_cuts(places, costs, 32, 5)]
        total, last = 0.0, 0
        for c in cuts:
            n = c - last
            total += (0 if n >= 8 and n & (n - 1) == 0 else 32 - n) + 5 + costs[places.index(c)]
            last = c
        assert total == pytest.approx(best[-1]) and last == places[-1]


@pytest.fixture(scope="module")
def codec():
    return Codec(default_model())


def encode_in_chunks(c, text, chunk):
    m, states, chain, out = marked(text), {}, [], []
    rows = cut(m, chunk)
    for lo, hi, inside, hard in rows:
        if inside or hard:
            chain.append((lo, c.transfer(m, lo, hi, c.entries(m, lo) if inside else [START], not hard)))
            if not hard:
                s = resolve([x[1] for x in chain])
                states |= {x[0]: y for x, y in zip(chain, zip(s, s[1:]))}
                chain = []
    for lo, hi, inside, hard in rows:
        if inside or hard:
            out += c.trace(m, lo, hi, *states[lo])
        else:
            out += np.frombuffer(c.segments(m[lo:hi]), "<u4").tolist()
    return out


@pytest.mark.parametrize("chunk", [7, 40, 16384])
def test_pieces_are_the_librarys(codec, words, chunk):
    texts = ["", "  ", " a", "a  b", "tab\tx\n\ny €𐍈  z ", "x" * 300, "日本語テキスト 한국어", "a" * 37 + "ß" * 9 + " " * 33 + "q", words(60, 4), words(80, 5).replace(" ", "")]
    for t in texts:
        assert encode_in_chunks(codec, t, chunk) == codec.lib.encode(t)
        assert codec.decode(codec.lib.encode(t)) == t.encode()


def test_round_trip_over_spark(spark, odd_rows, codec):
    import hashlib

    rows = [r[:2] for r in odd_rows]
    out = round_trip(frame(spark, rows).repartition(3), giant=1000, chunk=1000).collect()
    want = sorted((str(i), len(e := codec.lib.encode(t or "")), zlib.crc32(np.array(e, "<u4").tobytes()), len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.ids_crc32, x.n_chars, x.decoded_sha256) for x in out) == want
    assert round_trip(frame(spark, []).where("false")).collect() == []


def test_matrices_combine_in_any_grouping(codec, words):
    m = marked(words(40, 7).replace(" ", ""))
    moves = [codec.transfer(m, lo, hi, codec.entries(m, lo) if inside else [START], not hard) for lo, hi, inside, hard in cut(m, 9)]
    whole, third = combine(moves), len(moves) // 3
    assert whole == combine([combine(moves[:third]), combine(moves[third:])]) == combine([moves[0], combine(moves[1:])]) and whole[START] == [START]
    states = resolve(moves)
    assert states == [*resolve(moves[:third], START, states[third]), *resolve(moves[third:], states[third], START)[1:]]


def test_giant_words_go_up_and_down_the_tree(spark, words, codec):
    rows = [(1, words(250, 3).replace(" ", "")), (2, words(30, 2)), (3, "x" * 300), (4, None), (4, words(5, 1))]
    out = round_trip(frame(spark, rows).repartition(2), giant=7, chunk=7).collect()  # the first has more than 100 chunks
    assert sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in out) == sorted((i, len(e := codec.lib.encode(t or "")), zlib.crc32(np.array(e, "<u4").tobytes())) for i, t in rows)
    parts = sorted((x.doc_id, x.part, x.ids) for x in encode(frame(spark, rows), giant=40, chunk=40).collect() if x.doc_id != 4)
    assert {i: np.frombuffer(b"".join(p for j, _, p in parts if j == i), "<u4").tolist() for i in (1, 2, 3)} == {i: codec.lib.encode(t) for i, t in rows if i != 4}


def test_giant_texts_go_through_their_matrices(spark, codec, words):
    """Every chunk of every text over the length has a matrix of several states, whatever its spaces; texts without a space too."""
    from codeloom.llm.pieces import _read, matrices

    rows = [(1, words(9000, 3)), (2, words(9000, 4).replace(" ", "")), (3, "a " * 20_000), (4, " " * 40_000), (5, words(50, 5)), (6, "ñ🙂" * 20_000)]
    big = [r for r in rows if len(r[1]) >= 32_768]
    docs = frame(spark, rows)
    got = matrices(docs.selectExpr("doc_id AS id", "text"), default_model(), 32_768, 8_192).collect()
    assert len(big) == 5 and len(got) == sum(-(-len(marked(t)) // 8_192) for _, t in big)
    inner = [m for x in got if 0 < x.part for m in [_read(x.moves)]]
    assert sum(len(m) > 1 for m in inner) > len(inner) / 3 and all(m for m in inner)
    out = {x.doc_id: x for x in round_trip(docs).collect()}
    for i, t in rows:
        ids = codec.lib.encode(t)
        assert (out[i].n_tokens, out[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
