import gc
import hashlib
import os
import random
import re
import weakref
from collections import Counter, defaultdict

import pytest

from codeloom.llm.common import components, drop_stash, stash, stashed_alone
from codeloom.llm.exact_dedup import Filter, Run, drop_copies, exact_dedup
from codeloom.llm.minhash_dedup import Scheme, drop_near_copies, near_dedup, shingles
from codeloom.llm.suffix_dedup import covered, parse, remove_repeats, repeated_windows, suffix_dedup

from .conftest import frame


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {(i, hashlib.sha256(k.encode()).hexdigest()): (min(v)[2], len(v)) for k, v in groups.items() for _, _, i in v}


@pytest.mark.parametrize("options", [{}, {"digest_bits": 8, "memtable_rows": 3}, {"memtable_bytes": 100, "fan_in": 2}])
def test_exact_matches_brute_force(spark, odd_rows, options):
    rows = [r[:2] for r in odd_rows]
    out = exact_dedup(frame(spark, odd_rows), **options).collect()
    assert len(out) == len(rows)
    assert {(x.doc_id, x.text_sha256): (x.keep_id, x.group_size) for x in out} == brute_exact(rows)
    assert all(x.kept == (x.doc_id == x.keep_id) for x in out)


def test_exact_empty_table(spark):
    assert exact_dedup(frame(spark, []).where("false")).collect() == []


def test_drop_copies_keeps_columns_and_one_row_a_group(spark, odd_rows):
    docs = frame(spark, [r for r in odd_rows if r[0] is not None])
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 6, 7, 8, 10, 11, 12, 13, 14, 16]  # case counts, so 7 and 8 differ


def test_runs_and_filters():
    keys = {hashlib.sha256(str(i).encode()).digest(): [i, i, 1] for i in range(500)}
    run = Run(dict(keys))
    assert all(run.find(k)[0] == v[0] for k, v in keys.items())
    assert all(run.filter.may_hold(k) for k in keys)
    absent = [hashlib.sha256(f"n{i}".encode()).digest() for i in range(500)]
    assert sum(Filter(list(keys)).may_hold(k) for k in absent) < 50 and not any(run.find(k) for k in absent)


def brute_near(rows, k, percent=80):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[n] = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()
    up = {n: n for n in sets}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in sets:
        for b in range(a):
            if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for n in sets:
        least[top(n)].append(rows[n][0])
    return sorted((rows[n][0] if rows[n][0] is not None else -1, len(sets[n]), min(least[top(n)]) if rows[n][0] is not None else -1) for n in sets)


def near_rows(words):
    rows, n = [], 100
    for g in range(12):
        base = words(60 + 20 * g, g).split()
        for c in range(6):
            copy = list(base)
            for j in range(c * len(base) // 40):
                copy[(j * 17 + c) % len(copy)] = f"w{g}{c}{j}"
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_matches_brute_force(spark, odd_rows, words, k):
    rows = [r[:2] for r in odd_rows] + near_rows(words)
    out = near_dedup(frame(spark, rows).repartition(3), shingle=k).collect()
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id if x.component_id is not None else -1) for x in out)
    assert got == brute_near(rows, k)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out)


@pytest.mark.parametrize("held,unit", [(25, 2000), (8000, 20)])
def test_near_joins_stars_with_a_late_base(spark, held, unit):
    rng, rows, base = random.Random(3), [], [f"b{i}" for i in range(150)]
    for c in range(700):
        copy = list(base)
        for j, at in enumerate(rng.sample(range(150), 7)):
            copy[at] = f"s{c}x{j}"
        rows.append((c, " ".join(copy)))
    rows.append((5000, " ".join(base)))
    out = near_dedup(frame(spark, rows).repartition(6), shingle=2, held=held, unit=unit).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == brute_near(rows, 2)


def test_near_of_nothing(spark):
    assert near_dedup(frame(spark, []).where("false")).collect() == []
    assert drop_near_copies(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).select("doc_id").collect()[0][0] == 1


def test_pigeonhole_guarantee():
    import numpy as np

    scheme, rng = Scheme(0.8, 12, 6, 1), np.random.default_rng(1)
    sig = scheme.signature(shingles(b"one two three four five six seven", 2))
    for _ in range(300):
        other = sig.copy()
        at = rng.choice(len(sig), 23, replace=False)
        other[at] ^= np.uint64(1)
        assert set(scheme.keys(sig).tolist()) & set(scheme.keys(other).tolist())


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    out = {r.node: r.component for r in components(links).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100


def join_rows(spark):
    """Rows that all joins of the session have made so far."""
    store, out = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        metrics = [n.metrics() for n in map(nodes.apply, range(nodes.size())) if "Join" in n.name()]
        ids = [m.accumulatorId() for ms in metrics for m in map(ms.apply, range(ms.size())) if m.name() == "number of output rows"]
        out += sum(int(values.get(i).get().replace(",", "")) for i in ids if values.get(i).isDefined())
    return out


def test_components_of_a_shuffled_chain(spark):
    order = list(range(500))
    random.Random(3).shuffle(order)
    out = components(spark.createDataFrame(list(zip(order, order[1:])), "u bigint, v bigint")).collect()
    assert sorted((r.node, r.component) for r in out) == [(i, 0) for i in range(500)]


def test_components_join_links_once(spark):
    rng = random.Random(3)
    links = {(10_000 + i, rng.randrange(30)) for i in range(2000) for _ in range(6)}
    df, before = spark.createDataFrame(sorted(links), "u bigint, v bigint"), join_rows(spark)
    out = {r.node: r.component for r in components(df).collect()}
    assert set(out.values()) == {0} and len(out) == len({x for link in links for x in link})
    assert join_rows(spark) - before < 3 * len(links)


def brute_suffix(texts, length):
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("group,passage", [(16_384, None), (2, None), (16_384, 200), (2, 90)])
def test_suffix_matches_brute_force(spark, odd_rows, words, group, passage):
    shared = words(90, 77)
    rows = [r[:2] for r in odd_rows if len(r[1] or "") < 10_000]
    rows += [(100 + i, f"{words(30, i)} {shared} {words(30, 50 + i)}") for i in range(14)] + [(200, "abc" * 400), (201, "x" * 900), (202, words(40, 3) + shared[:401])]
    out = suffix_dedup(frame(spark, rows).repartition(3), group=group, passage=passage).collect()
    want = brute_suffix([(t or "").encode() for _, t in rows], 400)
    if passage:
        short = brute_suffix([(t or "").encode() for _, t in rows], passage)
        assert sorted((x.n_bytes, x.n_passage_bytes, x.n_removed) for x in out) == sorted((a[0], b[1], a[1]) for a, b in zip(want, short))
    key = lambda i: -1 if i is None else i
    assert sorted((key(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out) == sorted((key(i), *w) for (i, _), w in zip(rows, want))


def test_suffix_of_nothing(spark):
    assert suffix_dedup(frame(spark, []).where("false")).collect() == []


def test_large_and_small_groups_agree(words):
    shared = words(100, 5).encode()
    contexts = []
    for i in range(60):
        text = words(8, i).encode()[: 3 + i % 5] + shared[: 460 - i % 7] + words(8, 90 + i).encode()
        contexts.append((text, 60))
    contexts = [(c, 60) for c in {c for c, _ in contexts}]
    a, b = repeated_windows(contexts, 400, small=1000), repeated_windows(contexts, 400, small=1)
    assert all((x == y).all() for x, y in zip(a, b)) and any(x.any() for x in a)


def test_parse_gives_every_window_its_trigger(words):
    text = words(800, 9).encode()
    at, lo, hi = parse(text, 400)
    assert lo[0] == 0 and hi[-1] == len(text) - 400 and (lo[1:] == hi[:-1] + 1).all() and ((lo <= at) | (at >= lo)).all()
    assert covered(1000, [(0, 3), (2, 9), (500, 500)], 400) == [(0, 409), (500, 900)]


def test_remove_repeats_keeps_columns(spark, words):
    shared = words(120, 1)
    docs = frame(spark, [(1, "é " + shared + " one"), (2, "ü " + shared + " two"), (3, None), (4, "short")])
    out = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns and len(out) == 4
    assert shared not in out[1].text and out[1].n_chars == len(out[1].text) and out[3].text is None and out[4].text == "short"


def test_remove_repeats_takes_passages_of_more_than_fifty_words(spark, words):
    passages = [words(51 + n, 500 + n) for n in range(4)]
    rows = [(i, f"{words(80, i)} {passages[i % 4]} {words(60, 100 + i)}") for i in range(12)] + [(50, words(150, 77))]
    out = {r.doc_id: r.text for r in remove_repeats(frame(spark, rows).repartition(3)).collect()}
    assert all(len(passages[i % 4]) - 2 <= len(t) - len(out[i]) <= len(passages[i % 4]) + 8 for i, t in rows[:12]) and out[50] == rows[-1][1]


def test_stages_tell_rows_of_one_id_apart(spark, words):
    """Repeated and null ids: different texts stay apart, equal ones are one group."""
    shared, other = words(90, 1), words(70, 2)
    rows = [(1, "a " + shared), (1, other), (2, "b " + shared), (None, "c " + shared), (None, words(50, 3)), (1, other + " ")]
    texts = lambda df: sorted((r.doc_id is None, r.doc_id, r.text) for r in df.collect())
    docs = frame(spark, rows)
    assert texts(drop_copies(docs)) == sorted((i is None, i, t) for i, t in [*rows[:1], *rows[2:]])
    assert texts(drop_near_copies(docs)) in [sorted((i is None, i, t) for i, t in [rows[0], x, rows[4]]) for x in (rows[1], rows[5])]
    cut = texts(remove_repeats(docs))
    assert len(cut) == 6 and sum(shared in t for _, _, t in cut) == 0 and sum(t == rows[4][1] for _, _, t in cut) == 1 and sum(len(t) < 10 for _, _, t in cut) == 5


def test_near_loses_no_link_on_the_driver_table(spark):
    """All links of the documents at sf0.01, by an index of shingles: measured recall and precision of 1."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    out = near_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), shingle=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out) == brute_near(rows, 2)


def test_stashed_tables_are_not_held(spark):
    def held():
        df = stash(spark.range(3), "held")
        return weakref.ref(df), df._stash_path.removeprefix("file://")

    gone, path = held()
    gc.collect()
    assert gone() is None and os.path.isdir(path)
    paths = []

    def inner():
        paths.append(held()[1])
        drop_stash(dropped := stash(spark.range(2), "dropped"))
        assert dropped._stash_path is None
        return spark.range(4)

    def outer():
        out = stashed_alone(inner, "inner")
        paths.append(out._stash_path.removeprefix("file://"))
        return out

    out = stashed_alone(outer, "outer")
    assert out.count() == 4 and not any(map(os.path.exists, paths)) and os.path.isdir(path)
