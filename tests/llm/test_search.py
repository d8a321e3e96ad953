"""License scans, ranked search and hard negatives against plain Python, on odd rows and beyond one block."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import hard_negatives as hn
from codeloom.llm import ranked_search as rs
from codeloom.llm.license_rules import RULES
from codeloom.llm.license_scan import REACH, scan, trie, with_base
from codeloom.llm.queries import PHRASES

from .conftest import SCHEMA, frame

LINES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "cc by nc cc by nc", "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public License", "under the mit license under the mit license", "under the mit licenses", "mit Lizenz", "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved. Proprietary.", "ünder the mit license",
    "Creative Commons Attribution 4.0 International License", "bsd 3-clause", "Neither the name of the X Y Z nor the names of its contributors", "CC0 1.0 Universal", "the cc", "gnu", "GNU Free Documentation License 1.3",
]


def scanned(text, phrases=PHRASES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    places = {(i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
    found = []
    for i in range(len(words)):
        near = " ".join(words[i : i + REACH + 8])
        found += [(i, i + len(m[0].split()), r) for r in with_base(phrases) if near.startswith(r.keyword) and (m := re.match(f"(?:{r.regex})(?= |$)", near))]
    beats = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and e[2].priority >= d[2].priority and (e[:2] != d[:2] or (e[2].priority, -e[2].ord) > (d[2].priority, -d[2].ord))
    kept = [d for d in found if d[2].base or not any(beats(e, d) for e in found)]
    starts = [i for i, _ in places]
    join = lambda x: ",".join(sorted(set(x)))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), join(phrases[p] for _, p in places), join(d[2].label for d in kept), max((d[2].confidence for d in kept), default=0.0), len(kept)


def test_license_scan_equals_plain_python(spark, odd_rows):
    rng = random.Random(3)
    rows = odd_rows + [(100 + n, " ".join(rng.choices(LINES, k=rng.randint(1, 12)))) for n in range(150)] + [(99, " x ".join(LINES * 200))]
    got = sorted(repr(tuple(r)) for r in scan(frame(spark, rows), PHRASES).collect())
    assert got == sorted(repr((i, *scanned(t))) for i, t, *_ in rows)
    assert scan(spark.createDataFrame([], SCHEMA), PHRASES).collect() == []


def test_rules_are_read_and_short_enough():
    assert len(RULES) > 250 and all(r.regex.startswith(r.keyword) and re.fullmatch("[a-z0-9 ]+", r.keyword) for r in RULES)
    assert max(len(r.regex.split()) for r in RULES) + 8 <= REACH
    words = [r.keyword for r in RULES]
    assert all(re.match(f"(?:{trie(words)})( |$)", w)[0].strip() == w for w in words) and not re.match(f"(?:{trie(words)})( |$)", "mitt license")


def ranking(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    bags = [(i, Counter(w), len(w)) for i, t, *_ in docs if (w := cut(t))]
    total, df, out = sum(n for *_, n in bags), Counter(w for _, c, _ in bags for w in c), []
    for item, text in items:
        scores = []
        for i, c, n in bags:
            m = 25 + (75 * n * len(bags)) // total
            score = sum(floor(1000 * log((2 * len(bags) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if score > 0:
                scores.append((-score, i is None, i, score))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def in_items(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "item_id bigint, text string, terms string, n int")


@pytest.mark.parametrize("sizes", [{}, {"shard": 7, "most_terms": 40}])
def test_ranked_search_equals_plain_python(spark, odd_rows, words, sizes):
    rng = random.Random(4)
    common = words(40, 8).split()
    docs = odd_rows + [(200 + n, " ".join(rng.choices(common, k=rng.randint(1, 60)) + words(20, n).split())) for n in range(160)] + [(1000 - n, words(12, 77)) for n in range(14)]
    items = [(n, " ".join(rng.choices(common, k=rng.randint(1, 8)) + words(3, 300 + n).split())) for n in range(25)] + [(70, None), (71, ""), (72, "zzz qqq"), (73, words(12, 77)), (73, words(12, 77)), (None, "Hello, hello"), (75, "ÑANDÚ ñandú")]
    got = [tuple(r) for r in rs.search(frame(spark, docs), in_items(spark, items), **sizes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, ranking(docs, items)))


def test_ranked_search_of_nothing(spark, odd_rows):
    assert rs.search(frame(spark, []).where("false"), in_items(spark, [(1, "a b")])).collect() == []
    assert rs.search(frame(spark, odd_rows), in_items(spark, []).where("false")).collect() == []
    assert rs.search(frame(spark, [(1, None), (2, " . ")]), in_items(spark, [(1, "a")])).collect() == []


def test_maxscore_leaves_postings_unread():
    rng = np.random.default_rng(2)
    n = np.full(4000, 50)
    often, rare = np.arange(4000), rng.choice(4000, 40, replace=False)
    sizes = np.ones(4000, int)
    sizes[rare] += 1
    terms = np.concatenate([[0, 1][: s] for s in sizes])
    shard = rs.Shard(n, sizes, terms, np.ones(len(terms), int), np.array([10, 5000]), 4000, 200_000)
    asked, times, count = np.array([0, 1]), np.array([1, 1]), Counter()
    found, scores = shard.search(asked, times, 0)
    kth = int(np.sort(scores)[-10])
    again, _ = shard.search(asked, times, kth, count)
    assert len(found) == 4000 and set(again) == set(rare) and count["read"] == 40 and count["probed"] == 40 and count["all"] == 4040


V = "vec_id bigint, embedding array<float>, label int, row string, q string, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "r", "q", 1) for i, v, y in rows], V)


def mined(rows):
    """By brute force, rows of no use left out."""
    use = [(n, i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))[:5]
    out = []
    for n, i, y, q in use:
        if i is not None and i % 100 == 0:
            for p, pi, _ in first([(dot(q, v), j, k) for k, j, z, v in use if z == y and k != n]):
                out += [(i, pi, r, ni, p, s) for r, (s, ni, _) in enumerate(first([(dot(q, v), j, k) for k, j, z, v in use if z != y and 80 * p <= 100 * dot(q, v) <= 100 * p]), 1)]
    return out


def mine(spark, rows, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hn.hard_negatives(vectors(spark, rows), label=label, **sizes).collect()]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "anchors": 2, "sample": 20, "pivots": 3}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 8))
    rows = [(n * 5, (centres[n % 4] + rng.normal(size=8) * 0.6).tolist(), int(n % 3)) for n in range(240)]
    same = (centres[0] * 1.1).tolist()
    rows += [(2000 + n, same, n % 2) for n in range(60)]  # one very common vector
    rows += [(300, rows[60][1], 1), (None, same, 1), (7, None, 1), (14, [1.0, None] * 4, 1), (21, [float("nan")] * 8, 0), (28, [float("inf")] * 8, 0), (35, same, None), (42, [], 2), (49, [1.0, 2.0], 1), (600, [0.5] * 8, 2), (56, [-1.0] * 8, 1)]
    assert sorted(map(repr, mine(spark, rows, **sizes))) == sorted(map(repr, mined(rows)))


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    assert mine(spark, [(1, [1.0], 0)]) == [] and hn.hard_negatives(vectors(spark, []).where("false")).collect() == []
    assert mine(spark, [(100, [], 0), (200, [], 0), (3, [], 1)]) == [(100, 200, 1, 3, 0, 0), (200, 100, 1, 3, 0, 0)]
    big = [(100, [3e5, 1.0], 0), (1, [2e5, 1.0], 0), (2, [1.9e5, 3.0], 1)]
    assert mine(spark, big) == mined(big)
    assert len(mine(spark, [(100, [3e38], 0), (1, [3e38], 0), (2, [3e38], 1)])) == 1


def test_brackets_leave_rows_unread():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 32)) * 4
    q = np.floor(256 * (centres[np.arange(2000) % 10] + rng.normal(size=(2000, 32)) * 0.2)).astype(np.int64)
    m = float((q * q).sum(1).max()) + 1
    pivot = hn.Pivots(q[:200], m, 16)
    far, cells = pivot.of_rows(q), pivot.of_rows(q).argmin(1)
    search = hn.Search([(0, 0, 0, q[0], pivot.of_anchors(q[:1])[0])], m, 5, None, 1.0)
    for c in sorted(set(cells), key=lambda c: c != cells[0]):
        at = np.flatnonzero(cells == c)
        search.meet(hn.Block(0, at, at, q[at], far[at], True))
    true = q @ q[0]
    assert set(search.best[0][0][0]) == set(np.sort(true[1:])[-5:]) and search.checked < 500
