import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm.fingerprints import fingerprint_neighbours, likeness
from codeloom.llm.langid import SIZE, Model, drop_unknown, features, held_out, identify, train
from codeloom.llm.quality import STATS, classify, fit, lasso_logistic, statistics
from codeloom.llm.url_filter import canonical, host_and_path, in_list, judge

from .conftest import frame


def test_language_id_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = identify(docs, train(docs, ~held_out("doc_id", 3, 1))).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 3, 1)).collect()
    assert sum(x.lang_pred == x.lang for x in out) / len(out) > 0.95 and all(0 <= x.score <= 1 for x in out)
    assert {x.doc_id % 1 for x in out} == {0} and all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in out)


def test_language_id_of_odd_rows(spark, odd_rows):
    langs = ["en", "de", "fr", None]
    docs = frame(spark, [(*r, langs[n % 4]) for n, r in enumerate(odd_rows)])
    out = identify(docs, train(docs, F.lit(True))).collect()
    assert len(out) == len(odd_rows)
    und = sorted(x.doc_id for x in out if x.lang_pred == "und")
    assert und == [1, 2, 3, 16] and {x.lang_pred for x in out} <= {"und", "en", "de", "fr"}
    assert identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert train(docs, F.lit(False)) is None
    assert sorted(r.doc_id for r in drop_unknown(docs).where("doc_id is not null").collect() if r.doc_id in und) == []
    assert drop_unknown(docs).columns == docs.columns


def test_every_labelled_language_is_learned(spark):
    say = lambda n: " ".join(chr(0x4E00 + 7 * n + j) * 2 for j in range(7))
    docs = frame(spark, [(2 * n + c, say(n) + " " * c, f"x{n:03}") for n in range(120) for c in range(2)])
    model = train(docs, F.lit(True))
    assert model.langs == [f"x{n:03}" for n in range(120)]
    assert all(x.lang_pred == f"x{x.doc_id // 2:03}" for x in identify(docs, model).collect())


def test_languages_are_learned_from_compressed_features(spark, words, monkeypatch):
    docs = frame(spark, [(n, words(60, n) if n % 2 else words(60, n).upper() + " жук", ("en", "ru")[n % 2]) for n in range(60)] + [(60, words(60, n), "en") for n in range(61, 64)])
    came, collect = [], type(docs).collect

    def counted(df):
        rows = collect(df)
        came.extend(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))
        return rows

    monkeypatch.setattr(type(docs), "collect", counted)
    model = train(docs, F.lit(True))
    assert len(came) == 63 and max(came) < SIZE  # of 4 * SIZE bytes each
    rows = sorted(((r.lang, r.h, features(r.text).tobytes()) for r in collect(docs.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))))))
    plain = Model(np.frombuffer(b"".join(x for _, _, x in rows), np.float32).reshape(len(rows), -1), [v for v, _, _ in rows])
    assert model.langs == plain.langs and np.array_equal(model.family_w, plain.family_w)


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = classify(docs, labels, held_out=held_out("doc_id", 4, 2)).join(labels, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in out) / len(out) > 0.85
    assert all(x.predicted == int(x.score >= 0.7) for x in out)


def test_quality_of_odd_rows_and_labels(spark, odd_rows):
    docs = frame(spark, odd_rows)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (5, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    out = classify(docs, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= x.score <= 1 for x in out)
    assert {x.score for x in classify(docs, labels.where("false")).collect()} == {0.5}
    assert classify(docs.where("false"), labels).collect() == []


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, len(STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    model = fit(x, y)
    assert 0 < len(model.rules) < 60
    scores = [r[0] for r in spark.createDataFrame(x[:50].tolist(), STATS).select(model.column()).collect()]
    assert [s > 0.5 for s in scores] == [bool(v) for v in y[:50]]
    _, w = lasso_logistic(np.hstack([y[:, None], rng.random((600, 5))]), y, 0.02)
    assert w[0] > 0 and np.count_nonzero(w) <= 3
    assert len(statistics(b"")) == len(STATS)


def test_fingerprints(spark, odd_rows, words):
    rows = [r[:2] for r in odd_rows if r[0] is not None and r[0] != 7] + [(50 + i, words(200, i % 20)) for i in range(40)]
    out = {x.doc_id: x for x in fingerprint_neighbours(frame(spark, rows).repartition(3), most=0.5).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    assert len(out) == len(rows)
    for i, j in zip(order, order[1:] + order[:1]):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[j][:third]
        assert out[i].n_chars == len(texts[i]) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i].near_next == likeness(out[i].fingerprint, out[j].fingerprint)
    marks = {}
    for i, x in out.items():
        assert marks.setdefault(texts[i], x.fingerprint) == x.fingerprint
    fresh = [out[50 + i] for i in range(20)]
    assert np.mean([x.near_edited for x in fresh]) > np.mean([x.near_next for x in fresh if x.near_next < 1]) + 0.2


def test_fingerprints_of_few_rows(spark):
    assert fingerprint_neighbours(frame(spark, []).where("false")).collect() == []
    (x,) = fingerprint_neighbours(frame(spark, [(1, "abc")])).collect()
    assert x.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and x.near_next == 1.0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.com/de/x?q#f", "http://notexample.com/de/", "http://x.org/fr/", "http://x.org", None, "no url", "ftp://net?x", "://h/p",
    "http://www.a.io/x/?utm_source=1&b=2#z", "https://a.io/x?b=2", "http://a.io/x", "http://a.io/y?ref=1", "http://fooexample.net/en/",
]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("w0", F.lit(1)).withColumn("listed", F.lit(1))
    listed = spark.createDataFrame([("http://A.io/x?b=2",), ("https://a.io/y/",), (None,), ("",), ("https://a.io/y/",)], "url string")
    for options in ({}, {"broadcast_blocks": 0}):
        hits = in_list(pages.select("page_id", "url"), listed, "url", **options).where("is_listed").collect()
        assert sorted(r.page_id for r in hits) == [10, 11, 13]
    out = {r.page_id: r for r in judge(pages, listed, RULES).collect()}
    assert len(out) == len(URLS)
    assert [out[i].rule for i in range(len(URLS))] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None, None, None, None, "net/"]
    assert [out[i].verdict for i in range(len(URLS))] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "block", "allow", "block", "block"]
    assert (out[2].host, out[2].path, out[8].host, out[8].path, out[7].host) == ("example.com", "/de/x", "net", "", "")
    assert judge(pages.where("false"), listed, RULES).collect() == [] and judge(pages, listed.where("false"), RULES).count() == len(URLS)


@pytest.mark.parametrize("url,want", [("HTTP://WWW.A.com/P/?ref=1&x=2&utm_term=3#f", "a.com/P?x=2"), ("a.com/x", ""), ("http://a.com", "a.com")])
def test_canonical(spark, url, want):
    one = spark.createDataFrame([(url,)], "u string")
    assert one.select(canonical(F.col("u"))).first()[0] == want
    assert host_and_path(F.col("u")) is not None


def test_rejection_has_a_margin_whatever_the_languages(spark, words):
    """Texts that two families claim alike go, clear ones stay; the margin is between the best two, however many there are."""
    from codeloom.llm.langid import Model, features

    texts = {"en": "the house and the garden with this thing", "fr": "la maison et le jardin avec cette chose", "ru": "дом и сад с этой вещью", "tr": "ev ve bahçe bu şey ile"}
    for langs in (("en", "fr"), ("en", "fr", "ru", "tr")):
        names = [v for v in langs for _ in range(5)]
        m = Model(np.stack([features(texts[v] + " " + texts[v].split()[i]) for v in langs for i in range(5)]), names)
        assert all(m.margin(features(texts[v])) > 0.5 for v in langs)
        w = m.family_w[0] - m.family_w[1]
        between = -w[-1] * w[:-1] / (w[:-1] @ w[:-1])  # where the first two families decide alike
        assert len(langs) > 2 or m.margin(between) < 1e-6
    rows = [(n, texts[("en", "fr")[n % 2]] + " " + words(3, n), ("en", "fr")[n % 2]) for n in range(40)] + [(90, None, "en"), (91, "", "fr"), (92, "123 --", "en")]
    docs = frame(spark, rows)
    assert drop_unknown(docs).count() == 40 and drop_unknown(docs, least_margin=100.0).count() == 0 and drop_unknown(docs).columns == docs.columns


def test_bounds_speak_before_anything_is_collected(spark, words):
    from codeloom.llm.fingerprints import build_lexicon

    docs = frame(spark, [(n, words(30, n % 7), f"l{n}") for n in range(40)])
    with pytest.raises(ValueError, match="40 different values of lang"):
        train(docs, F.lit(True), most_languages=39)
    assert len(train(docs, F.lit(True), most_languages=40).langs) == 40
    assert len(build_lexicon(docs, most=1.0)) > 100
    with pytest.raises(ValueError, match="band terms"):
        build_lexicon(docs, most=1.0, held=100)
