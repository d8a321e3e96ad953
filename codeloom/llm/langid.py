"""Language identification by hierarchical discrimination.

Features are hashed byte n-grams (one to three bytes, case-folded, everything but letters as one space), as root-scaled
frequencies of unit length over the whole text. A first linear model tells language families apart; within a family,
one-versus-one linear support vector machines vote on the languages. Both are trained by dual coordinate descent on
squared hinge loss.

Training reads a bounded sample of the rows that `learn` marks: at most `per_language` documents of a language (500) and
about `sample` documents in all (3000), those of least hash of the id. All documents are predicted. Only the sample's
features come to the driver, compressed; there they take 16 KB a document. Weights take 32 KB for each family and for each pair inside one, so more
than `most_languages` different labels (1000, several times the codes in use) are refused with their number: such a
column doesn't hold languages.

Defined results: null text, or text without a letter, is `und` with score 0; a language that no training row has can't
be predicted; with one language trained, all other texts get it with score 1; with none, all are `und`; repeated rows
get equal predictions; an empty table gives an empty result; ids may be null; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, emitter, rows_of, unpacked

SIZE = 4096
#: Families of common languages by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
}
_family = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_fold = bytes(32 if i < 128 and not chr(i).isalpha() else ord(chr(i).lower()) if i < 128 else i for i in range(256))


def features(text: str) -> np.ndarray:
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_fold).split()) + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    out = np.zeros(SIZE)
    for n, grams in enumerate((x, two, three)):
        h = (grams + np.uint32(n << 24)) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(20), minlength=SIZE)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights, the bias last, by dual coordinate descent on squared hinge loss; y is 1 or -1. Classes weigh alike.

    rows: those of x that y is for. x is read where it lies; no copy of it is made, since the driver holds it.
    """
    at = np.arange(len(x)) if rows is None else np.asarray(rows)
    w, bias, a = np.zeros(x.shape[1]), 0.0, np.zeros(len(at))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    q, soft = np.array([float(x[i].astype(np.float64) @ x[i]) + 1 for i in at]), share / cost
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(at)):
            row = x[at[i]].astype(np.float64)
            step = max(a[i] - (y[i] * (row @ w + bias) - 1 + soft[i] * a[i]) / (q[i] + soft[i]), 0.0) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * row
                bias += step * y[i]
    return np.append(w, bias)


class Model:
    """Families first, then votes inside the family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        names = np.array(langs)
        families = np.array([_family.get(v, v) for v in langs])
        self.families = sorted(set(families.tolist()))
        self.family_w = np.stack([linear_svm(x, np.where(families == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.members = {f: sorted({v for v in self.langs if _family.get(v, v) == f}) for f in self.families}
        self.pair_w = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                rows = np.flatnonzero((names == a) | (names == b))
                self.pair_w[a, b] = linear_svm(x, np.where(names[rows] == a, 1, -1), rows=rows)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        family, sure = self.families[0], 1.0
        if self.family_w is not None:
            p = 1 / (1 + np.exp(-4 * (self.family_w @ x)))
            p /= p.sum()
            family, sure = self.families[int(p.argmax())], float(p.max())
        members = self.members[family]
        votes = {v: 0.0 for v in members}
        for a, b in combinations(members, 2):
            p = float(1 / (1 + np.exp(-4 * (self.pair_w[a, b] @ x))))
            votes[a] += p
            votes[b] += 1 - p
        best = max(members, key=lambda v: (votes[v], v))
        return best, sure * (votes[best] / (len(members) - 1) if len(members) > 1 else 1.0)


    def margin(self, x: np.ndarray) -> float:
        """How far the best family's decision is above the next one's; without limit where there is one family."""
        if self.family_w is None:
            return np.inf
        best = np.sort(self.family_w @ np.append(x, 1.0))
        return float(best[-1] - best[-2])


def train(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, sample: int = 3000, most_languages: int = 1000) -> Model | None:
    """Fits a model on a bounded sample: per_language rows of each language that has any."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h"))
    by_language = rows.groupBy("lang").count()
    counts = by_language.limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"{by_language.count()} different values of {lang_col}; at most {most_languages} languages are learned")
    if not counts:
        return None
    per_language = max(1, min(per_language, sample // len(counts)))
    # A hash bound lets through somewhat more than is needed, so that what is ranked is small at any size of the table.
    parts = [(r["lang"], min(1.0, 1.5 * per_language / r["count"] + 20 / r["count"])) for r in counts]
    bounds = docs.sparkSession.createDataFrame([(v, min(2**63 - 1, int(-(2**63) + part * 2**64))) for v, part in parts], "lang string, most bigint")
    near = rows.join(F.broadcast(bounds), "lang").where("h <= most").select("lang", "text", "h")  # one row a language

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            got = [(v, h, squeeze(features(t).tobytes())) for v, t, h in rows_of([b]) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["lang", "h", "z"])

    found = near.mapInArrow(run, "lang string, h bigint, z binary").collect()
    kept, seen, place = [], {}, itemgetter("lang", "h")
    for _, tied in groupby(sorted(found, key=place), place):
        for r in sorted(tied, key=lambda r: unpacked(r["z"])):
            seen[r["lang"]] = seen.get(r["lang"], 0) + 1
            if seen[r["lang"]] <= per_language:
                kept.append(r)
    if not kept:
        return None
    langs = [r["lang"] for r in kept]
    x = np.empty((len(kept), SIZE), np.float32)
    for i, r in enumerate(kept):
        x[i] = np.frombuffer(unpacked(r["z"]), np.float32)
    del found, kept
    return Model(x, langs)


_OUT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of each family and pair of languages

    def run(batches):
        put, flush = emitter(_OUT)
        for i, text in rows_of(batches):
            lang, score = shared.value.predict(features(text)) if shared.value and has_letter(text) else ("und", 0.0)
            yield from put((i, lang, score))
        yield from flush()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, least_margin: float = 0.05) -> DataFrame:
    """The rows of docs whose language is known, all columns. Texts without a letter go, and texts that two families claim alike (the best one's decision is less than `least_margin` above the next one's, whatever the number of languages).

    Defined results: null and empty texts go; every row is judged by its own text, so ids may be null or repeated (they
    only choose what is learned from); texts of any length are read whole; without any labelled row, or in an empty
    table, nothing is known and nothing stays; other columns, whatever their names, are kept as they are.
    """
    model = train(docs, ~held_out(id_col, 3, 1), id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of each family and pair of languages
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            known = [shared.value is not None and has_letter(t) and shared.value.margin(features(t)) >= least_margin for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
