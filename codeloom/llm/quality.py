"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text are computed once. Small trees grown on bootstrap samples of labelled rows give paths;
every path from the root to a node is a conjunctive rule over the statistics. A logistic model with a lasso penalty
keeps few of them. The rules that keep a weight are compiled into one Spark column expression over the statistics.

Training reads at most `sample` labelled rows (default 12000), those of least hash of the id; all rows are scored.

Defined results: null text is empty and is scored like any other; without labels of both kinds the score is the share
of label 1 (0.5 without any); labels that are null are left out and repeated labels count as often as they are there;
repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, emitter, rows_of, stash, utf8

STATS = [
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "spaces", "stops", "symbols", "other_bytes", "top_byte",
    "distinct_words", "top_word", "same_as_last", "distinct_lines", "line_words", "short_words", "odd_words", "bare_words", "upper_words",
]
_kind = np.zeros(256, np.int64)
for _i in range(128):
    _c = chr(_i)
    _kind[_i] = 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'\"-" else 5 if not _c.isalnum() else 0
_kind[128:] = 6


def statistics(text: bytes) -> list[float]:
    n, words = max(1, len(text)), text.split()
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_kind, hist, 7) / n
    hist[32] = 0
    m = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(c for w, c in counts.items() if len(w) > 1 and not w[-2:].isalnum() and w[-2] < 128 and not w[-2:-1].isalnum())
    bare = sum(c for w, c in counts.items() if not any(x >= 128 or 65 <= x <= 90 or 97 <= x <= 122 for x in w))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), (n - hist[10]) / m, float(max(map(len, counts), default=0)),
        *share[1:].tolist(), float(hist.max()) / n,
        len(counts) / m, max(counts.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)),
        sum(c for w, c in counts.items() if len(w) < 4) / m, odd / m, bare / m, sum(c for w, c in counts.items() if w.isupper()) / m,
    ]


_OUT = pa.schema([("id", pa.int64()), *((s, pa.float64()) for s in STATS)])


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches):
        put, flush = emitter(_OUT)
        for i, text in rows_of(batches):
            yield from put((i, *statistics(utf8(text))), 200)
        yield from flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is greater than, bound)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng, path: Rule = ()) -> list[Rule]:
    """The paths to all nodes below the root of a tree of least squares, over a random third of the statistics at each node."""
    if not depth or len(y) < 2 * least or y.min() == y.max():
        return []
    best = (1e-9, 0, 0.0)
    for j in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 3)]:
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        at = np.arange(least - 1, len(v) - least)
        at = at[v[at] < v[at + 1]]
        if len(at):
            left, right = s[at], s[-1] - s[at]
            gain = left**2 / (at + 1) + right**2 / (len(v) - at - 1) - s[-1] ** 2 / len(v)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[at[k]] + v[at[k] + 1]) / 2))
    _, j, bound = best
    if best[0] <= 1e-9:
        return []
    out = []
    for more in (False, True):
        rows = (x[:, j] > bound) == more
        here = (*path, (j, more, bound))
        out += [here, *grow(x[rows], y[rows], depth - 1, least, rng, here)]
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, more, bound in rule:
        out &= (x[:, j] > bound) == more
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    b, w, pb, pw, t = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 1.0
    pb = b
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-(x @ pw + pb))) - y
        new_b, new = pb - step * wrong.mean(), pw - step * (x.T @ wrong) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pb, pw = new_b + (t - 1) / nt * (new_b - b), new + (t - 1) / nt * (new - w)
        b, w, t = new_b, new, nt
    return b, w


class RuleModel:
    def __init__(self, base: float, rules: list[tuple[Rule, float]]) -> None:
        self.base, self.rules = base, rules

    def column(self) -> Column:
        """The score as one column expression over the statistics."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, more, bound in rule:
                test = test & ((F.col(STATS[j]) > F.lit(bound)) if more else (F.col(STATS[j]) <= F.lit(bound)))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, penalty: float = 0.001, seed: int = 5) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return RuleModel(float(np.log(share / (1 - share))), [])
    rng, found = np.random.default_rng(seed), {}
    least = max(5, len(y) // 200)
    for _ in range(trees):
        at = rng.choice(len(y), max(20, len(y) // 2), replace=True)
        for rule in grow(x[at], y[at].astype(float), depth, least, rng):
            found.setdefault(holds(rule, x).tobytes(), rule)  # rules that hold for the same rows are one
    rules = [r for r in found.values() if 0 < holds(r, x).mean() < 1]
    if not rules:
        return fit(x, np.zeros(0))
    z = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    base, weights = lasso_logistic(z, y, penalty)
    return RuleModel(base, [(r, float(w)) for r, w in zip(rules, weights) if w])


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, sample: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row; held_out (a condition on the id column) marks rows never learned from."""
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    stats = stash(with_statistics(docs, id_col, text_col), "statistics").withColumnRenamed("id", id_col)
    marked = labels.where(F.col(label_col).isNotNull() & ~held).select(id_col, F.col(label_col).cast("int").alias("__y"))
    # Which labelled rows are learned from is settled on ids alone, before any statistics move.
    chosen = marked.join(stats.select(id_col), id_col, "left_semi").orderBy(F.xxhash64(id_col, F.lit(23)), id_col, "__y").limit(sample)
    rows = stats.join(F.broadcast(chosen), id_col).select("__y", *STATS, id_col).collect()
    rows.sort(key=lambda r: (r[id_col], r["__y"]))
    x = np.array([[r[s] for s in STATS] for r in rows], float).reshape(len(rows), len(STATS))
    model = fit(x, np.array([float(r["__y"] > 0) for r in rows]))
    score = model.column()
    return stats.select(id_col, held.alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
