"""Document fingerprints by I-Match over several randomised lexicon subsets.

Document frequencies of all terms (lower-cased in A-Z, ASCII punctuation stripped at both ends) are counted over the
whole corpus. The lexicon keeps terms within a band of inverse document frequency: those in at least 1/1000 and at most
1/10 of all documents. By counting, a corpus with a mean of m distinct terms a document has no more than 1000 * m such
terms, whatever its size; that bound is what allows a copy in every worker, and it is checked.

A document's distinct band terms are sorted and hashed once for each of 64 random subsets of the lexicon: 16 each that
keep 1/4, 1/16, 1/64 and 1/256 of the terms. A subset's hash changes if any of its terms comes or goes, so the share of
equal hashes in each group tells how many terms two documents differ in, by maximum likelihood; the likeness is the
estimated Jaccard coefficient of their band terms. Equal fingerprints have likeness 1.

Defined results: null text is empty; a text without band terms has its SHA-256 as fingerprint, and likeness 1 or 0;
equal texts have equal fingerprints; null ids come last; repeated rows are rows of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stash, emitter, rows_of, stash, unpacked, utf8
from .tokens import ordered_texts

RATES = np.repeat([1 / 4, 1 / 16, 1 / 64, 1 / 256], 16)
_EDGE = b".,;:!?\"'()[]{}<>*"
_GRID = np.unique(np.round(np.geomspace(1, 1e6, 96)))
_SAME = _GRID[:, None] * np.log1p(-RATES[::16])[None, :]
_DIFFER = np.log(-np.expm1(_SAME))


def terms(text: bytes) -> set[bytes]:
    out = {w.strip(_EDGE) for w in set(text.lower().split())}
    out.discard(b"")
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text", held: int = 200_000) -> DataFrame:
    """(term, documents) over all rows; counted in each task first, in a table of bounded size."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def flush():
            keys, values = list(counts), list(counts.values())
            counts.clear()
            for i in range(0, len(keys), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 20_000], pa.binary()), pa.array(values[i : i + 20_000], pa.int64())], names=["term", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                for w in terms(utf8(t)):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) >= held:
                yield from flush()
        yield from flush()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("documents"))


class Fingerprinter:
    """Fingerprints under one lexicon."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.index = {w: i for i, w in enumerate(sorted(lexicon))}
        self.member = np.zeros((len(lexicon), len(RATES)), bool)
        self.name = np.zeros(len(lexicon), np.uint64)
        for w, i in self.index.items():
            self.name[i] = xxhash.xxh3_64_intdigest(w)
        salt = np.random.default_rng(41).integers(1, 2**63, len(RATES), dtype=np.uint64)
        for k, rate in enumerate(RATES):
            h = (self.name ^ salt[k]) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.member[:, k] = (h >> np.uint64(32)) < np.uint64(rate * 2**32)

    def __call__(self, text: bytes) -> str:
        get = self.index.get
        ids = sorted(i for w in terms(text) if (i := get(w)) is not None)
        if not ids:
            return "=" + hashlib.sha256(text).hexdigest()
        subset, place = np.nonzero(self.member[ids].T)
        names = self.name[ids][place].tobytes()
        ends = (8 * np.cumsum(np.bincount(subset, minlength=len(RATES)))).tolist()
        out, last = [], 0
        for end in ends:
            out.append(f"{xxhash.xxh3_64_intdigest(names[last:end]) & 0xFFFFFF:06x}" if end > last else "------")
            last = end
        return f"{len(ids):x}:" + "".join(out)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    (n, x), (m, y) = a.split(":"), b.split(":")
    same = np.array([x[i : i + 6] == y[i : i + 6] for i in range(0, len(x), 6)]).reshape(-1, 16).sum(1)
    most = int(n, 16) + int(m, 16)
    differ = _GRID[: max(1, int(np.searchsorted(_GRID, most, "right")))]
    fit = _SAME[: len(differ)] @ same + _DIFFER[: len(differ)] @ (16 - same)
    d = min(float(differ[int(fit.argmax())]), most)
    return float((most - d) / (most + d))


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def build_lexicon(docs: DataFrame, text_col: str = "text", *, least: float = 1 / 1000, most: float = 1 / 10, held: int = 2_000_000) -> list[bytes]:
    """Terms in the band. They are counted before any is collected: more than `held` (about 0.5 GB in a worker; documents of 2,000 distinct terms on average) are refused with their number."""
    n = docs.count()
    band = stash(document_frequencies(docs, text_col).where((F.col("documents") >= max(2.0, n * least)) & (F.col("documents") <= max(2.0, n * most))).select("term"), "band")
    found = band.count()
    if found > held:
        drop_stash(band)
        raise ValueError(f"{found} band terms; workers hold {held}")
    out = [bytes(r["term"]) for r in band.collect()]
    drop_stash(band)
    return out


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = 1 / 1000, most: float = 1 / 10) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and the likeness to both the edited text and the next document.

    The next document is the one before it by id (the greatest id follows the least). The edited text ends with the
    first floor(n / 3) code points of the next document in place of its own last ones.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build_lexicon(docs, text_col, least=least, most=most))
    kept: dict = {}

    def run(batches):
        put, flush = emitter(_OUT)
        if "f" not in kept:
            kept["f"] = Fingerprinter(shared.value)
        of, waiting, bucket = kept["f"], None, None
        for at, own, i, z in rows_of(batches):
            raw = unpacked(z)
            text = raw.decode("utf-8", "surrogatepass")
            now = of(raw)
            if waiting and at == bucket:
                j, before, mark = waiting
                third = len(before) // 3
                edited = utf8(before[: len(before) - third] + text[:third])
                other = of(edited)
                yield from put((j, len(before), hashlib.sha256(edited).hexdigest(), mark, other, likeness(mark, other), likeness(mark, now)), 1100)
            waiting, bucket = (i, text, now) if own else None, at
        yield from flush()

    texts = ordered_texts(docs, id_col, text_col, descending=True, lead=True)
    return texts.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
