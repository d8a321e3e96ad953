"""License scans by ordered signature rules. DataFrame functions only.

A text is lower-cased in A-Z and read as words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, joined by single spaces. One
regular expression over the whole text, a trie of all rules' literal keywords, is the prefilter: it gives every place
where a keyword begins, with the `reach` words from there. Only those windows meet rules, those of their first word,
and of these only rules whose keyword is there run their expression. A document without a keyword meets none.

A detection is an interval of words. A detection inside another's interval goes if the other's priority is the same or
higher; of equal intervals, that of higher priority and then of the earlier rule stays. A detection inside one comes
behind it in order of (start, longer first, higher priority, earlier rule), so the greatest end so far of each priority
tells whether there is one: a running maximum over a document's detections, no pairs.

Base phrases are rules above all others, and stay whatever contains them.

Defined results: null text is empty; a text without words has n_words 0, no detection, empty labels and score 0; each
row is scanned by itself, so ids may be null or repeated; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash
from .license_rules import RULES, Rule
from .url_filter import lower_ascii

#: No rule matches more words than this, counted from its keyword's first.
REACH = 40


def with_base(phrases: dict[str, str], rules: list[Rule] = RULES) -> list[Rule]:
    """The rules with base phrases (phrase -> label) above them."""
    top = max((r.priority for r in rules), default=0) + 1
    return [Rule(n - len(phrases), label, phrase, phrase, top, 1.0, True) for n, (phrase, label) in enumerate(phrases.items())] + list(rules)


def trie(words: list[str]) -> str:
    """A regular expression of literals that looks at each character once; longer literals come before their beginnings."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [c + trie(rest) for c, rest in by.items()]
    if not parts:
        return ""
    out = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{out})?" if "" in words else out


def spaced(text: Column) -> Column:
    """The words of a text, each after one space."""
    words = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, " ", ""))


def windows(docs: DataFrame, rules: list[Rule], text_col: str = "text", reach: int = REACH) -> DataFrame:
    """docs' columns with `n_words` and, in order of their places, `windows`: of the words from each keyword on, and `gap`, the words since the place before."""
    at = " (?=(" + trie([r.keyword for r in rules]) + r"(?: [^ ]+){0," + str(reach) + r"})(?: |$))"
    words, found, pieces = (fresh(n, docs) for n in ("__words", "__found", "__pieces"))
    out = docs.withColumn(words, spaced(F.col(text_col)))
    out = out.withColumn(found, F.regexp_extract_all(words, F.lit(at), F.lit(1)))
    out = out.withColumn(pieces, F.when(F.size(found) > 0, F.split(words, at, -1)).otherwise(F.array().cast("array<string>")))
    # The first piece holds a space for each of its words, every later one begins at its keyword.
    gaps = F.transform(pieces, lambda p, i: _spaces(p) + (i > 0).cast("int"))
    zipped = F.arrays_zip(F.col(found).alias("window"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    zipped = F.transform(zipped, lambda x: F.struct(x["window"].alias("window"), x["gap"].alias("gap")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], _spaces(F.col(words)).cast("bigint").alias("n_words"), zipped.alias("windows"))


def detections(scanned: DataFrame, rules: list[Rule], row: str) -> DataFrame:
    """(row, start, stop, rule columns, kept) of every place where a rule matches."""
    spark = scanned.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rules], "ord int, label string, keyword string, regex string, priority int, confidence double, base boolean")
    table = table.withColumn("first", F.substring_index("keyword", " ", 1))
    places = scanned.where(F.size("windows") > 0).select(row, F.posexplode("windows").alias("at", "w"))
    places = places.select(row, F.sum("w.gap").over(Window.partitionBy(row).orderBy("at")).alias("start"), F.col("w.window").alias("window"))
    # The rules are a fixed table of a few hundred rows.
    tried = places.withColumn("first", F.substring_index("window", " ", 1)).join(F.broadcast(table), "first").where(F.startswith("window", "keyword"))
    tried = tried.withColumn("hit", F.call_function("regexp_extract", "window", F.concat(F.lit("^(?:"), F.col("regex"), F.lit(")(?= |$)")), F.lit(0))).where("hit <> ''")
    found = tried.select(row, "start", (F.col("start") + _spaces(F.col("hit")) + 1).alias("stop"), "ord", "label", "priority", "confidence", "base")
    before = Window.partitionBy(row).orderBy("start", F.desc("stop"), F.desc("priority"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r.priority for r in rules}):
        furthest = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(before)
        inside = inside | ((F.col("priority") == level) & F.coalesce(furthest >= F.col("stop"), F.lit(False)))
    return found.withColumn("kept", ~inside | F.col("base"))


def scan(docs: DataFrame, phrases: dict[str, str], rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) of every row.

    The score is the greatest confidence of the detections that stay.
    """
    rules = with_base(phrases, rules)
    row = fresh("__row", docs.select(id_col, text_col))
    scanned = windows(docs.select(id_col, text_col).withColumn(row, F.monotonically_increasing_id()), rules, text_col)
    scanned = stash(scanned, "license-windows")  # written so that a number stays with its row, and texts are read once
    base, kept = F.col("base"), F.col("kept")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_row = detections(scanned, rules, row).groupBy(row).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.max(F.when(kept, F.col("confidence"))).alias("score"),
        F.count_if(kept).alias("n_detections"),
    )
    out = scanned.select(row, id_col, "n_words").join(per_row, row, "left")
    return out.select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_detections", F.lit(0)).alias("n_detections")
    )


def scan_sql(phrases: dict[str, str], rules: list[Rule] = RULES, reach: int = REACH) -> str:
    """DuckDB SQL for the same columns, from the same rules: every word's window meets the rules of that word, and containment is a join."""
    values = ",\n".join(f"({r.ord}, '{r.label}', '{r.keyword}', '{r.regex}', {r.priority}, {r.confidence}, {str(r.base).lower()})" for r in with_base(phrases, rules))
    return rf"""
WITH rules(ord, label, keyword, regex, priority, confidence, base) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT r, words, unnest(range(len(words))) AS start FROM t),
w AS (SELECT r, start, words[start + 1] AS first, words[start + 1:start + {reach} + 8] AS near FROM p WHERE words[start + 1] IN (SELECT split_part(keyword, ' ', 1) FROM rules)),
d AS (SELECT r, start, ord, label, priority, confidence, base, start + len(string_split(rtrim(regexp_extract(array_to_string(near, ' '), '^(?:' || regex || ')(?: |$)')), ' ')) AS stop
      FROM w JOIN rules ON first = split_part(keyword, ' ', 1) WHERE regexp_matches(array_to_string(near, ' '), '^(?:' || regex || ')(?: |$)')),
k AS (SELECT *, base OR NOT EXISTS (SELECT 1 FROM d e WHERE e.r = d.r AND e.start <= d.start AND e.stop >= d.stop AND e.priority >= d.priority
        AND (e.start < d.start OR e.stop > d.stop OR e.priority > d.priority OR e.ord < d.ord)) AS kept FROM d),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label) FILTER (kept))), ',') AS labels,
        max(confidence) FILTER (kept) AS score, count(*) FILTER (kept) AS n_detections FROM k GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections
FROM t LEFT JOIN g USING (r)
"""
