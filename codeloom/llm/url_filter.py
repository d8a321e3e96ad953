"""URL filters: host and path rules, and a blocked Bloom filter before an exact hash join. DataFrame functions only.

Rules. A rule is (host, path, verdict); it fits its host and all subdomains if the url's path starts with the rule's
path; the longest rule that fits wins.

Listed urls. Urls are made canonical: no scheme, host in lower case without a leading `www.`, no fragment, no tracking
parameters, no trailing slash. The filter is a table of 512-bit blocks, each of eight 64-bit words; a url's block and
one bit in each word come from its hash, and words are gathered with bit_or, which combines before the shuffle. Urls
whose eight bits are all set are possible hits and go on to a hash join with the list itself, which removes false
positives; all others are settled without it. The filter takes `bits` bits a listed url; it is broadcast only while its
counted size is below `broadcast_blocks` blocks (64 bytes each), and joined by block beyond that.

Defined results: a null url, or one without `://`, has empty host and path, no rule and no listing: verdict allow;
null, empty and repeated entries of the list don't matter; repeated rows get equal verdicts; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stash

#: Parameters that only tell where a visitor came from.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid".split()


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form that listings are compared in; empty for urls without `://`."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)), "&")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # later ones, the longer, are tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and for each of its eight words a long with one bit set."""
    h = F.xxhash64(url, F.lit(77))
    return F.pmod(F.xxhash64(url), F.lit(blocks)), [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of a list of canonical urls in column `listed`."""
    block, words = _bits(F.col("listed"), blocks)
    return listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def in_list(pages: DataFrame, listed: DataFrame, url_col: str, *, bits: int = 16, broadcast_blocks: int = 1 << 19) -> DataFrame:
    """pages with `is_listed`, by way of the filter and the exact join."""
    listing = stash(listed.select(canonical(F.col(url_col)).alias("listed")).where("listed <> ''").distinct(), "listing")
    blocks = max(1, -(-listing.count() * bits // 512))
    words = stash(bloom(listing, blocks), "bloom")
    if blocks <= broadcast_blocks:
        words = F.broadcast(words)
    url, at = fresh("__url", pages), fresh("block", pages)
    block, probe = _bits(F.col(url), blocks)
    names = [f"w{i}" for i in range(8)]
    asked = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), canonical(F.col(url_col)).alias(url)).withColumn(at, block)
    tested = asked.join(words.withColumnRenamed("block", at), at, "left")
    possible = F.lit(True)
    for name, p in zip(names, probe):
        possible = possible & (F.coalesce(F.col(name), F.lit(0)).bitwiseAND(p) == p)
    tested = tested.select("page", url, possible.alias("possible"))
    # Only possible hits are looked up: all others are settled, and take no part in the join.
    hits = tested.where("possible").join(listing.withColumn("there", F.lit(True)), F.col(url) == F.col("listed"), "left").select("page.*", F.coalesce("there", F.lit(False)).alias("is_listed"))
    return hits.union(tested.where("not possible").select("page.*", F.lit(False).alias("is_listed")))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row: the rule's verdict, else block for listed urls and allow for others."""
    named = in_list(pages.select(id_col, url_col), listed.select(url_col), url_col)
    host, path = host_and_path(F.col(url_col))
    named = named.select(id_col, host.alias("host"), path.alias("path"), "is_listed")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return named.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"), "is_listed")
