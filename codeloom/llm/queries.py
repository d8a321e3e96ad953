"""The registered queries of this subpackage: name -> query(spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_neighbours
from .hard_negatives import NEGATIVES_SQL, hard_negatives
from .langid import held_out, identify, train
from .license_scan import scan, scan_sql
from .minhash_dedup import near_dedup
from .packing import pack
from .pieces import round_trip
from .quality import classify
from .ranked_search import SEARCH_SQL, search
from .suffix_dedup import PASSAGE, suffix_dedup
from .token_files import token_files
from .url_filter import judge


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
n AS (SELECT doc_id, length(body) AS n, regexp_replace(body, '[\x20\x09-\x0D]', '', 'g') AS norm FROM t)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


def op2_quality(spark, sf_dir):
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=held_out("doc_id", 4, 2))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_fingerprints(spark, sf_dir):
    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op5_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark, sf_dir):
    """With n_passage_bytes: bytes of repeated passages of the length that the pipeline removes."""
    return suffix_dedup(table(spark, sf_dir, "documents"), passage=PASSAGE)


def op8_pieces(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


def op9_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs, ~held_out("doc_id", 3, 1)))
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


#: The rules that the query applies, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark, sf_dir):
    """The listed urls stand in for a block list from outside: those of the pages whose id is divisible by 20."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.where("page_id % 20 = 0"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, url,
        translate(regexp_extract(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '^[^/?#]*([^?#]*)', 1, 's') AS path,
        list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'),
                    lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid', 'gclid')) AS q FROM p),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon FROM h),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(rh, rp, rv)),
m AS (SELECT c.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY c.page_id)
SELECT c.page_id, host, path, rule,
       coalesce(rv, CASE WHEN canon <> '' AND canon IN (SELECT canon FROM c WHERE page_id % 20 = 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m USING (page_id)
"""

#: The base phrases that the query counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op11_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), PHRASES)


def op12_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark, sf_dir):
    """Labels of every seventh vector are moved on by one; every hundredth vector is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pieces": op8_pieces,
    "op9_langid": op9_langid,
    "op10_url_filter": op10_url_filter,
    "op11_license_scan": op11_license_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op1_exact_dedup": OP1_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_license_scan": scan_sql(PHRASES),
    "op12_ranked_search": SEARCH_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
