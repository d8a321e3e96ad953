import glob

import pytest

import __spark_entry__ as entry
from codeloom.plans import catalog

#: Checked by the driver at a larger size; here a few of each kind, to keep the suite short.
NAMES = ["f05_qualified_name_with_fallback", "f16_entry_rules", "f23_whole_word_mentions", "f24_first_reason", "j02_prioritized_cascade", "j04_innermost_interval", "j10_longest_suffix_folder", "j22_division", "j23_declarations_and_readers", "j25_nearest_preceding", "a09_clone_classes", "w04_competition", "w08_overlapping_spans", "w09_contiguous_runs", "g04_bounded_walk", "g06_taint", "g10_components", "n02_anchor_slug", "p02_line_and_column", "q02_stats", "x05_html_facts", "q11_unused", "q08_call_graph", "j22_go_interfaces", "j21_dispatch_targets", "e05_attribute_family", "q12_clone_cover", "q15_forward_chain"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(catalog.ORACLE[name])
    cols = [c[0] for c in want.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    say = lambda v: repr(round(v, 6)) if isinstance(v, float) else repr(v)
    assert sorted([say(r[c]) for c in cols] for r in df.collect()) == sorted([say(v) for v in r] for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
