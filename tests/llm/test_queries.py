import pytest

from codeloom.llm.queries import ORACLE, QUERIES

ROWS = {"op10_url_filter": "pages"}
SEARCHES = {"op12_ranked_search", "op13_hard_negatives"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SEARCHES))
def test_query_covers_its_table(spark, sf, name):
    out = QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/{ROWS.get(name, 'documents')}.parquet").count()
    assert out.count() == n if name != "op6_packing" else out.count() >= n


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    cols = [c[0] for c in want.description]
    rows = sorted(map(repr, (tuple(r) for r in want.fetchall())))
    assert sorted(repr(tuple(r[c] for c in cols)) for r in QUERIES[name](spark, sf).collect()) == rows


def test_pipeline_keeps_columns_and_packs(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs_out = stage(spark, docs, sf).cache()
        assert docs_out.columns == docs.columns and 0 < docs_out.count() <= n
        docs, n = docs_out, docs_out.count()
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_stages_handle_odd_rows_and_nothing(spark, odd_rows, tmp_path):
    """Nulls, blanks, repeated and null ids, a very long text and clashing names, through every stage and through run."""
    import corpus_pipeline as cp

    from .conftest import frame

    rows = [(i, t, "en" if i and i % 2 else "de") for i, t, *_ in odd_rows] + [(17, None, None)]
    for data in (frame(spark, rows), frame(spark, []).where("false")):
        path = str(tmp_path / f"t{data.count()}")
        data.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        want = docs.count()
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() <= want, name
            docs, want = spark.createDataFrame(out.collect(), out.schema), out.count()
        pieces = cp.STAGES[-1][1](spark, docs, path).collect()
        assert {p.doc_id for p in pieces} == {d.doc_id for d in docs.collect()}
        assert sorted((p.doc_id is None, p.doc_id, p.start, p.length) for p in cp.run(spark, path).collect()) == sorted((p.doc_id is None, p.doc_id, p.start, p.length) for p in pieces)
