"""The pipeline's stages on a small corpus, and the SQL twins."""

import os
import sys

import corpus_pipeline
import pytest
from eddy.llm import decontaminate
from eddy.llm.queries import ORACLE, QUERIES

from test_llm_operators import DOCS, brute_components

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.dtypes == docs.dtypes, name
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "language_id":
            assert {r.doc_id for r in kept.collect()} == {d for d, t in rows if t and any(map(str.isalpha, t))}
        if name == "jaccard_join":
            assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute_components(rows).items() if d == c}
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontaminate.judged(decontaminate.find(kept, bench)).where("contaminated").count() == 0
    last = corpus_pipeline.encode(spark, kept, SF)
    assert last.count() == kept.count() > 0


def test_near_duplicates_with_null_and_shared_ids(spark):
    """Every row is judged by its own text."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(1, a, "x"), (None, a + " more", "x"), (None, a, "x"), (None, b, "x"), (None, b + " more", "y"),    # null ids
            (2, a, "x"), (2, c, "x"), (3, c + " more", "x"),                    # 2 holds a copy and a text of its own
            (4, d, "z"), (4, d, "x"), (4, d, "y"),                              # equal but for the source
            (None, e, "x"), (0, e, "x"), (5, "", "x"), (5, "", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text, r.source) for r in kept.collect()), key=str)
    assert len(got) == 8
    assert {x for x in got if x[1] and x[1][0] != "b"} == {(1, a, "x"), (2, c, "x"), (4, d, "x"), (0, e, "x")}
    assert len([x for x in got if x[1] and x[1][0] == "b"]) == 1                # one of the two null ids


def test_empty_corpus(spark):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twins(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    import oracle_check
    rel = oracle_check.duck(SF).sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert not oracle_check.type_diff(got, rel)
    assert oracle_check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == oracle_check.rows_of(rel.columns, rel.fetchall())
