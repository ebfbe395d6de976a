"""Each stage of the pipeline against what it says, on planted rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.test_models import brute, check_packed, near_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in near_rows()]
    rows += [(300, "copy", "en", "s", 4), (301, "copy", "en", "s", 4), (302, "my password=abcdef1234 here", "en", "s", 27)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_the_columns(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_copies(spark, docs):
    left = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()}
    assert {301, 302, None} <= left and 300 not in left
    # Empty and null text are equal; the large group of near copies has some equal ones too.
    assert 203 in left and 202 not in left


def test_copies_go_by_id_and_text(spark):
    rows = [(1, "same"), (1, "only here"), (2, "same"), (None, "same"), (None, "no copy"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()}
    assert left == {(1, "only here"), (2, "same"), (None, "no copy"), (4, "")}


def test_near_copies(spark, docs):
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id IS NOT NULL").collect()]
    assert left == {i for i, (label, _) in brute(rows).items() if i == label} | {None}
    assert {0, 200, 300, 302} <= left and not {201, 301} & left


def test_secrets(spark, docs):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.hide_secrets(spark, docs, SF).collect()}
    assert got[302] == ("my [SECRET] here", 16) and got[300] == ("copy", 4) and len(got) == docs.count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packed(rows, 2048)
    assert 0 < len({r["doc_id"] for r in rows}) <= 200
