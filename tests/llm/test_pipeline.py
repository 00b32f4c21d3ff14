"""The pipeline stage by stage against plain versions, and the registered queries on the smallest tables."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gridloom.llm import mixing, quality
from tests.llm.test_dedup import plain_fingerprint, plain_groups, plain_lines, rows_of
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark, nasty, tmp_path):
    stages, docs, made = dict(corpus_pipeline.STAGES), nasty, {}
    for name, stage in stages.items():
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        made[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == nasty.columns
    kept = Counter((r.doc_id, r.n_words) for r in quality.quality(nasty).collect() if r.kept)
    own = rows_of(made["quality"], "doc_id", "text")
    assert Counter((d, len((t or "").encode().split())) for d, t in own) == kept
    want = plain_lines(own)
    own = rows_of(made["line_dedup"], "doc_id", "text")
    assert Counter(own) == Counter((d, t) for d, _, _, t in want)
    assert all(n == len(t) for t, n in rows_of(made["line_dedup"], "text", "n_chars") if t is not None)
    groups = plain_groups([plain_fingerprint(t) for _, t in own])
    best = {}
    for (doc, _), g in zip(own, groups):
        best[g] = min(best.get(g, (True, 0)), (doc is None, doc or 0))
    assert Counter(d for d, _ in rows_of(made["near_dedup"], "doc_id", "text")) == Counter(None if none else d for none, d in best.values())
    copies = Counter()
    for r in mixing.mix(made["near_dedup"]).collect():
        copies[r.doc_id] += r.copies
    assert Counter(d for d, _ in rows_of(made["mix"], "doc_id", "text")) == +copies
    packed = made["pack"].toPandas()
    assert Counter(packed[packed.piece == 0].doc_id.dropna().astype(int)) == Counter({d: n for d, n in copies.items() if d is not None and n})
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()


def test_empty(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


OWN = [n for n in queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    assert compare(spark, connect(SF), SF, queries()[name], oracle_sql().get(name)) == ""


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in OWN[:-1]) == list(range(1, 14)) and "pipeline" in queries()
