"""Registered queries against their SQL, and the package without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__
from bagfold import catalog
from bagfold.operators import search

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    want = con.sql(catalog.oracles()[name])
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in want.project(", ".join(columns)).fetchall()), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.oracles())))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


@needs_data
def test_approximate_search_finds_most_of_the_tables(spark):
    truth, found = (catalog.QUERIES[q](spark, FOLDER).select("qid", "did") for q in ("mips_topk", "ivf_search"))
    assert search.overlap(found, truth) >= 0.9


@needs_data
def test_eigenvalues_equal_numpy(spark):
    rows = catalog.docs_e(spark, FOLDER)
    size = catalog.E.buckets * catalog.E.width
    grams = {}
    for r in catalog._encoded_e(spark, FOLDER).collect():
        x = np.asarray(r.fde, float).reshape(catalog.E.repetitions, size)
        for b in range(catalog.E.repetitions):
            grams.setdefault(b, []).append(x[b])
    values = []
    for b, x in grams.items():
        x = np.stack(x)
        std = x.std(0)
        x = (x - x.mean(0)) / np.where(std > 0, std + 1e-12, 1.0)
        values += [(-v, b) for v in np.linalg.eigvalsh(np.cov(x.T))]
    got = sorted((r.out_pos, r.eigenvalue) for r in catalog.QUERIES["pca_top_eigenvalues"](spark, FOLDER).collect())
    assert rows.select("id").distinct().count() == len(grams[0])
    assert [v for _, v in got] == pytest.approx([-v for v, _ in sorted(values)[:20]], abs=1e-5)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_package_without_corpus_operators(tmp_path):
    """The rest imports when that folder and the pipeline are gone."""
    code = "import shutil, sys; shutil.copytree(sys.argv[1], 'copy', ignore=shutil.ignore_patterns('llm', 'corpus_pipeline.py', '.git')); sys.path.insert(0, 'copy'); import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path, check=True)
