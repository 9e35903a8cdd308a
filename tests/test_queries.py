"""Every registered learning query against its SQL, and the driver's contract."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from loomgrad.operators import models, training
from loomgrad.plans import catalog, crossval
from oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert not differences(catalog.queries()[name](spark, sf_dir), sf_dir, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_no_query_trains_a_whole_fold_or_table_in_one_task(spark, sf_dir, monkeypatch):
    parts, dealt = [], []
    compose, deal = training._composed, training.deal_rows
    monkeypatch.setattr(training, "_composed", lambda *a: parts.append(compose(*a)) or parts[-1])
    for module in (training, models, crossval):
        monkeypatch.setattr(module, "deal_rows", lambda rows, streams: dealt.append(deal(rows, streams)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("t2_minibatch", "t3_stochastic", "t3_stochastic_averaged", "t7_basic_network", "t8_deep_network", "t9_l6_cross_validation"):
            assert catalog.queries()[name](spark, sf_dir).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and all(len(p) > 1 for p in parts)
    assert len(dealt) == 4 and all(rows.rdd.getNumPartitions() > 1 for rows, _ in dealt)


def test_the_entry_file_works_without_the_corpus_operators(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for name in ("loomgrad", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "loomgrad" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'entry' in dir(e) and len(e.queries()) > 40 and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    for pipeline_too in (True, False):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_and_names(spark):
    row = __spark_entry__.entry(spark).first()
    assert 0 <= row["accuracy"] <= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
