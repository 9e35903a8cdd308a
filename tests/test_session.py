from __future__ import annotations

import pytest

from loomgrad import session


def test_tables_are_written_to_the_shared_folder_and_released(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    written = session.materialise(df)
    folder = spark.sparkContext.getCheckpointDir()
    assert folder is not None and all(f.startswith(folder) for f in (p.replace("file:///", "file:/") for p in written.inputFiles()))
    assert written.schema == df.schema and sorted(map(tuple, written.collect()), key=str) == [(1, "a"), (2, None)]
    assert session.release_materialised(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.?found|does not exist|no such file"):
        spark.read.schema(df.schema).parquet(written.inputFiles()[0]).collect()


def test_an_empty_table_keeps_its_schema(spark):
    df = spark.createDataFrame([], "id long, x array<double>")
    assert session.materialise(df).schema == df.schema
    assert session.cut_lineage(df).count() == 0
