"""What the jobs need from the running session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only in local mode, where none is named, a new local folder:
    on a cluster executors would not share it, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgrad-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from reliable storage: a lost executor costs no recomputation beyond this point."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(few: DataFrame) -> DataFrame:
    """The rows of a small result (metrics of models and folds), so that what it was made of can be released."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


_written: list[str] = []


def _hadoop_path(spark: SparkSession, path: str):
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), name


def path_exists(spark: SparkSession, path: str) -> bool:
    files, name = _hadoop_path(spark, path)
    return files.exists(name)


def delete_path(spark: SparkSession, path: str) -> None:
    files, name = _hadoop_path(spark, path)
    files.delete(name, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet into the shared checkpoint folder and read it back.

    Like :func:`cut_lineage`, for larger tables: columnar and compressed, so it costs less disk. The
    files stay until :func:`release_materialised`, as results that build on them read them late.
    """
    return materialise_with_release(df)[0]


def materialise_with_release(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """:func:`materialise`, and what deletes this one table."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/loomgrad-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)

    def release() -> None:
        if path in _written:
            _written.remove(path)
            delete_path(spark, path)

    return spark.read.schema(df.schema).parquet(path), release


def release_materialised(spark: SparkSession) -> int:
    """Delete what :func:`materialise` has written in this process; results built on it end with it."""
    count = len(_written)
    while _written:
        delete_path(spark, _written.pop())
    return count
