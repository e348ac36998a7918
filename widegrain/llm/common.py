"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most.  Texts may be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 2_048, 8 << 20

#: Folders written so far, by scope; those outside any scope are under None.
_written: dict[str | None, list[str]] = {}
_scope: list[str | None] = [None]


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages of these operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where none is set, a temporary folder serves a master that runs in one
    process; with executors of their own there is no such folder to fall back
    to, and that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="widegrain-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(_scope[-1], []).append(at)
    return at


@contextmanager
def scope(name: str):
    """What is written inside can be released together."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def delete_at_exit(spark: SparkSession, at: str) -> None:
    """What has been written there goes when the driver ends, if nobody releases it before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def _collect_garbage(spark: SparkSession) -> None:
    """Ask the driver's JVM to notice what nobody uses any more; a busy or unusual driver may ignore it.

    The first pass finds what the job has left, the second what only that held."""
    try:
        for _ in range(2):
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2_000)
            spark._jvm.System.gc()
            time.sleep(0.1)
    except Exception:  # nothing depends on it but the time at which shuffle files go
        return


def save(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    The shuffle files of what has been cut go when the driver's JVM collects its
    garbage, so it is asked to; a long driver would otherwise keep them all."""
    spark = df.sparkSession
    at = new_path(spark, tag)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    delete_at_exit(spark, at)
    del df
    _collect_garbage(spark)
    return spark.read.schema(schema).parquet(at)


def reads(df: DataFrame, name: str) -> bool:
    """Whether a DataFrame still has to read what has been written in a scope."""
    mine = _written.get(name, [])
    return bool(mine) and any(folder.rsplit("/", 1)[-1] in file for file in df.inputFiles() for folder in mine)


def release(spark: SparkSession, name: str | None = None) -> None:
    """Delete what has been written in a scope; call it when the results that read it have been used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for at in _written.pop(name, []):
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Nodes of a plan that keep each row at its place in the scan.
_IN_PLACE = ("Project", "Filter", "LogicalRelation", "SubqueryAlias")


def in_place(df: DataFrame, tag: str) -> DataFrame:
    """The rows such that a repeated scan finds each at the same place: straight from files, or else written first.

    Operators tell rows apart by their place in the scan; rows that come out of
    a shuffle or a Python function may change places when a task is repeated."""
    left = [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() not in _IN_PLACE and not node.nodeName().startswith("Relation"):
            return save(df, tag)
        below = node.children()
        left += [below.apply(k) for k in range(below.size())]
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one, __doc, so that what an operator adds can't clash with their names."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("__doc.*")
