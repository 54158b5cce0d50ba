"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a temporary folder, but in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="spanforge-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_own: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends there, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many tables this process has written and not dropped; a mark for ``drop_written``."""
    return len(_own)


def drop_written(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Removes the tables that this process has written since a mark, but for the one that ``keep`` reads; for when no
    DataFrame built on them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    kept = {p.rpartition("/table-")[2].partition("/")[0] for p in (keep.inputFiles() if keep is not None else ())}
    mine, _own[since:] = _own[since:], []
    for name in mine:
        if name.rpartition("/table-")[2] in kept:
            _own.append(name)
            continue
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
