"""Session-level plumbing shared by every operator: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    key = id(spark.sparkContext)
    if key not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="motorloom-")
        atexit.register(_remove, _FALLBACK[key])
    return _FALLBACK[key]


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the rows survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stash = path  # type: ignore[attr-defined]
    return back


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_stash(*frames: DataFrame) -> None:
    """Delete the files behind stashed frames that no later plan reads."""
    for df in frames:
        delete_folder(df.sparkSession, df._stash)  # type: ignore[attr-defined]


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that must stay small (a dictionary); fails loudly instead of flooding the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is no bounded dictionary")
    return rows


def join_dictionary(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = 200_000) -> DataFrame:
    """Join with a dimension that is broadcast only if its counted size is within ``most`` rows."""
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)
