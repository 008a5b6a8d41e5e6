"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_stored: dict[tuple[str, ...], DataFrame] = {}
_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def build_session(app_name: str = "snapledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on; `conf` adds to them or replaces them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.scheduler.mode": "FAIR",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="snapledger-")
    return _local_scratch[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a not yet existing folder under the shared scratch folder, inside the folder that `owning` opened, if any."""
    parent = _owner.get() or os.path.join(scratch_dir(spark), "snapledger", spark.sparkContext.applicationId)
    return os.path.join(parent, f"{label}-{uuid.uuid4().hex}")


@contextmanager
def owning(spark: SparkSession, label: str) -> Iterator[str]:
    """Everything stored inside goes to one folder, which is deleted at the end and nothing else is.

    For steps whose results are written elsewhere inside: what is still lazy afterwards loses its input.
    """
    folder = new_folder(spark, label)
    before = _owner.set(folder)
    try:
        yield folder
    finally:
        _owner.reset(before)
        delete_folder(spark, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage and freezes values that a recomputed task could produce differently
    (partition ids), so losing an executor afterwards cannot change the result.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_once(spark: SparkSession, label: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The settled table `label` of an input folder, built when this application first asks for it.

    The inputs of a folder count as unchanged until `clear_scratch`.
    """
    key = (spark.sparkContext.applicationId, label, source)
    if key not in _stored:
        _stored[key] = settle(build(), label)
    return _stored[key]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application settled. Call it once its results are written elsewhere."""
    folder = os.path.join(scratch_dir(spark), "snapledger", spark.sparkContext.applicationId)
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]
    delete_folder(spark, folder)
